"""Sources: JSON lines and documents, query and vocabulary tables, traces, rankings, Parquet rows, indexes."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename, clean
from ..operators import integrity
from . import matrices, places

RANKING = "query_id string, field string, rank int, doc_id string, score double, metadata string"
TRACE_HIT = "array<struct<citation:string,title:string,source:string,text:string,score:double>>"
TRACE = f"query_id string, candidate_law_hits {TRACE_HIT}, candidate_court_hits {TRACE_HIT}"
REPLAY = "candidate_id string, rank int, score double, confidence double, rationale string, model string, input_sha256 string, batch_sha256 string"
QUERY_GOLD = "query_id string, query string, gold_citations array<string>"
RETRIEVAL = "query_id string, retrieved_citations array<string>"
PREDICTION = "query_id string, predicted_citations array<string>"
GATE_CANDIDATE = "query_id string, citation string, accepted boolean, features map<string,double>"
PERTURBATION = "query_id string, full_score double, ablations array<struct<feature:string,score_without_feature:double,is_evidence:boolean>>"
LOCATED_VIEW = "source_parquet string, row_group string, row_index_in_group string, doc_id string, content string"


def exists(spark: SparkSession, path: str, what: str) -> str:
    """The path, or an error that says what is missing."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"{what} is missing: {path}")
    return path


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of objects; blank lines are skipped, anything else that is no such object fails."""
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def query_table(spark: SparkSession, path: str, gold: bool = False) -> DataFrame:
    """(query_id, query[, gold_citations], ordinal) in file order; ids are trimmed, values stay raw."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    lost = {"query_id", "query", *(["gold_citations"] if gold else [])} - set(df.columns)
    if lost:
        raise integrity.IntegrityError(f"{path} lacks columns: {', '.join(sorted(lost))}")
    df = df.withColumn("query_id", F.trim("query_id")).withColumn("ordinal", F.monotonically_increasing_id())
    integrity.require(integrity.non_empty(df), integrity.duplicates(df, ["query_id"]), integrity.record_rules(df, ["query_id"], {c: F.trim(F.col(c)) != "" for c in ("query_id", "query")}))
    return df


def citation_table(spark: SparkSession, path: str) -> DataFrame:
    """(citation) of a CSV, plain or gzip; a gzip file is one split, so its rows are dealt out again."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "citation" not in df.columns:
        raise integrity.IntegrityError(f"{path} lacks a citation column")
    rows = df.select(clean(F.col("citation")).alias("citation")).where("citation <> ''")
    return rows.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else rows


def sparse_traces(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, kind, position, citation, title, source, text, score) of ``root/*/trace.json``."""
    traces = json_document(spark, f"{root}/*/trace.json", TRACE)
    side = lambda kind: traces.select("query_id", F.lit(kind).alias("kind"), F.posexplode(f"candidate_{kind}_hits").alias("p", "h")).select("query_id", "kind", (F.col("p") + 1).alias("position"), "h.*")
    return side("law").unionByName(side("court"))


def saved_rankings(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, field, rank, doc_id, score, metadata), metadata as canonical JSON text."""
    lines = json_lines(spark, path, "query_id string, field string, rank int, doc_id string, score double, metadata variant")
    return lines.withColumn("metadata", F.to_json("metadata"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Saved documents with unique ids and non-blank texts."""
    df = json_lines(spark, path, "doc_id string, full_document_text string, court string")
    integrity.require(integrity.non_empty(df), integrity.duplicates(df, ["doc_id"]), integrity.record_rules(df, ["doc_id"], {"doc_id": F.trim("doc_id") != "", "text": clean(F.col("full_document_text")) != ""}))
    return df


def submission(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, predicted) of a submission CSV."""
    from ..functions.text import split_citations

    df = spark.read.option("header", True).csv(path).select(F.trim("query_id").alias("query_id"), F.array_sort(split_citations(F.col("predicted_citations"))).alias("predicted"))
    integrity.require(integrity.duplicates(df, ["query_id"]))
    return df


def canonical_index(value: Column) -> Column:
    """A non-negative integer given as canonical decimal text; null for anything else."""
    return F.when(F.rlike(value, F.lit(r"^(0|[1-9][0-9]*)$")), F.try_to_number(value, F.lit("9" * 18)).cast("long"))


def document_views(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """View records with their file, line and locator, in file-name and line order (global_idx from 0)."""
    from pyspark.sql import Window

    lines = spark.read.text(path).select("value", basename(F.col("_metadata.file_path")).alias("view_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    record = F.parse_json("value")
    get = lambda name, kind="string": F.try_variant_get(record, f"$.{name}", kind)
    # JSON numbers and decimal text are indexes, true, false and fractions are not.
    number = lambda name: F.when(F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant")).isin("BIGINT", "STRING"), canonical_index(get(name)))
    rows = lines.select("view_file", "block", "line", basename(get("source_parquet")).alias("source_file"), number("row_group").alias("row_group"), number("row_index_in_group").alias("row_index"), get("doc_id").alias("doc_id"), get("content").alias("content"))
    # Numbered split by split: counts of splits give where each begins, and rows are ranked within one split only.
    sizes = rows.groupBy("view_file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("view_file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    begin = sizes.select("view_file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("view_file", "block").orderBy("line")) - 1
    numbered = rows.withColumn("r", place).join(begin, ["view_file", "block"])
    out = numbered.withColumn("global_idx", F.col("first") + F.col("r")).drop("first", "r", "block", "line")
    return out.where(F.col("global_idx") < limit) if limit else out


def view_record_violations(views: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rules of view records: a Parquet source, valid and unique locators inside their row group."""
    rules = {"parquet source": F.col("source_file").endswith(".parquet"), "row group": F.col("row_group").isNotNull(), "row": F.col("row_index").isNotNull()}
    inside = views.join(offsets.select(F.col("file").alias("source_file"), "row_group", "rows"), ["source_file", "row_group"], "left")
    bounds = {"known row group": F.col("rows").isNotNull(), "row in group": F.col("row_index") < F.col("rows")}
    return integrity.all_of(integrity.record_rules(views, ["global_idx"], rules), integrity.record_rules(inside, ["global_idx"], bounds), integrity.duplicates(views, ["source_file", "row_group", "row_index"]), integrity.non_empty(views))


def half_matrix(spark: SparkSession, path: str, rows: int, dims: int, field: str) -> DataFrame:
    """(field, idx, v) of a raw little-endian float16 matrix, read by byte ranges; its size must be rows x dims x 2."""
    fs, place = places.hadoop(spark, path)
    if (found := fs.getFileStatus(place).getLen()) != rows * dims * 2:
        raise integrity.IntegrityError(f"{path} has {found} bytes, not {rows * dims * 2}")
    return matrices.read(spark, [(field, path, 0, rows)], dims)


def index_manifest(path: str, fields: Sequence[str], model: str | None = None, revision: str | None = None) -> dict:
    """An index's manifest with fixed fields in order, float16 and the expected model."""
    spark = SparkSession.getActiveSession()
    found = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    wrong = [n for n, want in (("fields", list(fields)), ("dtype", "float16"), ("model", model), ("revision", revision)) if want is not None and found.get(n) != want]
    wrong += [n for n in ("rows", "dims") if not isinstance(found.get(n), int) or isinstance(found.get(n), bool) or found[n] <= 0]
    if wrong:
        raise integrity.IntegrityError(f"manifest disagrees on: {', '.join(wrong)}")
    return found


def wanted_rows(metadata: DataFrame, wanted: DataFrame) -> DataFrame:
    """Index metadata of the wanted global_idx only; complete and unique or an error."""
    found = metadata.join(wanted.select("global_idx").distinct(), "global_idx", "left_semi")
    integrity.require(integrity.duplicates(found, ["global_idx"]), integrity.missing(wanted, found, ["global_idx"], "index metadata"))
    return found


def online_asset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an online asset: queries, views, documents, dense and bm25 rankings, script; cross-checked."""
    views = "map<string,struct<normal_query:string,meta_searchterm:string,keywords:string,fulltext:string,citations:string>>"
    schema = (
        "version int, queries array<struct<query_id:string,query:string,split:string>>, retrieval_views " + views + ", "
        "documents array<struct<doc_ref:string,text:string,citations:array<string>,court:string,decision_id:string,docket_number:string,decision_date:string>>, "
        "dense_rankings map<string,array<string>>, bm25_rankings map<string,array<string>>, fixture_script variant"
    )
    asset = json_document(spark, path, schema)
    queries = asset.select(F.explode("queries").alias("q")).select("q.*")
    docs = asset.select(F.explode("documents").alias("d")).select("d.*")
    own_views = asset.select(F.explode("retrieval_views").alias("query_id", "v")).select("query_id", "v.*")
    ranking = lambda name: asset.select(F.explode(name).alias("query_id", "r")).select("query_id", F.posexplode("r").alias("p", "doc_ref")).select("query_id", "doc_ref", (F.col("p") + 1).alias("position"))
    out = {"queries": queries, "documents": docs, "views": own_views, "dense": ranking("dense_rankings"), "bm25": ranking("bm25_rankings"), "script": asset.select("fixture_script")}
    checks = [integrity.duplicates(queries, ["query_id"]), integrity.duplicates(docs, ["doc_ref"]), integrity.record_rules(docs, ["doc_ref"], integrity.document_rules()), integrity.missing(own_views, queries, ["query_id"], "query of views")]
    for name in ("dense", "bm25"):
        checks += [integrity.missing(out[name], docs, ["doc_ref"], f"document of {name}"), integrity.missing(out[name], queries, ["query_id"], f"query of {name}"), integrity.duplicates(out[name], ["query_id", "doc_ref"])]
    integrity.require(*checks)
    return out


def config(path: str) -> dict:
    with open(path, "rb") as source:
        return tomllib.load(source)


def positive(table: dict, name: str, default: int) -> int:
    """A positive setting; as in ``int(x or default)``, 0 and missing mean the default."""
    value = int(table.get(name) or default)
    if value <= 0:
        raise ValueError(f"{name} must be positive")
    return value


def retrieval_summary(spark: SparkSession, path: str | None) -> DataFrame:
    """(query_id, query, meta_query, keywords_query) of a JSON array; no path gives no rows."""
    schema = "query_id string, query string, meta_query string, keywords_query string"
    return json_document(spark, path, schema) if path else spark.createDataFrame([], schema)


def analysis_tables(spark: SparkSession, queries: str, retrieval: str, predictions: str) -> DataFrame:
    """(query_id, gold, retrieved, predicted) of three JSON-lines files that hold the same queries."""
    parts = [(queries, QUERY_GOLD, "gold_citations", "gold"), (retrieval, RETRIEVAL, "retrieved_citations", "retrieved"), (predictions, PREDICTION, "predicted_citations", "predicted")]
    tables = [json_lines(spark, p, s).select("query_id", F.col(c).alias(n)) for p, s, c, n in parts]
    checks = []
    for df in tables:
        name = df.columns[1]
        checks += [integrity.non_empty(df), integrity.duplicates(df, ["query_id"]), integrity.record_rules(df, ["query_id"], integrity.gold_rules(name))]
    for df in tables[1:]:
        checks += [integrity.missing(tables[0], df, ["query_id"], "query is missing"), integrity.missing(df, tables[0], ["query_id"], "unknown query")]
    integrity.require(*checks)
    return tables[0].join(tables[1], "query_id").join(tables[2], "query_id")


def gate_candidates(spark: SparkSession, path: str) -> DataFrame:
    df = json_lines(spark, path, GATE_CANDIDATE)
    integrity.require(integrity.record_rules(df, ["query_id", "citation"], integrity.gate_candidate_rules()), integrity.surrogate_table_rules(df))
    return df


def perturbation_cases(spark: SparkSession, path: str) -> DataFrame:
    df = json_lines(spark, path, PERTURBATION)
    integrity.require(integrity.non_empty(df), integrity.duplicates(df, ["query_id"]), integrity.record_rules(df, ["query_id"], integrity.perturbation_rules()))
    return df
