"""Queries of whole stages: files written and read again, retrieval, selection, the online request; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import analysis, candidates, fusion, gate, integrity, support, verify
from ..session import kept, shuffles_removed
from ..sources import readers, sinks
from . import index, offline, online, tables
from .oracle import _CANDIDATES, _DECIDED, _PREDICTED
from .registry import query
from .tables import scratch, table

SQL: dict[str, str] = {}


def _string(c: str):
    return F.col(c).cast("string")


def _string_of(c):
    return c.cast("string")


@query
def json_lines_scan(spark, sf):
    """Orders written as JSON lines, sorted keys, nulls kept, and read again with their types."""
    path = scratch(spark, "lines")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"), F.concat(F.lit('a "q"\n'), "o_orderpriority").alias("note"))
    sinks.write_json_lines(o, path)
    return readers.json_lines(spark, path, "o_orderkey bigint, o_custkey bigint, status string, note string")


SQL["json_lines_scan"] = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status, 'a "q"' || chr(10) || o_orderpriority AS note FROM orders"""


@query
def json_document_scan(spark, sf):
    """The retrieval summary, an indented JSON array; without one there are no rows."""
    path = scratch(spark, "summary") + ".json"
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows at every scale
    sinks.write_json(spark, path, [{"query_id": str(r["n_nationkey"]), "query": r["n_name"], "meta_query": "é", "keywords_query": None} for r in rows])
    return readers.retrieval_summary(spark, readers.exists(spark, path, "summary")).unionByName(readers.retrieval_summary(spark, None))


SQL["json_document_scan"] = "SELECT n_nationkey::VARCHAR AS query_id, n_name AS query, 'é' AS meta_query, NULL::VARCHAR AS keywords_query FROM nation"


@query
def query_csv_scan(spark, sf):
    """A query table with gold citations from CSV: ids trimmed, values raw; then split and sorted gold lists."""
    path = scratch(spark, "queries")
    c = table(spark, sf, "customer").select(F.concat(F.lit(" "), _string("c_custkey")).alias("query_id"), F.concat(F.lit('say "x", '), "c_name", F.lit("\nnew line")).alias("query"), F.concat("c_mktsegment", F.lit("; ;b;"), "c_mktsegment").alias("gold_citations"))
    c.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    found = readers.query_table(spark, path, gold=True)
    return found.select("query_id", "query", F.array_join(F.array_sort(text.split_citations(F.col("gold_citations"))), "|").alias("gold"))


SQL["query_csv_scan"] = """SELECT c_custkey::VARCHAR AS query_id, 'say "x", ' || c_name || chr(10) || 'new line' AS query, array_to_string(list_sort(list_distinct([c_mktsegment, 'b'])), '|') AS gold FROM customer"""


@query
def submission_round_trip(spark, sf):
    """Predictions of the gate as a submission file and read again."""
    from .catalog import _decided

    path = scratch(spark, "submission") + ".csv"
    everyone = table(spark, sf, "customer").select(_string("c_custkey").alias("query_id"), F.col("c_custkey").alias("ordinal"))
    sinks.write_submission(everyone, gate.predictions(everyone, _decided(spark, sf)), path)
    return readers.submission(spark, path).select("query_id", F.array_join("predicted", ";").alias("predicted"))


SQL["submission_round_trip"] = f"WITH {_PREDICTED} SELECT query_id, array_to_string(predicted, ';') AS predicted FROM pred"


@query
def vocabulary_files(spark, sf):
    """Law and court vocabularies from CSV and from gzip files; blanks go; a citation of both is an overlap."""
    laws, courts = scratch(spark, "laws"), scratch(spark, "courts")
    p = table(spark, sf, "part")
    p.select(F.when(F.col("p_partkey") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("  x"))).alias("citation"), "p_size").write.option("header", True).csv(laws)
    p.where("p_size < 10").select("p_brand", F.concat("p_name", F.lit(" x")).alias("citation")).write.option("header", True).option("compression", "gzip").csv(courts)
    entries = support.vocabulary(readers.citation_table(spark, laws), readers.citation_table(spark, f"{courts}/*.csv.gz"))
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("citation").alias("last")).unionByName(support.vocabulary_overlap(entries).agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last")).withColumn("kind", F.lit("overlap")))


SQL["vocabulary_files"] = """
WITH l AS (SELECT DISTINCT trim(regexp_replace(p_name || '  x', '\\s+', ' ', 'g')) AS c FROM part WHERE p_partkey % 10 > 0), k AS (SELECT DISTINCT trim(regexp_replace(p_name || ' x', '\\s+', ' ', 'g')) AS c FROM part WHERE p_size < 10)
SELECT 'law' AS kind, count(*) AS n, max(c) AS last FROM l UNION ALL SELECT 'court', count(*), max(c) FROM k UNION ALL SELECT 'overlap', count(*), max(c) FROM l JOIN k USING (c)"""


def _traces(spark, sf) -> DataFrame:
    """A trace a nation, its suppliers as law and court hits, written as files in folders and read again."""
    root = scratch(spark, "traces")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    hit = F.struct(
        F.concat(F.lit("Art. "), _string_of(F.col("s_suppkey") % 9), F.lit(" OR")).alias("citation"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("source"),
        F.concat(F.lit("wie Art. "), _string_of(F.col("s_suppkey") % 7 + 1), F.lit(" ZGB")).alias("text"), F.lit(1.0).alias("score"),
    )
    rows = table(spark, sf, "supplier").withColumn("i", place).select("s_nationkey", F.struct(F.col("i") % 3, F.col("i"), hit.alias("hit")).alias("h"), (F.col("i") % 3 == 0).alias("law"))
    side = lambda law: F.transform(F.array_sort(F.collect_list(F.when(F.col("law") == law, F.col("h")))), lambda h: h["hit"])
    traces = rows.groupBy("s_nationkey").agg(side(True).alias("candidate_law_hits"), side(False).alias("candidate_court_hits"))
    body = F.to_json(F.struct(_string("s_nationkey").alias("query_id"), "candidate_law_hits", "candidate_court_hits"))
    sinks.write_documents(traces.select(F.concat(F.lpad(_string("s_nationkey"), 2, "0"), F.lit("/trace.json")).alias("path"), body.alias("text")), root)
    return readers.sparse_traces(spark, root)


_TRACES = """
s AS (SELECT s_nationkey::VARCHAR AS query_id, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier),
hits AS (SELECT query_id, CASE WHEN i % 3 = 0 THEN 'law' ELSE 'court' END AS kind, s_suppkey, row_number() OVER (PARTITION BY query_id, i % 3 = 0 ORDER BY i % 3, i) AS position FROM s)"""
_TURNS = (
    _TRACES
    + """,
turned AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kind = 'law' THEN position - 1 ELSE (position - 1) // 2 END, CASE WHEN kind = 'law' THEN 0 ELSE 1 + (position - 1) % 2 END) AS hit_pos FROM hits),
cited AS (SELECT query_id, hit_pos, 'Art. ' || (s_suppkey % 9) || ' OR' AS citation FROM turned WHERE hit_pos <= 5 UNION SELECT query_id, hit_pos, 'Art. ' || (s_suppkey % 7 + 1) || ' ZGB' FROM turned WHERE hit_pos <= 5)"""
)


@query
def sparse_trace_scan(spark, sf):
    return _traces(spark, sf).select("query_id", "kind", "position", "citation", "title")


SQL["sparse_trace_scan"] = f"WITH {_TRACES} SELECT query_id, kind, position::INTEGER AS position, 'Art. ' || (s_suppkey % 9) || ' OR' AS citation, s_name AS title FROM hits JOIN supplier USING (s_suppkey)"


@query
def sparse_support_stage(spark, sf):
    """Support counts of balanced hits inside the vocabulary, and citations outside it."""
    vocabulary = spark.range(0, 6).select(F.concat(F.lit("Art. "), _string("id"), F.lit(" OR")).alias("citation"))
    counts, outside = support.sparse_support(_traces(spark, sf), vocabulary, 5)
    return counts.unionByName(outside.groupBy("query_id", "citation").agg((-F.count(F.lit(1))).alias("support")))


SQL["sparse_support_stage"] = f"""WITH {_TURNS}
SELECT query_id, citation, CASE WHEN citation LIKE '% OR' AND split_part(citation, ' ', 2)::INTEGER < 6 THEN count(*) ELSE -count(*) END AS support FROM cited GROUP BY 1, 2"""


@query
def discovered_citations(spark, sf):
    return support.discovered_citations(_traces(spark, sf), 5)


SQL["discovered_citations"] = f"WITH {_TURNS} SELECT DISTINCT citation FROM cited"


@query
def saved_ranking_retrieval(spark, sf):
    """Five saved rankings of each customer's orders as JSON lines, checked, fused, with metadata."""
    path = scratch(spark, "rankings")
    o = tables.dealt(table(spark, sf, "orders"), "o_custkey", each=200_000)
    orders_ = {"normal_query": ["o_orderkey"], "meta_searchterm": [F.desc("o_orderkey")], "keywords": ["o_totalprice", "o_orderkey"], "fulltext": [F.desc("o_totalprice"), "o_orderkey"], "citations": ["o_orderdate", "o_orderkey"]}
    base = o.select(_string("o_custkey").alias("query_id"), _string("o_orderkey").alias("doc_id"), F.struct(F.col("o_orderstatus").alias("status")).alias("metadata"), F.lit(1.0).alias("score"), *[F.row_number().over(Window.partitionBy("o_custkey").orderBy(*by)).alias(f) for f, by in orders_.items()])
    long = base.select("query_id", "doc_id", "metadata", "score", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("rank")) for f in fusion.VIEWS])).alias("x")).select("query_id", "doc_id", "metadata", "score", "x.field", "x.rank")
    with shuffles_removed(spark):
        sinks.write_json_lines(long, path, "gzip")
    queries = table(spark, sf, "orders").select(_string("o_custkey").alias("query_id")).distinct()
    rankings = kept(readers.saved_rankings(spark, path), "rankings")
    tables.discard(spark, path)
    found = offline.retrieve_saved(queries, rankings, offline.Settings())
    return found.select("query_id", "doc_id", "rank", F.round("fusion_score", 12).alias("fusion_score"), "metadata", F.element_at("hits", 1)["rank"].alias("first_view_rank"))


SQL["saved_ranking_retrieval"] = """
WITH r AS (SELECT o_custkey::VARCHAR AS query_id, o_orderkey::VARCHAR AS doc_id, o_orderstatus, row_number() OVER (w ORDER BY o_orderkey) AS a, row_number() OVER (w ORDER BY o_orderkey DESC) AS b, row_number() OVER (w ORDER BY o_totalprice, o_orderkey) AS c,
  row_number() OVER (w ORDER BY o_totalprice DESC, o_orderkey) AS d, row_number() OVER (w ORDER BY o_orderdate, o_orderkey) AS e FROM orders WINDOW w AS (PARTITION BY o_custkey)),
s AS (SELECT *, 0.0::DOUBLE + 0.40::DOUBLE / (60 + a) + 1.25::DOUBLE / (60 + b) + 0.85::DOUBLE / (60 + c) + 1.35::DOUBLE / (60 + d) + 0.15::DOUBLE / (60 + e) AS f FROM r)
SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY f DESC, e))::INTEGER AS rank, round(f, 12) AS fusion_score, '{"status":"' || o_orderstatus || '"}' AS metadata, a::INTEGER AS first_view_rank FROM s"""


@query
def saved_ranking_checks(spark, sf):
    """Rules of saved rankings over planted faults."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    base = o.select(_string("o_custkey").alias("query_id"), F.col("o_custkey").alias("q"), _string("o_orderkey").alias("doc_id"), rank.alias("rank"), F.concat(F.lit("d"), (k % 2).cast("string")).alias("metadata"))
    rankings = base.select("query_id", F.when(F.col("q") % 11 == 0, "other").otherwise("keywords").alias("field"), (F.col("rank") + F.when(F.col("q") % 7 == 0, 1).otherwise(0)).alias("rank"), "doc_id", "metadata")
    queries = table(spark, sf, "customer").where("c_custkey % 5 > 0").select(_string("c_custkey").alias("query_id"))
    return fusion.saved_ranking_violations(rankings, queries, ["keywords"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


SQL["saved_ranking_checks"] = """
WITH r AS (SELECT o_custkey AS q, count(*) AS n FROM orders GROUP BY 1), known AS (SELECT c_custkey AS q FROM customer WHERE c_custkey % 5 > 0),
v AS (SELECT 'known query' AS rule FROM r WHERE q NOT IN (SELECT q FROM known) UNION ALL SELECT 'known field' FROM orders WHERE o_custkey % 11 = 0 UNION ALL SELECT 'contiguous ranks' FROM r WHERE q % 7 = 0
  UNION ALL SELECT 'no empty ranking' FROM known WHERE q % 11 = 0 OR q NOT IN (SELECT q FROM r))
SELECT rule, count(*) AS n FROM v GROUP BY rule"""


@query
def document_scan(spark, sf):
    """Saved documents as JSON lines: ids unique, texts not blank."""
    path = scratch(spark, "documents")
    d = table(spark, sf, "documents").select(_string("doc_id").alias("doc_id"), F.concat(F.lit("t "), F.coalesce("text", F.lit(""))).alias("full_document_text"), F.col("source").alias("court"))
    sinks.write_json_lines(d, path)
    return readers.documents(spark, path).select("doc_id", F.length("full_document_text").alias("chars"), F.sha2(F.col("full_document_text").cast("binary"), 256).alias("sha256"), "court")


SQL["document_scan"] = "SELECT doc_id::VARCHAR AS doc_id, length('t ' || coalesce(text, ''))::INTEGER AS chars, sha256('t ' || coalesce(text, '')) AS sha256, source AS court FROM documents"


def _views(spark, sf) -> DataFrame:
    """View records of the documents in several files, in order of doc_id."""
    path = scratch(spark, "views")
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    record = F.struct(F.concat(F.lit("in/"), F.when(i % 17 == 0, "notes.txt").otherwise("documents.parquet")).alias("source_parquet"), F.when(i % 13 == 0, "01").otherwise("0").alias("row_group"), _string("doc_id").alias("row_index_in_group"), _string("doc_id").alias("doc_id"), F.lit("{}").alias("content"))
    d.select("doc_id", F.to_json(record).alias("value")).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return readers.document_views(spark, path)


@query
def view_records(spark, sf):
    """View records numbered by file and line, with their locators."""
    return _views(spark, sf).select("global_idx", "source_file", "row_group", "row_index", "doc_id")


SQL["view_records"] = """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS global_idx, CASE WHEN doc_id % 17 = 0 THEN 'notes.txt' ELSE 'documents.parquet' END AS source_file, CASE WHEN doc_id % 13 > 0 THEN 0 END AS row_group, doc_id AS row_index, doc_id::VARCHAR AS doc_id FROM documents"""


@query
def view_record_checks(spark, sf):
    """Rules of view records against a corpus whose only row group has 150 rows; rows of each file."""
    views = _views(spark, sf)
    offsets = spark.createDataFrame([("documents.parquet", 0, 0, 150)], "file string, row_group long, first_row long, rows long")
    broken = readers.view_record_violations(views, offsets).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    files = sinks.row_offsets(views).agg(F.sum("rows").alias("n")).select(F.lit("rows").alias("rule"), "n")
    return broken.unionByName(files).unionByName(candidates_max(views))


def candidates_max(views: DataFrame) -> DataFrame:
    """The greatest row of each known row group."""
    return views.where("row_group IS NOT NULL").groupBy("source_file", "row_group").agg(F.max("row_index").alias("n")).select(F.concat(F.lit("last of "), "source_file").alias("rule"), "n")


SQL["view_record_checks"] = """
WITH v AS (SELECT doc_id AS i, doc_id % 17 = 0 AS txt, doc_id % 13 = 0 AS bad FROM documents),
b AS (SELECT unnest(list_filter([CASE WHEN txt THEN 'parquet source' END, CASE WHEN bad THEN 'row group' END, CASE WHEN txt OR bad THEN 'known row group' END, CASE WHEN txt OR bad OR i >= 150 THEN 'row in group' END], lambda x: x IS NOT NULL)) AS rule FROM v)
SELECT rule, count(*) AS n FROM b GROUP BY rule UNION ALL SELECT 'rows', count(*) FROM v UNION ALL SELECT 'last of ' || CASE WHEN txt THEN 'notes.txt' ELSE 'documents.parquet' END, max(i) FROM v WHERE NOT bad GROUP BY txt"""


@query
def dense_index_files(spark, sf):
    """An index of normalised views written with its metadata and manifest, and the wanted rows read again."""
    path = scratch(spark, "index")
    vecs = tables.view_vectors(spark, sf).withColumn("v", vectors.unit(F.col("v")).cast("array<float>")).where("v IS NOT NULL AND field <> 'citations'")
    metadata = table(spark, sf, "embeddings").select(F.col("vec_id").alias("global_idx"), "label")
    fields = [v for v in fusion.VIEWS if v != "citations"]
    rows = metadata.count()
    sinks.write_index(vecs, metadata, {"fields": fields, "dtype": "float16", "rows": rows, "dims": 13, "model": "m", "revision": "r"}, path)
    manifest = readers.index_manifest(f"{path}/manifest.json", fields, "m", "r")
    wanted = metadata.where("global_idx % 7 = 0")
    found = readers.wanted_rows(spark.read.parquet(f"{path}/metadata"), wanted)
    held = spark.read.parquet(f"{path}/vectors").where("idx % 7 = 0").groupBy("idx").agg(F.count(F.lit(1)).alias("views"))
    return found.join(held, found["global_idx"] == held["idx"]).select("global_idx", "label", "views", F.lit(manifest["rows"]).cast("long").alias("rows"))


SQL["dense_index_files"] = "SELECT vec_id AS global_idx, label, 4::BIGINT AS views, (SELECT count(*) FROM embeddings) AS rows FROM embeddings WHERE vec_id % 7 = 0"


@query
def index_retrieval(spark, sf):
    """Dense retrieval over an index and its metadata, with references of the fused rows."""
    found = tables.view_vectors(spark, sf)
    asked = found.where(F.col("idx") % tables.EVERY == 0).select(F.col("idx").alias("query_id"), "field", F.col("v").alias("q"))
    e = table(spark, sf, "embeddings")
    metadata = e.select(F.col("vec_id").alias("global_idx"), F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("d"), _string("vec_id"))).alias("doc_id"), F.when(F.col("vec_id") % 2 == 0, F.lit("x/c.parquet")).alias("source_file"), F.lit(0).alias("row_group"), F.col("vec_id").alias("row_index"))
    settings = offline.Settings(per_view=50, fused=100)
    return offline.retrieve_index(asked, found, metadata, settings).select("query_id", "global_idx", "rank", "doc_id", F.size("hits").alias("views"))


def _index_sql() -> str:
    from .oracle import _VIEWS

    return f"""WITH {_VIEWS}
SELECT query_id, doc_ref AS global_idx, rank, CASE WHEN doc_ref % 2 = 0 THEN 'c.parquet:rg0:row' || doc_ref WHEN doc_ref % 3 = 0 THEN 'd' || doc_ref END AS doc_id,
  ((p1 IS NOT NULL)::INTEGER + (p2 IS NOT NULL)::INTEGER + (p3 IS NOT NULL)::INTEGER + (p4 IS NOT NULL)::INTEGER + (p5 IS NOT NULL)::INTEGER) AS views FROM fused"""


SQL["index_retrieval"] = _index_sql()


def _encoder():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


@query
def encoded_views(spark, sf):
    """All five views through an encoder in batches; a blank text is one space."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("global_idx"), *[F.when(F.col("doc_id") % (i + 2) == 0, F.lit(" \n")).otherwise(F.concat(F.lit(v), "lang")).alias(v) for i, v in enumerate(fusion.VIEWS)])
    found = index.encoded(d, lambda: _encoder(), batch=16)
    return found.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at("v", 1).cast("long")).alias("chars"))


SQL["encoded_views"] = """
WITH f(name, m) AS (VALUES ('normal_query', 2), ('meta_searchterm', 3), ('keywords', 4), ('fulltext', 5), ('citations', 6))
SELECT name AS field, count(*) AS n, sum(CASE WHEN doc_id % m = 0 THEN 1 ELSE length(name || lang) END)::BIGINT AS chars FROM documents, f GROUP BY name"""


@query
def document_view_texts(spark, sf):
    """The five views of documents located by file and row: generated fields, labelled full text, citations."""
    from ..session import ship

    ship(spark)
    path = scratch(spark, "corpus")
    p = table(spark, sf, "part")
    p.select("p_partkey", F.col("p_name").alias("regeste"), F.concat(F.lit("nach Art. "), _string("p_size"), F.lit(" OR")).alias("full_text"), F.array("p_brand", F.lit(" ")).alias("citations")).repartitionByRange(2, "p_partkey").write.parquet(path)
    corpus = spark.read.parquet(path)
    offsets = candidates.row_group_offsets(spark, corpus.inputFiles())
    placed = corpus.select(text.basename(F.col("_metadata.file_path")).alias("source_file"), F.col("_metadata.row_index").alias("at"), "p_partkey").join(offsets, (F.col("source_file") == F.col("file")) & (F.col("at") >= F.col("first_row")) & (F.col("at") < F.col("first_row") + F.col("rows")))
    content = F.concat(F.lit('{"normal_query": " q  '), _string("p_partkey"), F.lit('", "keywords_de": ["a", "b"], "keywords_en": ["c"]'), F.when(F.col("p_partkey") % 2 == 0, "}").otherwise(""))
    records = placed.select("source_file", "row_group", (F.col("at") - F.col("first_row")).alias("row_index"), F.col("p_partkey").alias("global_idx"), content.alias("content"))
    return index.document_texts(records, corpus, offsets)


SQL["document_view_texts"] = """
SELECT p_partkey AS global_idx, 'q ' || p_partkey AS normal_query, '' AS meta_searchterm, 'a ; b ; c' AS keywords, 'regeste: ' || p_name || chr(10) || 'full_text: nach Art. ' || p_size || ' OR' AS fulltext, p_brand || ' ; Art. ' || p_size || ' OR' AS citations FROM part"""


@query
def analysis_files(spark, sf):
    """Gold, retrieved and predicted lists of three files that hold the same queries."""
    base = scratch(spark, "analysis")
    o = table(spark, sf, "customer").select(_string("c_custkey").alias("query_id"), F.array("c_mktsegment", F.lit("x")).alias("gold_citations"), F.array(F.lit("x"), F.lit("y")).alias("retrieved_citations"), F.array("c_mktsegment").alias("predicted_citations"))
    for name in ("gold", "retrieved", "predicted"):
        sinks.write_json_lines(o.select("query_id", f"{name}_citations"), f"{base}/{name}")
    found = readers.analysis_tables(spark, f"{base}/gold", f"{base}/retrieved", f"{base}/predicted")
    return found.select("query_id", *[F.array_join(c, ";").alias(c) for c in ("gold", "retrieved", "predicted")])


SQL["analysis_files"] = "SELECT c_custkey::VARCHAR AS query_id, c_mktsegment || ';x' AS gold, 'x;y' AS retrieved, c_mktsegment AS predicted FROM customer"


@query
def perturbation_files(spark, sf):
    """Perturbation cases written and read by their typed loader, then their targeted effects."""
    from .catalog import _cases

    path = scratch(spark, "cases")
    sinks.write_json_lines(_cases(spark, sf), path)
    return analysis.perturbation_effects(readers.perturbation_cases(spark, path)).select("query_id", "evidence", F.round("targeted_aopc", 6).alias("targeted_aopc"))


SQL["perturbation_files"] = """
WITH e AS (SELECT user_id::VARCHAR AS query_id, floor(value * 4) / 4.0::DOUBLE AS effect, event_type = 'purchase' AS ev FROM events)
SELECT query_id, (count(*) FILTER (ev))::INTEGER AS evidence, round(avg(effect) FILTER (ev), 6) AS targeted_aopc FROM e GROUP BY 1
HAVING count(*) FILTER (ev) > 0 AND count(*) FILTER (NOT ev) >= count(*) FILTER (ev)"""


@query
def selected_citations(spark, sf):
    """Scored candidates, their documents' citations inside and outside the vocabulary, and the gate's decisions."""
    c = tables.candidates(spark, sf).where("rank <= 10")
    prepared = c.select("query_id", F.concat_ws("::", "query_id", "doc_ref").alias("candidate_id"), F.col("doc_ref").alias("doc_id"), "rank")
    scores = c.select("query_id", F.concat_ws("::", "query_id", "doc_ref").alias("candidate_id"), "score", F.lit(1.0).alias("confidence"))
    documents = c.select(F.col("doc_ref").alias("doc_id"), "citations")
    entries = spark.range(1, 31).select(F.concat(F.lit("Art. "), _string("id"), F.lit(" OR")).alias("citation"))
    decided, _, outside = gate.select_citations(prepared, scores, documents, tables.support(spark, sf).where("support > 99"), entries)
    told = decided.select("query_id", "citation", "accepted", F.col("votes").cast("long").alias("n"))
    return told.unionByName(outside.select("query_id", F.explode("outside").alias("citation")).groupBy("query_id", "citation").agg(F.count(F.lit(1)).alias("n")).withColumn("accepted", F.lit(None).cast("boolean")))


SQL["selected_citations"] = f"""WITH {_CANDIDATES},
own AS (SELECT query_id, doc_ref, rank, score, unnest(citations) AS citation FROM cands WHERE rank <= 10),
known AS (SELECT c.query_id, c.doc_ref, c.rank, c.score, list_filter(c.citations, lambda x: split_part(x, ' ', 2)::INTEGER <= 30) AS k FROM cands c WHERE rank <= 10),
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len(k) DESC, rank, query_id || '::' || doc_ref) AS position FROM known),
vot AS (SELECT query_id, citation, count(*) AS n, min(position) AS p, max(score) AS s FROM (SELECT query_id, position, score, unnest(k) AS citation FROM pos) GROUP BY 1, 2)
SELECT query_id, citation, n >= 4 OR (p <= 3 AND s >= 8.5) AS accepted, n FROM vot
UNION ALL SELECT query_id, citation, NULL, count(*) FROM own WHERE split_part(citation, ' ', 2)::INTEGER > 30 GROUP BY 1, 2"""


@query
def online_control(spark, sf):
    """Re-ranked candidates and the leading sparse documents' citations through the gate: public decisions."""
    scored = tables.candidates(spark, sf)
    bm25 = scored.select("query_id", "doc_ref", F.col("rank").alias("position"))
    documents = scored.select("doc_ref", "citations")
    return online.control(scored, bm25, documents).select("query_id", "citation", "kind", "accepted", "support")


SQL["online_control"] = f"""WITH {_CANDIDATES},
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_ref) AS nr FROM cands),
op AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len(citations) DESC, nr, doc_ref) AS pp FROM rr),
vo AS (SELECT query_id, c AS citation, count(*) AS votes, min(pp) AS bp, max(score) AS bs FROM (SELECT query_id, pp, score, unnest(citations) AS c FROM op WHERE pp <= 10) GROUP BY 1, 2),
su AS (SELECT query_id, c AS citation, count(*) AS support FROM (SELECT query_id, unnest(citations) AS c FROM cands WHERE rank <= 5) GROUP BY 1, 2)
SELECT query_id, citation, 'law' AS kind, coalesce(votes, 0) >= 4 OR coalesce(bp <= 3 AND bs >= 8.5, false) OR coalesce(support, 0) >= 2 AS accepted, coalesce(support, 0) AS support FROM vo FULL JOIN su USING (query_id, citation)"""


@query
def online_retrieval(spark, sf):
    """An online asset from its file, cross-checked, and the public hits of its two rankings; the listing of its queries."""
    path = scratch(spark, "asset") + ".json"
    nations = table(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows at every scale
    regions = table(spark, sf, "region").orderBy("r_regionkey").collect()
    views = {f: "x" for f in fusion.VIEWS}
    asset = {
        "version": 2, "queries": [{"query_id": f"q{r['r_regionkey']}", "query": r["r_name"], "split": "test"} for r in regions], "retrieval_views": {f"q{r['r_regionkey']}": views for r in regions},
        "documents": [{"doc_ref": f"d{n['n_nationkey']}", "text": n["n_name"], "citations": [f"Art. {n['n_nationkey']} OR"], "court": None, "decision_id": None, "docket_number": None, "decision_date": None} for n in nations],
        "dense_rankings": {f"q{r['r_regionkey']}": [f"d{n['n_nationkey']}" for n in nations if n["n_regionkey"] == r["r_regionkey"]] for r in regions},
        "bm25_rankings": {f"q{r['r_regionkey']}": [f"d{n['n_nationkey']}" for n in reversed(nations)] for r in regions if r["r_regionkey"] % 2 == 0}, "fixture_script": {},
    }
    sinks.write_json(spark, path, asset)
    own = readers.online_asset(spark, path)
    hits = online.retrieve(own["dense"], own["bm25"], own["documents"], limit=100).select("query_id", "doc_ref", F.col("rank").cast("long").alias("rank"), F.array_join("sources", ",").alias("sources"), "snippet")
    listed = online.listing(own["queries"], own["dense"], "dev").select("query_id", F.lit("").alias("doc_ref"), F.lit(0).cast("long").alias("rank"), F.concat("split", F.lit(" "), F.col("has_dense").cast("string")).alias("sources"), F.col("query").alias("snippet"))
    return hits.unionByName(listed)


SQL["online_retrieval"] = """
WITH d AS (SELECT r_regionkey AS q, n_nationkey AS n, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS pd FROM region JOIN nation ON n_regionkey = r_regionkey),
b AS (SELECT r_regionkey AS q, n_nationkey AS n, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey DESC) AS pb FROM region, nation WHERE r_regionkey % 2 = 0),
u AS (SELECT coalesce(d.q, b.q) AS q, coalesce(d.n, b.n) AS n, pd, pb, 0.0::DOUBLE + coalesce(0.7::DOUBLE / (60 + pd), 0) + coalesce(0.3::DOUBLE / (60 + pb), 0) AS f FROM d FULL JOIN b ON d.q = b.q AND d.n = b.n),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY f DESC, coalesce(pb, 1000000 + pd)) AS rank FROM u)
SELECT 'q' || q AS query_id, 'd' || n AS doc_ref, rank, concat_ws(',', CASE WHEN pb IS NOT NULL THEN 'bm25' END, CASE WHEN pd IS NOT NULL THEN 'dense' END) AS sources, n_name AS snippet FROM r JOIN nation ON n = n_nationkey
UNION ALL SELECT 'q' || r_regionkey, '', 0, 'dev true', r_name FROM region"""


@query
def online_understanding(spark, sf):
    """Explicit citations of queries and key concepts of strict replies."""
    o = table(spark, sf, "part")
    key = _string("p_partkey")
    requests = o.select(key.alias("query_id"), F.concat(F.lit("Gilt Art. "), _string("p_size"), F.lit(" OR?")).alias("query"))
    reply = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"issues": ["'), "p_type", F.lit('"], "keywords": ["k"], "language": "de"}'))).when(F.col("p_partkey") % 3 == 1, F.lit('{"issues": 5, "keywords": ["k"], "language": "de"}')).otherwise(F.lit('Sure: {"issues": []}'))
    found = online.understand(requests, o.select(key.alias("query_id"), reply.alias("response")))
    return found.select("query_id", F.array_join("explicit_citations", ";").alias("explicit"), F.array_join("key_concepts", ";").alias("concepts"), "problem")


SQL["online_understanding"] = """
SELECT p_partkey::VARCHAR AS query_id, 'Art. ' || p_size || ' OR' AS explicit, CASE WHEN p_partkey % 3 = 0 THEN p_type || ';k' END AS concepts,
  CASE p_partkey % 3 WHEN 1 THEN 'a list is no list of texts' WHEN 2 THEN 'reply is no object with exactly the expected keys' END AS problem FROM part"""


@query
def regenerated_views(spark, sf):
    """Stored views that differ in any byte from those made again, after a stored view of every third query was changed."""
    queries = table(spark, sf, "part").select(_string("p_partkey").alias("query_id"), F.concat(F.lit("Frage zu "), "p_name").alias("query"), "p_partkey")
    stored = text.query_views(queries.drop("p_partkey")).withColumn("fulltext", F.when(F.col("query_id").cast("long") % 3 == 0, F.concat("fulltext", F.lit(" "))).otherwise(F.col("fulltext"))).withColumn("citations", F.when(F.col("query_id").cast("long") % 5 == 0, F.lit(None)).otherwise(F.col("citations")))
    return online.changed_views(queries.drop("p_partkey"), stored).select("query_id", F.array_join("fields", ",").alias("fields"))


SQL["regenerated_views"] = """
SELECT p_partkey::VARCHAR AS query_id, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'fulltext' END, CASE WHEN p_partkey % 5 = 0 THEN 'citations' END) AS fields FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0"""


@query
def overridden_views(spark, sf):
    """Views whose meta term and keywords a caller supplies."""
    p = table(spark, sf, "part").select(_string("p_partkey").alias("query_id"), F.lit("Die Frage").alias("query"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), "p_name")).otherwise(" ").alias("meta"), F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand", F.lit(" "), "p_brand")).alias("words"))
    made = text.query_views(p.select("query_id", "query")).join(p.select("query_id", "meta", "words"), "query_id")
    return text.with_overrides(made, "meta", "words").select("query_id", "meta_searchterm", "keywords")


SQL["overridden_views"] = """
SELECT p_partkey::VARCHAR AS query_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Die Frage; Die Frage' END AS meta_searchterm, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'frage' END AS keywords FROM part"""


@query
def answers_and_prompts(spark, sf):
    """Evidence documents as an escaped prompt, and answers checked against what the gate accepted."""
    from .catalog import _decided

    decided = _decided(spark, sf)
    ranked = gate.verifier_order(tables.candidates(spark, sf))
    evidence = gate.evidence_documents(ranked, decided.where("accepted"), 2)
    documents = table(spark, sf, "orders").select(_string("o_orderkey").alias("doc_ref"), F.concat(F.lit("<"), "o_orderpriority", F.lit(">")).alias("text"))
    prompts = online.evidence_prompt(evidence, documents).select("query_id", F.sha2(F.col("prompt").cast("binary"), 256).alias("found"))
    vocabulary = spark.range(1, 41).select(F.concat(F.lit("Art. "), _string("id"), F.lit(" OR")).alias("citation"))
    answers = table(spark, sf, "customer").select(_string("c_custkey").alias("query_id"), F.concat(F.lit("Siehe Art. "), (F.col("c_custkey") % 44 + 1).cast("string"), F.lit(" OR.")).alias("answer"))
    checked = online.check_answers(answers, decided, vocabulary).select(F.col("answer_id").alias("query_id"), F.coalesce("problem", F.lit("ok")).alias("found"))
    return prompts.unionByName(checked)


SQL["answers_and_prompts"] = f"""WITH {_DECIDED},
acc AS (SELECT query_id, list(citation) AS accepted FROM decided WHERE accepted GROUP BY 1),
m AS (SELECT o.*, coalesce(list_has_any(o.citations, a.accepted), false) AS good FROM ordered o LEFT JOIN acc a USING (query_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM (SELECT *, bool_or(good) OVER (PARTITION BY query_id) AS any_good FROM m) WHERE good OR NOT any_good),
p AS (SELECT query_id, string_agg('<document ref="' || doc_ref || '">&lt;' || o_orderpriority || '&gt;</document>', chr(10) ORDER BY position) AS prompt FROM e JOIN orders ON o_orderkey::VARCHAR = doc_ref WHERE place <= 2 GROUP BY 1),
ans AS (SELECT c_custkey::VARCHAR AS query_id, c_custkey % 44 + 1 AS a FROM customer)
SELECT query_id, sha256(prompt) AS found FROM p
UNION ALL SELECT query_id, CASE WHEN a > 40 THEN 'outside vocabulary' WHEN NOT coalesce(list_contains(accepted, 'Art. ' || a || ' OR'), false) THEN 'not accepted' ELSE 'ok' END FROM ans LEFT JOIN acc USING (query_id)"""


@query
def unique_and_missing(spark, sf):
    """Prepared rows restricted to scored identities, and a stage's input checked before it runs."""
    prepared = tables.candidates(spark, sf).select("query_id", "doc_ref")
    scored = prepared.where(F.col("doc_ref").cast("long") % 4 > 0)
    kept, broken = integrity.complete_join(prepared, scored, ["query_id", "doc_ref"])
    numbers = verify.strict_number(F.parse_json(F.when(F.col("doc_ref").cast("long") % 3 == 0, F.concat(F.lit('"'), "doc_ref", F.lit('"'))).otherwise(F.col("doc_ref"))))
    counted = kept.groupBy(F.when(numbers, "number").otherwise("text").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n")))


SQL["unique_and_missing"] = """
WITH p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT CASE WHEN k % 3 = 0 THEN 'text' ELSE 'number' END AS rule, count(*) AS n FROM p WHERE k % 4 > 0 GROUP BY 1 UNION ALL SELECT 'right side is missing', count(*) FROM p WHERE k % 4 = 0"""
