"""Candidates: references, identities, corpus rows by locator, verifier input and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, clean, render_document

REFERENCE = r"^(.+\.parquet):rg([0-9]+):row([0-9]+)$"


def locator(file: Column, group: Column, row: Column) -> Column:
    return F.concat(basename(file), F.lit(":rg"), group.cast("string"), F.lit(":row"), row.cast("string"))


def index_reference(doc_id: Column, file: Column, group: Column, row: Column) -> Column:
    """Reference of an index row: its locator, or else its id."""
    return F.coalesce(locator(file, group, row), F.nullif(F.trim(doc_id), F.lit("")))


def document_reference(doc_id: Column, file: Column, group: Column, row: Column) -> Column:
    """Reference of a candidate: its id, or else its locator."""
    return F.coalesce(F.nullif(F.trim(doc_id), F.lit("")), locator(file, group, row))


def parse_reference(reference: Column) -> Column:
    """struct(file, row_group, row) of a reference that is a locator, else null."""
    part = lambda i: F.regexp_extract(reference, REFERENCE, i)
    return F.when(F.rlike(reference, F.lit(REFERENCE)), F.struct(part(1).alias("file"), part(2).cast("long").alias("row_group"), part(3).cast("long").alias("row")))


def candidate_id(query_id: Column, explicit: Column, global_idx: Column, doc_id: Column) -> Column:
    """An explicit id that starts with the query's, or one made of the index row, or of the document."""
    lead = F.concat(query_id, F.lit("::"))
    return (
        F.when(F.startswith(explicit, lead), explicit)
        .when(global_idx.isNotNull(), F.concat(lead, F.lit("gi"), global_idx.cast("string")))
        .otherwise(F.concat(lead, doc_id))
    )


def legacy_id(query_id: Column, rank: Column, global_idx: Column) -> Column:
    return F.concat_ws("::", query_id, F.concat(F.lit("rank"), rank.cast("string")), F.concat(F.lit("gi"), global_idx.cast("string")))


def top_by_rank(candidates: DataFrame, n: int, tie: str) -> DataFrame:
    """The first n candidates of each query by rank; 0 and missing come last, ties in input order (``tie``)."""
    rank = F.coalesce(F.nullif(F.col("rank"), F.lit(0)), F.lit(10**9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(rank, tie))
    return candidates.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def row_group_offsets(spark, paths: list[str]) -> DataFrame:
    """(file, row_group, first_row, rows) from the footers of Parquet files."""
    from ..sources.rowgroups import footers

    return footers(spark, paths)


def materialize(references: DataFrame, corpus: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Corpus rows of distinct references (doc_ref, file, row_group, row), by file and row number.

    ``corpus`` is a Parquet scan. A row group's row becomes a file's row through
    the footers' offsets; rows outside a group find no partner. Only referenced
    rows are kept, whatever the corpus's size: the join's smaller side is the
    references, which Spark broadcasts if they are few.
    """
    wanted = references.dropDuplicates(["doc_ref"])
    if offsets is not None:
        wanted = wanted.join(offsets, ["file", "row_group"]).where(F.col("row") < F.col("rows")).withColumn("row", F.col("first_row") + F.col("row"))
    rows = corpus.select("*", basename(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__row"))
    wanted = wanted.select("doc_ref", F.col("file").alias("__file"), F.col("row").alias("__row"))
    return rows.join(wanted, ["__file", "__row"]).drop("__file", "__row")


def rendered(rows: DataFrame) -> DataFrame:
    """doc_ref, full_document_text and lengths of materialised rows."""
    text = render_document()
    return rows.select("doc_ref", text.alias("full_document_text")).withColumn("text_chars", F.length("full_document_text"))


def prepare(queries: DataFrame, candidates: DataFrame, documents: DataFrame, summary: DataFrame | None, n: int) -> DataFrame:
    """Verifier input: top-n candidates with their query, optional views and document text.

    queries: (query_id, query, ordinal); candidates: (query_id, rank, doc_id,
    global_idx, ordinal, ...); documents: (doc_id, full_document_text);
    summary: (query_id, query, meta_query, keywords_query) or None.
    """
    top = top_by_rank(candidates, n, "ordinal")
    own = top.drop("ordinal").join(queries.select("query_id", "query", F.col("ordinal").alias("query_ordinal")), "query_id").join(documents.select("doc_id", F.col("full_document_text").alias("document_text")), "doc_id")
    if summary is None:
        own = own.withColumns({"meta_query": F.lit(""), "keywords_query": F.lit("")})
    else:
        own = own.join(summary.select("query_id", "meta_query", "keywords_query"), "query_id", "left").fillna("", ["meta_query", "keywords_query"])
    explicit = F.col("candidate_id") if "candidate_id" in own.columns else F.lit(None).cast("string")
    return own.withColumn("candidate_id", candidate_id(F.col("query_id"), explicit, F.col("global_idx"), F.col("doc_id")))


def summary_mismatches(queries: DataFrame, summary: DataFrame) -> DataFrame:
    """Violations: queries whose text in the summary differs by more than white space."""
    both = queries.select("query_id", F.col("query").alias("a")).join(summary.select("query_id", F.col("query").alias("b")), "query_id")
    return both.where(clean(F.col("a")) != clean(F.col("b"))).select(F.lit("query text").alias("rule"), F.col("query_id").alias("key"), F.lit("texts differ").alias("message"))


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Adds batch (from 0) and slot: chunks of ``size`` within each query by rank."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "candidate_id")) - 1
    return rows.withColumn("__place", place).withColumn("batch", F.floor(F.col("__place") / size).cast("int")).withColumn("slot", (F.col("__place") % size).cast("int")).drop("__place")


def resolve_query(requests: DataFrame, queries: DataFrame) -> DataFrame:
    """(request_id, query_id) of requests that name a query whose text equals, or whose text is exactly one query's."""
    norm = lambda c: clean(F.col(c))
    known = queries.select(F.col("query_id").alias("__id"), norm("query").alias("__text"))
    asked = requests.select("request_id", "query_id", norm("query").alias("__text"))
    named = asked.where(F.col("query_id").isNotNull()).join(known, (F.col("query_id") == F.col("__id")) & (asked["__text"] == known["__text"])).select("request_id", F.col("__id").alias("query_id"))
    free = asked.where(F.col("query_id").isNull()).drop("query_id").join(known, "__text").groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("query_id")).where("n = 1")
    return named.unionByName(free.select("request_id", "query_id"))


def public_hit(text: Column, score: Column) -> list[Column]:
    """Snippet and rounded score for display."""
    return [F.substring(text, 1, 700).alias("snippet"), F.round(score, 8).alias("score")]
