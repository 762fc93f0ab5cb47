"""The evidence pipeline's inputs made of the test tables: whole tables, deterministic rules.

A customer is a query, an order a candidate document ranked by its key, its
line items cite articles; the score is a tenth of a number below 101.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion
from ..session import dealt as dealt, shared_dir

#: Components of the five slices of a vector that serve as views: (first, length).
SLICES = ((1, 13), (14, 13), (27, 13), (40, 13), (53, 12))
#: Rows whose id this divides are queries of searches.
EVERY = 100


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/lexispark-{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder whose rows are no longer read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def citation(part: str = "l_partkey") -> Column:
    return F.concat(F.lit("Art. "), (F.col(part) % 40 + 1).cast("string"), F.lit(" OR"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_ref, rank, score, citations) of all orders."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    cited = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(citation())).alias("citations"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = orders.select(F.col("o_custkey").cast("string").alias("query_id"), F.col("o_orderkey"), rank.alias("rank"), ((F.col("o_orderkey") * 7919) % 101 / F.lit(10.0)).alias("score"))
    return rows.join(cited, rows["o_orderkey"] == cited["l_orderkey"]).select("query_id", F.col("o_orderkey").cast("string").alias("doc_ref"), "rank", "score", "citations")


def candidates_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``candidates`` written and read again, for plans that need them several times."""
    path = scratch(spark, "candidates")
    candidates(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def support(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """Support of citations by the first five orders of each customer."""
    first = (candidates(spark, sf_dir) if own is None else own).where(F.col("rank") <= 5)
    return first.select("query_id", F.explode("citations").alias("citation")).groupBy("query_id", "citation").agg(F.count(F.lit(1)).alias("support"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, gold): articles that a customer's returned line items cite."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return items.groupBy(F.col("o_custkey").cast("string").alias("query_id")).agg(F.array_sort(F.collect_set(citation())).alias("gold"))


def view_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, idx, v): each embedding's five slices as views."""
    views = F.array(*[F.struct(F.lit(name).alias("field"), F.slice("embedding", a, n).cast("array<double>").alias("v")) for name, (a, n) in zip(fusion.VIEWS, SLICES, strict=True)])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.explode(views).alias("x")).select("x.field", "idx", "x.v")


def view_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, source, position, doc_ref, score): the k nearest rows of every query and view."""
    index = view_vectors(spark, sf_dir)
    queries = index.where(F.col("idx") % EVERY == 0).select(F.col("idx").alias("query_id"), "field", F.col("v").alias("q"))
    return fusion.vector_top_k(queries, index, k).select("query_id", F.col("field").alias("source"), "position", F.col("idx").alias("doc_ref"), "score")
