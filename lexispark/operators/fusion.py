"""Exact vector top-k and weighted reciprocal-rank fusion over long tables.

hits: (query_id, source, position, doc_ref[, score]), one row for each listed
document. Order of ties is total everywhere; sums run in the sources' canonical
order, so results are the same to the bit on any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: Canonical order of the five views, their weights, and the fusion's constants.
VIEWS = ("normal_query", "meta_searchterm", "keywords", "fulltext", "citations")
VIEW_WEIGHTS = {"normal_query": 0.40, "meta_searchterm": 1.25, "keywords": 0.85, "fulltext": 1.35, "citations": 0.15}
ONLINE_WEIGHTS = {"dense": 0.7, "bm25": 0.3}
RRF_K, PER_VIEW, FUSED = 60, 1_000, 1_000
#: Bytes of query vectors and heaps of a deal, of which a cut takes six times as much (columns, an order, sorted copies, rows that
#: wait); rows of a heap that count towards it.
QUERY_BYTES, HEAP_ROWS = 10 << 20, 1 << 20
#: Queries and index rows that are scored together: a block of 2 MB.
QUERY_BLOCK, INDEX_BLOCK = 256, 1_024


def check_weights(weights: Mapping[str, float], k: int, limit: int | None = None) -> None:
    if k <= 0 or (limit is not None and limit <= 0):
        raise ValueError("k and limit must be positive")
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")


class Heaps:
    """The k best rows of each of many queries, by (score, idx) descending; blocks of an index go in one after the other.

    Candidates wait until there are half as many as the heaps hold, then all queries
    are cut back to k at once. A row that is worse than a query's k-th so far is
    not kept, so a block adds few rows once the heaps are full.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.least = np.full(len(queries), -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.held = 0, 0

    def add(self, idx: np.ndarray, vectors: np.ndarray) -> None:
        """Scores are sums of products in the order of the components, so they do not depend on blocks."""
        for at in range(0, len(self.queries), QUERY_BLOCK):
            block = self.queries[at : at + QUERY_BLOCK]
            scores = np.zeros((len(block), len(idx)))
            for j in range(vectors.shape[1]):
                scores += block[:, j, None] * vectors[None, :, j]
            query, row = np.nonzero(scores >= self.least[at : at + QUERY_BLOCK, None])
            self.parts.append((query + at, scores[query, row], idx[row]))
            self.waiting += len(query)
            if self.waiting > max(self.held // 2, 1 << 16):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, idx) of what is held."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        query, score, idx = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.lexsort((-idx, -score, query))
        query, score, idx = query[order], score[order], idx[order]
        first = np.searchsorted(query, np.arange(len(self.queries)))
        place = np.arange(len(query)) - first[query]
        full = np.flatnonzero(place == self.k - 1)
        self.least[query[full]] = score[full]
        keep = place < self.k
        self.parts = [(query[keep], score[keep], idx[keep])]
        self.held, self.waiting = int(keep.sum()), 0
        return self.parts[0]


def _packed(queries: DataFrame, on: Sequence[str]) -> dict[tuple, tuple[pa.Array, np.ndarray]]:
    """(ids, matrix) of a checked number of queries, by their values of ``on`` and number of components."""
    rows = queries.toArrow().combine_chunks()
    groups: dict[tuple, list[int]] = {}
    sizes = pa.compute.list_value_length(rows["q"]).to_pylist()
    for i, key in enumerate(zip(*[rows[c].to_pylist() for c in on], sizes, strict=True)):
        if key[-1] and None not in key:
            groups.setdefault(key, []).append(i)
    out = {}
    for key, at in groups.items():
        some = rows.take(pa.array(at))
        matrix = pa.compute.list_flatten(some["q"]).to_numpy().astype(np.float64).reshape(len(at), key[-1])
        ids = some["query_id"].combine_chunks()
        out[key] = (ids, matrix)
    return out


def vector_top_k(queries: DataFrame, index: DataFrame, k: int, on: Sequence[str] = ("field",), block: int = QUERY_BYTES) -> DataFrame:
    """(query_id, *on, position, idx, score): the k index rows with the largest inner product.

    queries: (query_id, *on, q); index: (idx, *on, v). Each task keeps a heap of
    k rows a query over its part of the index, block by block, and gives those
    on; a window of at most tasks x k rows a query merges them. So the rows that
    leave a task do not grow with the index. Queries are sent to the tasks in
    deals of at most ``block`` bytes, their heaps included, which a sum over
    their sizes settles; more deals mean more passes. Ties go to the larger idx.
    Vectors that are null, hold a null or have another number of components than
    a query are no hits, nor are scores that are no number.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = index.sparkSession
    ship(spark)
    keyed = queries.select("query_id", *on, F.col("q").cast("array<double>").alias("q"))
    held = keyed.agg(F.sum(F.size("q") * 8 + 64 + F.lit(min(k, HEAP_ROWS) * 16))).first()[0] or 0
    deals = max(1, -(-held // block))
    kinds = {f.name: f.dataType for f in [*keyed.schema.fields, *index.schema.fields]}
    out = T.StructType([T.StructField("query_id", kinds["query_id"]), *[T.StructField(c, kinds[c]) for c in on], T.StructField("idx", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)
    rows = index.select(F.col("idx").cast("long").alias("idx"), *on, F.col("v").cast("array<double>").alias("v"))
    parts = []
    for deal in range(deals):
        own = keyed if deals == 1 else keyed.where(F.pmod(F.xxhash64("query_id", *on), F.lit(deals)) == deal)
        sent = spark.sparkContext.broadcast(_packed(own, on))
        parts.append(rows.mapInArrow(_heaped(sent, k, len(on), schema), out))
    best = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("query_id", *on).orderBy(F.desc("score"), F.desc("idx")))
    return best.withColumn("position", place).where(F.col("position") <= k).select("query_id", *on, "position", F.col("idx").cast(kinds["idx"]).alias("idx"), "score")


def _heaped(sent, k: int, width: int, schema: pa.Schema):
    """A task: its part of the index through the heaps of the queries that were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {key: Heaps(matrix, k) for key, (_, matrix) in sent.value.items()}
        for batch in batches:
            vectors = batch.column(width + 1)
            sizes = pa.compute.list_value_length(vectors).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(c + 1).to_pylist() for c in range(width)], sizes, strict=True)):
                if key in heaps:
                    groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                some = batch.take(pa.array(at))
                numbers = pa.compute.list_flatten(some.column(width + 1)).to_numpy(zero_copy_only=False).reshape(len(at), key[-1])
                whole = ~np.isnan(numbers).any(axis=1)
                idx = some.column(0).to_numpy(zero_copy_only=False)
                for b in range(0, len(at), INDEX_BLOCK):
                    use = whole[b : b + INDEX_BLOCK]
                    heaps[key].add(idx[b : b + INDEX_BLOCK][use], numbers[b : b + INDEX_BLOCK][use])
        for key, heap in heaps.items():
            query, score, idx = heap.cut()
            ids = sent.value[key][0].take(pa.array(query))
            for at in range(0, len(query), 1 << 16):
                part = slice(at, at + (1 << 16))
                n = len(query[part])
                yield pa.RecordBatch.from_arrays([ids[part], *[pa.array([key[c]] * n, schema.field(c + 1).type) for c in range(width)], pa.array(idx[part]), pa.array(score[part])], schema=schema)

    return run


def ranked_by_score(scores: DataFrame, by: Sequence[str], tie: Column, k: int) -> DataFrame:
    """Positions 1..k by descending score within ``by``."""
    return scores.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), tie))).where(F.col("position") <= k)


def reciprocal_scores(ranking: DataFrame) -> DataFrame:
    """Scores 1 / position, for rankings that carry none."""
    return ranking.withColumn("score", F.lit(1.0) / F.col("position"))


def weighted_rrf(hits: DataFrame, weights: Mapping[str, float], k: int = RRF_K, limit: int | None = FUSED, also: Mapping[str, Column] | None = None) -> DataFrame:
    """(query_id, doc_ref, fusion_score, rank, sources) by the sum of weight / (k + position).

    A document counts once a source, at its first position; positions count
    repeats. Equal scores keep the order in which documents are met: sources by
    name, then position. The limit reaches the ranking window, so only the
    leading rows of each query are sorted. ``also``: further aggregates of a
    document's hits, by name.
    """
    also = also or {}
    check_weights(weights, k, limit)
    names = sorted(weights)
    first = hits.where(F.col("source").isin(names)).groupBy("query_id", "doc_ref").agg(*[F.min(F.when(F.col("source") == s, F.col("position"))).alias(f"__{i}") for i, s in enumerate(names)], *[c.alias(n) for n, c in also.items()])
    # The sum starts at 0 and follows the order in which sources are listed.
    order = [names.index(s) for s in weights]
    total = F.lit(0.0)
    for i in order:
        total = total + F.coalesce(F.lit(float(weights[names[i]])) / (F.lit(k) + F.col(f"__{i}")), F.lit(0.0))
    met = F.array_min(F.array(*[F.when(F.col(f"__{i}").isNotNull(), F.struct(F.lit(i).alias("s"), F.col(f"__{i}").alias("p"))) for i in range(len(names))]))
    sources = F.filter(F.array(*[F.when(F.col(f"__{i}").isNotNull(), F.lit(s)) for i, s in enumerate(names)]), lambda s: s.isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), "__met"))
    ranked = first.select("query_id", "doc_ref", total.alias("fusion_score"), met.alias("__met"), sources.alias("sources"), *also).withColumn("rank", rank)
    return (ranked.where(F.col("rank") <= limit) if limit else ranked).drop("__met")


def fuse_views(hits: DataFrame, weights: Mapping[str, float] = VIEW_WEIGHTS, k: int = RRF_K, limit: int = FUSED, also: Mapping[str, Column] | None = None) -> DataFrame:
    """Fusion of exactly the five views, summed in their canonical order."""
    if set(weights) != set(VIEWS):
        raise ValueError(f"weights must name exactly {', '.join(VIEWS)}")
    return weighted_rrf(hits, {v: weights[v] for v in VIEWS}, k, limit, also)


def _placed(order: Sequence[str]) -> Column:
    """A hit and the place of its source, by which hits are sorted."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    return F.struct(place.alias("o"), F.col("source").alias("field"), F.col("position").cast("int").alias("rank"), F.col("score").alias("score"))


def _details(placed: Column) -> Column:
    return F.transform(placed, lambda h: F.struct(h["field"].alias("field"), h["rank"].alias("rank"), h["score"].alias("score")))


def packed_hits(order: Sequence[str] = VIEWS) -> Column:
    """``hit_details`` as an aggregate of a document's hits."""
    return _details(F.array_sort(F.collect_list(_placed(order))))


def hit_details(fused: DataFrame, hits: DataFrame, order: Sequence[str] = VIEWS) -> DataFrame:
    """Adds hits: array of (field, rank, score) of each fused document in the order of the sources."""
    own = hits.select("query_id", "doc_ref", _placed(order).alias("h"))
    packed = own.join(fused.select("query_id", "doc_ref"), ["query_id", "doc_ref"]).groupBy("query_id", "doc_ref").agg(F.array_sort(F.collect_list("h")).alias("__h"))
    return fused.join(packed, ["query_id", "doc_ref"], "left").withColumn("hits", _details(F.col("__h"))).drop("__h")


def saved_ranking_violations(rankings: DataFrame, queries: DataFrame, fields: Sequence[str] = VIEWS) -> DataFrame:
    """Rules of saved rankings (query_id, field, rank, doc_id, metadata as JSON text)."""
    from .integrity import all_of, missing, ranks, record_rules

    # Flags of a query's fields combine before the exchange; a query without rankings has none.
    found = rankings.groupBy("query_id").agg(*[F.bool_or(F.col("field") == f).alias(f"__{i}") for i, f in enumerate(fields)])
    lacking = F.filter(F.array(*[F.when(~F.coalesce(f"__{i}", F.lit(False)), F.lit(f)) for i, f in enumerate(fields)]), lambda f: f.isNotNull())
    empty = queries.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.explode(lacking).alias("field"))
    metadata = rankings.groupBy("doc_id").agg(F.count_distinct(F.coalesce("metadata", F.lit("{}"))).alias("n")).where("n > 1")
    return all_of(
        missing(rankings, queries, ["query_id"], "known query"),
        record_rules(rankings, ["query_id", "field"], {"known field": F.col("field").isin(list(fields)), "positive rank": F.col("rank") > 0}),
        ranks(rankings, ["query_id", "field"], "rank"),
        empty.select(F.lit("no empty ranking").alias("rule"), F.concat_ws("::", F.col("query_id").cast("string"), "field").alias("key"), F.lit("no partner").alias("message")),
        metadata.select(F.lit("one metadata object").alias("rule"), F.col("doc_id").alias("key"), F.lit("metadata differ").alias("message")),
    )
