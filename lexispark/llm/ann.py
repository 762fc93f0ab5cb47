"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are told apart by norm first, in bands of ratio BAND, as one long vector
would else leave no distance between the others. In a band largest inner product
becomes least distance by one more dimension: a vector x gets
sqrt(M**2 - |x|**2), M being the band's greatest norm. A band's centroids, as
many as its share of the rows, come from balanced k-means (a list's size raises
its price) on the distinct vectors of a bounded sample; every vector of the table
is then indexed, in the list of its band's nearest centroid and of up to
REPLICAS - 1 others that are hardly farther (boundary vectors). Vectors longer
than all of the sample have a list of their own, which every query searches.

A query compares itself with all centroids, as the rows have done. A list's reach
is its centroid's inner product with the query and REACH times the spread of its
vectors about the centroid; lists of all bands are searched by falling reach,
``probes`` at most, and those that could not come up to the LEAST nearest
centroids even at PRUNE times their spread are left out. Lists grow with the root
of the table and probes with lists ** 0.6, so the share that is searched falls as
the table grows, at a measured recall (README) that does not. ``exact`` searches
everything, in blocks, for those who need it.

Bounds: the sample is SAMPLE vectors and SAMPLED components at most, centroids
are a quarter of its rows at most and are broadcast; beyond that lists
grow longer. Lists of more than PART components are dealt in parts, queries of a list in blocks
likewise, so no task holds more than a part and a block; each returns its best
k a query. Inner products are summed in order of the components, in double
precision, so equal vectors have equal scores whatever list they are in; a
matrix product, with room for its rounding, says which pairs need that sum.

Defined results: vectors that are null, zero, hold a null or non-finite
component, or have another length than most (ties to the longer) take no part;
rows that share a vec_id are one candidate for each distinct score, and none of
each other; if a query's vec_id is repeated with different vectors, all of them
ask, and their best results together are ranked; fewer than
k candidates give all; texts are not read; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

#: Vectors for each list at least; rows and components of the sample that trains centroids, rounds of training.
LIST, SAMPLE, SAMPLED, ROUNDS = 40, 65_536, 16_777_216, 6
#: Lists that may hold a vector, and how much farther than the nearest they may be.
REPLICAS, CLOSURE = 4, 1.12
#: Lists that a query searches at least; spreads that count towards a list's reach, and that a list must need to be left out.
LEAST, REACH, PRUNE = 16, 3.0, 8.0
#: Greatest norm of a band by its least; share of the sample below which shorter vectors join a band; bands at most.
BAND, REST, BANDS = 1.5, 0.05, 24
#: Components of the vectors of a part and of the queries of a block.
PART = 2_097_152


def lists_of(vectors: int, sample: int, list_size: int = LIST) -> int:
    """Number of lists of a table."""
    return max(1, min(vectors // list_size, int(4 * vectors**0.5), max(1, sample // 4)))


def probes_of(lists: int) -> int:
    """Lists that a query searches at most."""
    return min(lists, max(LEAST, math.ceil(2.2 * lists**0.6)))


def usable(table: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    v = table["embedding"].cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def norms_of(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the further dimension that makes their norms equal."""
    rest = np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1), 0.0)


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Balanced k-means."""
    chance = np.random.default_rng(7)
    lists = min(lists, len(sample))
    c = sample[chance.choice(len(sample), lists, replace=False)].copy()
    load = np.ones(lists)
    for _ in range(rounds):
        owner, total = np.empty(len(sample), np.int64), 0.0
        for i in range(0, len(sample), 1_024):
            d = _squares(sample[i : i + 1_024], c)
            price = d.min(axis=1, keepdims=True) * 0.2
            owner[i : i + 1_024] = (d + price * load).argmin(axis=1)
            total += d.min(axis=1).sum()
        sizes = np.bincount(owner, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, owner, sample)
        full = sizes > 0
        c[full] = sums[full] / sizes[full, None]
        c[~full] = sample[chance.choice(len(sample), (~full).sum())]
        load = 0.5 * load + 0.5 * sizes / max(1.0, sizes.mean())
    return c


def edges(norms: np.ndarray) -> np.ndarray:
    """Greatest norms of the bands, falling; the last band has all that is shorter."""
    out = [norms.max()]
    while len(out) < BANDS and (norms <= out[-1] / BAND).sum() > REST * len(norms):
        out.append(out[-1] / BAND)
    return np.array(out)


def bands_of(norms: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Each vector's band; -1 if it is longer than all bands."""
    return np.searchsorted(-tops, -norms, side="right") - 1


def trained(sample: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greatest norms of the bands; lifted centroids of all bands, their bands, and the spread of their vectors a dimension."""
    sample = np.unique(sample, axis=0)  # copies would be centroids many times
    sample = sample[np.random.default_rng(5).permutation(len(sample))]
    norms = norms_of(sample)
    tops = edges(norms)
    band, dims = bands_of(norms, tops), sample.shape[1]
    parts = []
    for b in range(len(tops)):
        own = sample[band == b]
        if len(own):
            x = lift(own, tops[b])
            c = centroids(x, max(1, round(lists * len(own) / len(sample))))
            near = np.concatenate([_squares(x[i : i + 1_024], c).argmin(axis=1) for i in range(0, len(x), 1_024)])
            sizes = np.bincount(near, minlength=len(c))
            apart = np.bincount(near, ((own - c[near, :dims]) ** 2).sum(axis=1), len(c))
            used = sizes > 0  # so each list has a vector at least
            parts.append((c[used], np.full(used.sum(), b), np.sqrt(apart[used] / sizes[used] / dims)))
    return (tops, *(np.concatenate([p[i] for p in parts]) for i in range(3)))


def reached(q: np.ndarray, c: np.ndarray, spread: np.ndarray, probes: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) of the lists that queries search, k + 1 in any case, as each has a vector; centroids without the further dimension."""
    inner = (q @ c.T) / norms_of(q)[:, None]
    order = nearest(-(inner + REACH * spread), max(probes, k + 1))
    floor = -np.partition(-inner, min(LEAST, len(c)) - 1, axis=1)[:, min(LEAST, len(c)) - 1]
    near = np.take_along_axis(inner + PRUNE * spread, order, axis=1) >= floor[:, None]
    near[:, probes:] = False
    near[:, : k + 1] = True
    row, col = np.nonzero(near)
    return row, order[row, col]


def nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least values of each row, least first, ties to the lower place."""
    k = min(k, d.shape[1])
    use = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(k), (len(d), 1))
    use.sort(axis=1)
    return np.take_along_axis(use, np.argsort(np.take_along_axis(d, use, axis=1), axis=1, kind="stable"), axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > k:
        use = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        use = np.arange(len(scores))
    use = use[np.isfinite(scores[use])]
    return use[np.lexsort((ids[use], -scores[use]))][:k]


def top(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its k best vectors, itself left out, and their inner products summed in order."""
    about = q @ x.T
    other = own[:, None] != ids[None, :]
    about[~other] = -np.inf
    # Twice the most by which two orders of summation can differ.
    room = 8.0 * q.shape[1] * np.finfo(np.float64).eps * norms_of(q)[:, None] * norms_of(x).max()
    floor = np.partition(about, len(ids) - k, axis=1)[:, len(ids) - k, None] - room if len(ids) > k else np.full((len(q), 1), -np.inf)
    row, col = np.nonzero(~(about < floor) & other)
    score = np.zeros(len(row))
    for d in range(q.shape[1]):
        score += q[row, d] * x[col, d]
    ends = np.searchsorted(row, np.arange(len(q) + 1))
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        use = best(ids[col[a:b]], score[a:b], k)
        out.append((col[a:b][use], score[a:b][use]))
    return out


def search(table: DataFrame, queries_every: int = 20, k: int = 20, list_size: int = LIST, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every query."""
    spark = table.sparkSession
    ship(spark)
    rows = written(usable(table), "ann-rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = facts["dims"]
    queries = rows.where(F.col("vec_id") % queries_every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    if exact:
        postings, asked = (x.select(F.lit(0).alias("list"), "*") for x in (rows, queries))
        return _ranked(postings, asked, dims, k)
    sample = min(SAMPLE, max(1, SAMPLED // dims))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()  # SAMPLED components at most
    tops, c, band, spread = trained(_matrix(chosen.column("v"), dims), lists_of(facts["n"], sample, list_size))
    probes = min(len(c), probes or probes_of(len(c)))
    longest = len(c)  # the list of the vectors that are longer than all of the sample
    sent = spark.sparkContext.broadcast((tops, c, band, spread))

    def index(batches):
        tops, c, band, _ = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column(1), dims)
                own = bands_of(norms_of(x), tops)
                rows, lists = [np.flatnonzero(own < 0)], [np.full((own < 0).sum(), longest)]
                for b in np.unique(own[own >= 0]):
                    here = np.flatnonzero(own == b)
                    # The nearest band with centroids, if copies or chance left this one without.
                    filled = band[np.abs(band - b).argmin()]
                    there = np.flatnonzero(band == filled)
                    d = _squares(lift(x[here], tops[filled]), c[there])
                    near = nearest(d, REPLICAS)
                    far = np.take_along_axis(d, near, axis=1)
                    row, col = np.nonzero(far <= far[:, :1] * CLOSURE**2)
                    rows.append(here[row])
                    lists.append(there[near[row, col]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists), pa.int32()), *part.take(pa.array(np.concatenate(rows))).columns], names=["list", "vec_id", "v"])

    def probe(batches):
        _, c, _, spread = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, lists = reached(_matrix(part.column(1), dims), c[:, :dims], spread, probes, k)
                row, lists = np.concatenate([row, np.arange(part.num_rows)]), np.concatenate([lists, np.full(part.num_rows, longest)])
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *part.take(pa.array(row)).columns], names=["list", "query_id", "q"])

    postings = written(rows.mapInArrow(index, "list int, vec_id long, v array<double>"), "ann-lists")
    asked = queries.repartition(spark.sparkContext.defaultParallelism * 4, "query_id")
    asked = written(asked.mapInArrow(probe, "list int, query_id long, q array<double>"), "ann-probes")
    return _ranked(postings, asked, dims, k)


def _ranked(postings: DataFrame, asked: DataFrame, dims: int, k: int) -> DataFrame:
    """The k best of each query among the vectors of its lists."""
    size = max(1, PART // dims)
    parts = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    plan = F.broadcast(written(parts.join(blocks, "list"), "ann-plan"))  # a row for each list
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = postings.join(plan, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), span("blocks").alias("block"), "vec_id", "v")
    right = asked.join(plan, "list").select("list", span("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "q")

    def score(held: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out: list[list] = [[], [], []]
        if held.num_rows and asking.num_rows:
            x, q = _matrix(held.column("v"), dims), _matrix(asking.column("q"), dims)
            ids, own = np.asarray(held.column("vec_id")), np.asarray(asking.column("query_id"))
            for at in range(0, len(q), 64):
                for i, (use, line) in enumerate(top(x, ids, q[at : at + 64], own[at : at + 64], k)):
                    out[0].append(np.full(len(use), own[at + i]))
                    out[1].append(ids[use])
                    out[2].append(line)
        arrays = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.Table.from_arrays([pa.array(arrays[0].astype(np.int64)), pa.array(arrays[1].astype(np.int64)), pa.array(arrays[2].astype(np.float64))], names=names)

    key = ["list", "part", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
