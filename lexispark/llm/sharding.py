"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``vnodes`` points on a ring of 65,536 places. A row's place is
taken from the md5 of its doc_id, size and checksum, and it belongs to the next
point clockwise.
Shards are full at their capacity; rows that find a shard full go on
clockwise to the next point whose shard has room. With ``slack`` 0 the
capacities are the row count divided by the shards, so counts differ by one at
most (law ``rows``), and a row leaves its own arc only if its shard is full.

Scale: a count per place (65,536 at most, whatever the input) goes to the
driver, which fills the shards arc by arc; the result returns as a table of one
row per place, small by that bound, and rows are only ranked within their
place. A place that holds a great many rows, as repeated ones share it, is cut
by salts into blocks that are ranked apart. Nothing else is gathered.

Movement: with a ninth shard a ninth of the rows goes to it; as capacities
shrink, some rows more overflow to other points than before (measured in the
tests and stated in the README).

Defined results: a null text has size 1 and crc32 0; a null doc_id is an id
like others; repeated rows are counted each, and which of them gets which slot
goes by place in their table; a row whose text is edited is another row and may
move; very long texts only give their size and checksum; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_bits, written

PLACES = 65_536
VNODES = 128
#: Rows of a place that are ranked together.
BLOCK = 100_000


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """The points of the ring in order: (place, shard); of points at one place the lower shard is first."""
    points = set()
    for shard in range(shards):
        for v in range(vnodes):
            points.add((int(hashlib.md5(f"shard {shard} point {v}".encode()).hexdigest()[:4], 16), shard))
    return sorted(points)


def fill(counts: dict[int, int], shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Segments (place, first rank, end rank, shard, first slot) for the rows counted at each place.

    First every arc's own shard takes what it has room for, then the overflow
    of each arc walks clockwise.
    """
    points = ring(shards, vnodes)
    total = sum(counts.values())
    room = [int((total // shards + (s < total % shards)) * (1 + slack)) for s in range(shards)]
    used = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []
    arcs: list[list[tuple[int, int]]] = [[] for _ in points]
    at = 0
    for place in sorted(counts):
        while at < len(points) and points[at][0] < place:
            at += 1
        arcs[at % len(points)].append((place, counts[place]))

    def take(place: int, first: int, left: int, shard: int) -> int:
        n = min(left, room[shard] - used[shard])
        if n > 0:
            out.append((place, first, first + n, shard, used[shard]))
            used[shard] += n
        return n

    overflow: list[tuple[int, int, int, int]] = []
    for i, arc in enumerate(arcs):
        for place, n in arc:
            got = take(place, 0, n, points[i][1])
            if got < n:
                overflow.append((i, place, got, n))
    for i, place, first, n in overflow:
        step = 1
        while first < n:
            first += take(place, first, n - first, points[(i + step) % len(points)][1])
            step += 1
    return out


def _salted(slim: DataFrame, counts: dict[int, int]) -> dict[int, list[int]]:
    """For places of more than a block of rows, the first rank of each of their salts."""
    block = max(BLOCK, 8 * (sum(counts.values()) // PLACES))
    hot = {p: -(-n // block) for p, n in counts.items() if n > block}
    if not hot:
        return {}
    table = slim.sparkSession.createDataFrame(list(hot.items()), "__place int, __salts int")
    rows = slim.join(F.broadcast(table), "__place").groupBy("__place", _salt().alias("salt")).agg(F.count(F.lit(1)).alias("n")).collect()  # PLACES / 8 rows at most
    out = {p: [0] * (salts + 1) for p, salts in hot.items()}
    for r in rows:
        out[r["__place"]][r["salt"] + 1] = r["n"]
    return {p: list(accumulate(ns))[:-1] for p, ns in out.items()}


def _salt() -> Column:
    return F.pmod(F.xxhash64("__row"), F.col("__salts")).cast("int")


def shard_rows(docs: DataFrame, shards: int = 8, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(docs["text"].cast("string"), F.lit("")), "utf-8")
    facts = docs.select(docs["doc_id"], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32").cast("binary"))
    slim = written(facts.select("*", hex_bits(key, 1, 4).cast("int").alias("__place"), hex_bits(key, 5, 15).alias("__order"), F.monotonically_increasing_id().alias("__row")), "shard-rows")
    counts = {r["__place"]: r["n"] for r in slim.groupBy("__place").agg(F.count(F.lit(1)).alias("n")).collect()}  # PLACES rows at most
    offsets = _salted(slim, counts)
    by_place: dict[int, list[tuple[int, int, int, int]]] = {}
    for place, first, end, shard, slot in fill(counts, shards, vnodes, slack):
        by_place.setdefault(place, []).append((first, end, shard, slot))
    rows = [(p, len(offsets.get(p, [0])), offsets.get(p, [0]), segments) for p, segments in by_place.items()]
    table = spark.createDataFrame(rows, "__place int, __salts int, __offsets array<long>, __segments array<struct<first:long,end:long,shard:int,slot:long>>")
    salted = slim.join(F.broadcast(table.select("__place", "__salts")), "__place").withColumn("__salt", _salt())
    rank = F.row_number().over(Window.partitionBy("__place", "__salt").orderBy("__order", "__row")) - 1
    placed = salted.withColumn("__in", rank.cast("long")).join(F.broadcast(table.drop("__salts")), "__place").withColumn("__rank", F.col("__in") + F.element_at("__offsets", F.col("__salt") + 1))
    own = F.element_at(F.filter("__segments", lambda s: (F.col("__rank") >= s["first"]) & (F.col("__rank") < s["end"])), 1)
    return placed.withColumn("__own", own).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__own.shard").alias("shard"),
        (F.col("__own.slot") + F.col("__rank") - F.col("__own.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
