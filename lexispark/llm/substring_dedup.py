"""Substring deduplication by seed and extend over winnowed anchors.

Seeds: the anchor of a window of LENGTH words is the one of its GRAM-word
sequences with the least hash (the first of equals), so equal windows have
equal anchors. Anchors that occur once in the corpus cannot belong to a repeat;
those that occur twice or more, in one document or several, are the seeds.

Extend: each seed is extended to both sides over every window whose anchor it
is, that is as far left and right as a repeat of the threshold length around
it can reach. A window is matched by the 128-bit BLAKE2b digest of its words'
bytes, which no two windows are known to share, whatever was done to make
them; anchors' hashes choose candidates only. Matched windows that overlap
chain to maximal repeats; all their words but the earliest occurrence's go.
Repeats within a document are matched where it is read.

Only hashes are dealt out: first the anchors (8 bytes for each eighth word or
so), then digests and places of seeded windows, in ROUNDS parts of the
digests' range so that disks hold one part's exchanges at a time. Counts and
minima are combined before the shuffle; joins on hot seeds or windows are plain
joins whose skewed partitions Spark splits. What is gathered belongs to one
row's text. Rows are told apart by file and row number.

Defined results: a null text has no words; order is by (doc_id, start) alone,
so rows that share a doc_id (null is one, before all others) take nothing from
each other, only from smaller ids and themselves; texts shorter than the
threshold lose nothing; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import drop, located, maybe_in, release, ship, tidied, written

LENGTH, GRAM = 20, 8
#: Parts of the digests' range; windows that are digested together.
ROUNDS, BLOCK = 3, 65_536
_KEY = ["part", "at"]


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows in order: anchor hash, anchor place; and where each text's windows begin and end."""
    low, high, at = wordhash.codes(texts)
    n = np.maximum(np.diff(at) - length + 1, 0)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), bounds
    starts = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - at[:-1], n)
    short = wordhash.grams(wordhash.hashes(low, high), gram)
    place = np.lib.stride_tricks.sliding_window_view(short, length - gram + 1)
    anchor = np.empty(len(place), np.int64)
    for i in range(0, len(place), BLOCK):
        anchor[i : i + BLOCK] = place[i : i + BLOCK].argmin(axis=1)
    anchor += np.arange(len(place))
    anchor = anchor[starts]
    return short[anchor], anchor, bounds


def spread(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each word followed by one space, and where each word begins (and the last one's end)."""
    data = np.frombuffer(text + b"\n", np.uint8)
    starts, ends = wordhash.edges(data)
    size = ends - starts + 1
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    word = np.zeros(len(data) + 1, np.int8)
    np.add.at(word, starts, 1)
    np.add.at(word, ends + 1, -1)
    out = data[np.cumsum(word[:-1]) > 0].copy()
    out[at[1:] - 1] = 32
    return out, at


def digests(words: np.ndarray, at: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """128-bit digests, two numbers each, of the windows that begin at these words."""
    out = np.empty((len(windows), 2), np.int64)
    make = hashlib.blake2b
    for i in range(0, len(windows), BLOCK):
        some = windows[i : i + BLOCK]
        first = int(at[some[0]])
        raw = words[first : at[some[-1] + length]].tobytes()
        spans = zip((at[some] - first).tolist(), (at[some + length] - first).tolist(), strict=True)
        out[i : i + BLOCK] = np.frombuffer(b"".join([make(raw[a:b], digest_size=16).digest() for a, b in spans]), np.int64).reshape(-1, 2)
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The columns as they are; the last, the text, as bytes."""
    lists = [c.to_pylist() for c in batch.columns[:-1]]
    texts = batch.columns[-1].cast(pa.binary()).to_pylist()
    for row in zip(*lists, texts, strict=True):
        yield (*row[:-1], row[-1] or b"")


@tidied
def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct anchors of each document; one that has several places in it comes twice."""
    for batch in batches:
        for part in wordhash.chunks(_rows(batch)):
            hashes, places, bounds = anchors([r[-1] for r in part])
            out = []
            for i in range(len(part)):
                h, p = hashes[bounds[i] : bounds[i + 1]], places[bounds[i] : bounds[i + 1]]
                own = h[np.flatnonzero(np.diff(p, prepend=-1))]
                values, counts = np.unique(own, return_counts=True)
                out.append(np.concatenate([values, values[counts > 1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=[*_KEY, "anchors"])


def distinct_windows(text: bytes, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests and first places of the distinct windows among these, and the places of those that come again."""
    found = digests(*spread(text), windows)
    order = np.lexsort((windows, found[:, 1], found[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (found[order[1:]] != found[order[:-1]]).any(axis=1)
    return found[order[new]], windows[order[new]], windows[order[~new]]


@tidied
def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and places of each document's seeded windows, and the places of those that repeat in it."""
    numbers, places = pa.list_(pa.int64()), pa.list_(pa.int32())
    for batch in batches:
        for part in wordhash.chunks(_rows(batch)):
            hashes, _, bounds = anchors([r[-1] for r in part])
            out: list[list] = [[], [], [], []]
            for i, row in enumerate(part):
                own = np.flatnonzero(np.isin(hashes[bounds[i] : bounds[i + 1]], np.array(row[3], np.int64).view(np.uint64)))
                found, first, again = distinct_windows(row[-1], own)
                for o, x in zip(out, (found[:, 0], found[:, 1], first.astype(np.int32), again.astype(np.int32)), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[c] for r in part], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.int64()))], *[pa.array(o, k) for o, k in zip(out, (numbers, numbers, places, places), strict=True)]],
                names=[*_KEY, "id", "p1", "p2", "place", "again"],
            )


def kept_words(text: bytes, gone: list[int] | None, length: int = LENGTH) -> tuple[int, int, bytes]:
    """Number of words, of those that go (covered by windows that begin at ``gone``), and the others joined by spaces."""
    words, at = spread(text)
    n = len(at) - 1
    if not gone:
        return n, 0, words[:-1].tobytes()
    edges = np.zeros(n + 1, np.int64)
    starts = np.unique(np.array(gone, np.int64))
    edges[starts] += 1
    edges[starts + length] -= 1
    stay = np.cumsum(edges[:-1]) == 0
    return n, int(n - stay.sum()), words[np.repeat(stay, np.diff(at))][:-1].tobytes()


@tidied
def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        out = []
        for doc_id, gone, text in _rows(batch):
            n, less, rest = kept_words(text, gone)
            out.append((doc_id, n, less, hashlib.sha256(rest).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _order(doc_id: Column | str) -> Column:
    """The id by which documents are ordered; null is before all others."""
    return F.coalesce(doc_id, F.lit(-(2**63)))


def repeats(texts: DataFrame) -> DataFrame:
    """(part, at, gone): where the windows begin that an earlier document has or that the document repeats; from (part, at, id, text)."""
    spark = texts.sparkSession
    ship(spark)
    anchored = written(texts.select(*_KEY, "text").mapInArrow(_anchors, "part long, at long, anchors array<long>").where(F.size("anchors") > 0), "sub-anchors")
    each = anchored.select(*_KEY, F.explode("anchors").alias("anchor"))
    seeds = written(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "sub-seeds")
    release(spark)
    by_row = written(each.join(seeds, "anchor").groupBy(*_KEY).agg(F.collect_set("anchor").alias("anchors")), "sub-seeded")
    drop(anchored, seeds)
    release(spark)
    asked = maybe_in(texts, by_row, _KEY).join(by_row.hint("merge"), _KEY).select(*_KEY, "id", "anchors", "text")
    schema = "part long, at long, id long, p1 array<long>, p2 array<long>, place array<int>, again array<int>"
    prints = written(asked.mapInArrow(_seeded, schema), "sub-prints")
    drop(by_row)
    release(spark)
    parts = [prints.where(F.size("again") > 0).select(*_KEY, F.col("again").alias("gone"))]
    for r in range(ROUNDS):
        rows = prints.select(*_KEY, "id", F.explode(F.arrays_zip("p1", "p2", "place")).alias("w")).select(*_KEY, "id", "w.p1", "w.p2", "w.place").where(F.pmod("p1", F.lit(ROUNDS)) == r)
        firsts = written(rows.groupBy("p1", "p2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("p1", "p2", "first"), "sub-firsts")
        later = rows.join(firsts, ["p1", "p2"]).where("id > first").groupBy(*_KEY).agg(F.collect_list("place").alias("gone"))
        parts.append(written(later, "sub-later"))
        drop(firsts)
        release(spark)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    found = written(every.groupBy(*_KEY).agg(F.flatten(F.collect_list("gone")).alias("gone")), "sub-repeats")
    drop(prints, *parts[1:])
    release(spark)
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = located(docs, "sub-input")
    text = F.col("row").getField("text").cast("string").alias("text")
    doc_id = F.col("row").getField("doc_id").cast("long")
    texts = rows.select(F.xxhash64("file").alias("part"), "at", doc_id.alias("doc_id"), _order(doc_id).alias("id"), text)
    clash = rows.groupBy(F.xxhash64("file").alias("part")).agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a <> b")
    if not clash.isEmpty():
        raise ValueError("two file names share a hash; write the input under other names")
    found = repeats(texts.drop("doc_id"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    some = maybe_in(texts, found, _KEY).join(found.hint("merge"), _KEY, "left").select("doc_id", "gone", "text")
    rest = maybe_in(texts, found, _KEY, other=True).select("doc_id", F.lit(None).cast("array<int>").alias("gone"), "text")
    return some.mapInArrow(_finished, schema).union(rest.mapInArrow(_finished, schema))
