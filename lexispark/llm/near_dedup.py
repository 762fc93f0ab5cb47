"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, stars.

Sketch: a document's distinct shingles are hashed once; the high bits choose
one of BINS bins and the bin keeps its least hash. An empty bin copies a bin
chosen by hashing (bin, attempt) until one is found that was not empty, which
keeps each bin's chance of equality at the Jaccard similarity. BANDS bands of
ROWS bins each give a bucket key; at similarity 0.8 a pair shares no bucket
with probability (1 - 0.8**6)**48 < 5e-7.

Candidates: documents with equal words (by a 128-bit digest of their bytes) are
one node. In each bucket, two centres, the members with the least and the
greatest node, are linked with every member, so pairs grow with the members and
not with their square. As the order is the same in all buckets, a group of near
copies meets few centres. A second round takes the centres away, as they have
met all others of their buckets, and compares in each bucket whose rest is
still in several components all pairs of nodes of different components, in the
first bucket that a pair shares (those of its largest component are dealt out to
meet the others only). So two documents that share a bucket and are
similar enough are always in one component: only a pair that shares no bucket,
and no chain of others, is lost.

Links are confirmed on the words: texts of nodes in candidate pairs are dealt
out, a centre's to blocks of its members, and where a pair meets, shingles get
names that are equal if and only if all their words are. Sizes of sets are
counted from such names too; hashes choose candidates only. Components come
from alternating star operations on the confirmed links.

Bounds: a task holds one centre and about CHUNK bytes of its members, or two
blocks of about BLOCK nodes and WORDS words of a bucket's rest; a bucket of many
documents just below the threshold costs the square of their number.

Defined results: a text without words, or null, has an empty set, is linked
with nothing and is kept; so is a row with a null doc_id, whose component is
null; rows that share a doc_id are told apart by their words, and each is kept
if its component is its doc_id; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import fresh, maybe_in, release, ship, tidied, written
from .graph import components

ROWS, BANDS = 6, 48
BINS = ROWS * BANDS
#: Nodes and words of a block of the second round; shingles that are counted together.
BLOCK, WORDS, COLUMNS = 512, 1_048_576, 4_096
#: Members and words of a block that is compared with one copy of a centre's text.
MEMBERS, MEMBER_WORDS = 256, 262_144
_ODD = 0xD1342543DE82EF95
_MIX = wordhash.mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)
_BAND = wordhash.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_hashes(low: np.ndarray, high: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, from its words' codes."""
    words = wordhash.hashes(low, high)
    shingles = wordhash.grams(words, width)
    out = []
    for i in range(len(at) - 1):
        first, n = at[i], at[i + 1] - at[i]
        if n >= width:
            out.append(np.unique(shingles[first : first + n - width + 1]))
        else:
            out.append(wordhash.grams(words[first : first + n], n) if n else np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation sketches of non-empty sets, one row each."""
    out = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))  # sorted, so a bin's first hash is its least
        out[i, bins[first]] = s[first]
        filled[i, bins[first]] = True
    row, empty = np.nonzero(~filled)
    attempt = 0
    while len(row):
        attempt += 1
        donor = (wordhash.mix(empty.astype(np.uint64) * np.uint64(_ODD) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        good = filled[row, donor]
        out[row[good], empty[good]] = out[row[good], donor[good]]
        row, empty = row[~good], empty[~good]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    return wordhash.mix((sketches.reshape(-1, BANDS, ROWS) * _MIX).sum(axis=2, dtype=np.uint64) ^ _BAND).astype(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The columns as they are; the last, the text, as bytes."""
    lists = [c.to_pylist() for c in batch.columns[:-1]]
    for row in zip(*lists, batch.columns[-1].cast(pa.binary()).to_pylist(), strict=True):
        yield (*row[:-1], row[-1] or b"")


def digests(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A digest of each text's words in their order."""
    both = np.stack([low, high], axis=1)
    return [hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def _sketches(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.chunks(_rows(batch)):
                texts = [r[-1] for r in part]
                low, high, at = wordhash.codes(texts, lower=True)
                sets = shingle_hashes(low, high, at, width)
                keys: list = [None] * len(part)
                use = [i for i, s in enumerate(sets) if len(s)]
                if use:
                    for i, k in zip(use, band_keys(sketch([sets[i] for i in use])), strict=True):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()),
                        pa.array([r[1] for r in part], pa.int64()),
                        pa.array([len(s) for s in wordhash.shingle_names(texts, width)], pa.int64()),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(digests(low, high, at), pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    return tidied(run), "doc_id long, print long, n long, words long, digest binary, keys array<long>"


@tidied
def _of_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) of the rows whose text has the node's words: texts of rows that share its doc_id may differ."""
    for batch in batches:
        for part in wordhash.chunks(_rows(batch)):
            found = digests(*wordhash.codes([r[2] for r in part], lower=True))
            own = [r for r, d in zip(part, found, strict=True) if r[1] == d]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int64()), pa.array([r[2] for r in own], pa.binary())], names=["node", "text"])


def _texts_of(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text as bytes) of some nodes; a node may come more than once, with equal words."""
    ends = written(wanted.distinct().join(nodes.select("node", "doc_id", "digest"), "node"), "near-ends")
    asked = maybe_in(texts, ends, "doc_id").join(ends.hint("merge"), "doc_id").select("node", "digest", "text")
    found = written(asked.mapInArrow(_of_digest, "node long, text binary"), "near-texts")
    release(texts.sparkSession)
    return found


def _confirm(width: int, percent: int):
    """Links (a, b) from rows (centre, block, node, text) in order: a centre's text, then its members'."""

    def close(centres: list[bytes], pairs: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        sets = wordhash.shingle_names([*centres, *[p[3] for p in pairs]], width)
        out = []
        for (place, a, b, _), y in zip(pairs, sets[len(centres) :], strict=True):
            x = sets[place]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: list[bytes] = []
        pairs: list[tuple[int, int, int, bytes]] = []
        now, held = None, 0
        for batch in batches:
            for centre, node, text in _rows(batch):
                if node == centre:
                    if now != centre:
                        now = centre
                        centres.append(text)
                        held += len(text)
                    continue
                pairs.append((len(centres) - 1, centre, node, text))
                held += len(text)
                if held > wordhash.CHUNK:
                    yield close(centres, pairs)
                    centres, pairs = centres[-1:], []
                    held = len(centres[0])
        if pairs:
            yield close(centres, pairs)

    return tidied(run)


def _star_links(texts: DataFrame, nodes: DataFrame, stars: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (a, b) among pairs (centre, node)."""
    held = _texts_of(texts, nodes, stars.select(F.explode(F.array("centre", "node")).alias("node")))
    weighed = stars.join(nodes.select("node", "words"), "node")
    blocks = weighed.groupBy("centre").agg(F.ceil(F.greatest(F.count(F.lit(1)) / MEMBERS, F.sum("words") / MEMBER_WORDS)).cast("int").alias("blocks"))
    blocks = written(blocks, "near-blocks")
    dealt = stars.join(blocks, "centre").select("centre", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
    own = blocks.select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("centre").alias("node"))
    rows = dealt.unionByName(own).join(held, "node").repartition("centre", "block").sortWithinPartitions("centre", "block", F.col("node") != F.col("centre"))
    links = written(rows.select("centre", "node", "text").mapInArrow(_confirm(width, percent), "a long, b long").distinct(), "near-links")
    release(texts.sparkSession)
    return links


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    size = len(sets)
    owner = np.repeat(np.arange(size), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((size, size), np.int64)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((size, COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - at] = 1.0
        out += (held @ held.T).astype(np.int64)
    return out


def _close_pairs(width: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        key, one, two = (table.column(c)[0].as_py() for c in ("key", "one", "two"))
        _, first = np.unique(np.asarray(table.column("node").combine_chunks()), return_index=True)
        table = table.take(pa.array(first))
        get = lambda name: np.asarray(table.column(name).combine_chunks())
        node, component, block, n = get("node"), get("component"), get("block"), get("n")
        keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(-1, BANDS)
        ask = (node[:, None] < node) & (component[:, None] != component)
        if one != two:
            ask &= block[:, None] != block
        ask &= 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)
        met = np.zeros_like(ask)
        chosen = np.zeros_like(ask)
        for b in range(BANDS):
            same = keys[:, b, None] == keys[:, b]
            chosen |= same & ~met & (keys[:, b] == key)[:, None]
            met |= same
        left, right = np.nonzero(ask & chosen)
        if len(left):
            use, at = np.unique(np.concatenate([left, right]), return_inverse=True)
            counts = common_counts(wordhash.shingle_names(table.column("text").take(pa.array(use)).to_pylist(), width))
            common = counts[at[: len(left)], at[len(left) :]]
            close = 100 * common >= percent * (n[left] + n[right] - common)
            left, right = left[close], right[close]
        return pa.table({"a": pa.array(node[left], pa.int64()), "b": pa.array(node[right], pa.int64())})

    return run


def _rest(texts: DataFrame, nodes: DataFrame, members: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame | None:
    """The links (a, b) between components among the members of buckets that no centre is an end of; None without candidates."""
    others = members.where("m > 3 AND node != lo AND node != hi").select("key", "node", "words")
    labelled = written(others.join(found, "node", "left").select("key", "node", "words", F.coalesce("component", "node").alias("component")), "near-members")
    # Nodes of a bucket's largest component need no comparing with each other, only with the others.
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("words").alias("s"))
    largest = F.max(F.struct("m", "s", "component")).alias("top")
    split = sizes.groupBy("key").agg(largest, F.sum("m").alias("m"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("components")).where("components > 1")
    blocks = lambda m, w: F.ceil(F.greatest(m / BLOCK, w / WORDS)).cast("int")
    split = split.select("key", F.col("top.component").alias("major"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("few"), blocks(F.col("top.m"), F.col("top.s")).alias("many"))
    again = written(labelled.join(split, "key"), "near-split")
    if again.isEmpty():
        return None
    held = _texts_of(texts, nodes, again.select("node")).join(nodes.select("node", "keys", "n"), "node")
    minor = F.col("component") != F.col("major")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    dealt = again.withColumn("block", F.when(minor, place("few")).otherwise(F.col("few") + place("many")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(minor, F.col("many")).otherwise(0))))
    dealt = dealt.select("key", "node", "component", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    links = dealt.join(held, "node").groupBy("key", "one", "two").applyInArrow(_close_pairs(width, percent), "a long, b long")
    links = written(links.distinct(), "near-links")
    release(texts.sparkSession)
    return links


def text_print(text: Column) -> Column:
    """What tells rows of one doc_id apart by their texts."""
    return F.xxhash64(text.cast("string"))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _groups(docs, width, percent).drop("print")


def _groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The columns of ``near_groups``, and ``print`` of each row's text."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_print(docs["text"]).alias("print"), docs["text"].cast("string").alias("text"))
    ship(docs.sparkSession)
    run, schema = _sketches(width)
    rows = written(texts.mapInArrow(run, schema), "near-rows")
    linkable = rows.where("n > 0 AND doc_id IS NOT NULL")
    # Rows with one digest have equal words, so the first one's facts are all of theirs.
    same = linkable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("words").alias("words"), F.first("keys").alias("keys"))
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    bands = nodes.select("node", "words", F.explode("keys").alias("key"))
    centres = written(bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("m")).where("m > 1"), "near-centres")
    members = bands.join(centres, "key")
    starred = members.select("node", F.explode(F.array("lo", "hi")).alias("centre")).where("node != centre")
    # A pair of two centres comes once, under the lower one.
    both = F.greatest("node", "centre")
    stars = written(starred.select(F.least("node", "centre").alias("a"), both.alias("b"), F.col("centre")).groupBy("a", "b").agg(F.min("centre").alias("centre")).select("centre", F.when(F.col("a") == F.col("centre"), F.col("b")).otherwise(F.col("a")).alias("node")), "near-pairs")
    release(docs.sparkSession)
    links = _star_links(texts, nodes, stars, width, percent)
    found = written(components(links), "near-components")

    more = _rest(texts, nodes, members, found, width, percent)
    if more is not None and not more.isEmpty():
        found = written(components(links.union(more)), "near-components")

    named = found.join(nodes.select("node", "doc_id", "digest"), "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    labels = written(named.join(least, "component").select("digest", "least"), "near-labels")
    alone = nodes.select("digest", F.col("doc_id").alias("rep")).join(labels, "digest", "left").select("digest", F.coalesce("least", "rep").alias("component_id"))
    own = rows.select("doc_id", "print", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(alone, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return own.select("doc_id", "print", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of near-duplicates only.

    Rows that share a doc_id are decided by their own texts: one that is like
    nothing stays when another one goes.
    """
    name, mark = fresh(docs, "gone", "print")
    gone = written(_groups(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias(name), F.col("print").alias(mark)).distinct(), "near-dropped")
    release(docs.sparkSession)
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[name]) & (text_print(docs["text"]) == gone[mark]), "left_anti")
