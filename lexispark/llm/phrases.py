"""Phrase collocations by contiguous pattern growth (PrefixSpan with gaps of zero).

Occurrences are counted from short to long, and only what can still be frequent
is looked at. A pass over the texts counts words, a second one pairs of frequent
words, a third one projects the pointers of every frequent pair: the words that
follow an occurrence, as far as neighbouring pairs are frequent and the piece
goes on. Equal projections of a block are one row with a count. Projections are
dealt by their prefix; a task sorts a prefix's pointers and extends the prefix
to the right, depth first, as long as the extension is frequent.

A prefix with more than POINTERS occurrences is too much for a task: its
extensions by one word are counted as a grouped sum, and the longer prefixes
are the units instead, up to the longest phrase. So no prefix, however common,
meets in one task.

A word is a 64-bit hash of its language and of its exact 128-bit code; the
vocabulary, counted by word, shows whether two words share a hash, and then
everything is done again with another seed, so counts are exact. Filters that
tasks get are bitmaps of a fixed size that let too much through, never too
little. Exact quotients: products of counts are decimals of 38 digits.

Defined results: a null text has no words; a null lang is ``und``; equal scores
go by count, then by phrase; repeated rows count each time; texts are cut at
the ends of pieces only, so a task holds about BLOCK bytes or one longer piece;
doc_id and extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .common import drop, maybe_in, release, ship, tidied, written
from .periodic import ragged

#: Most words of a phrase, least occurrences, rows of a language, and bytes of text that are counted together.
LONGEST, AT_LEAST, TOP, BLOCK = 5, 100, 2_000, 4 << 20
#: Most occurrences of a prefix that one task extends.
POINTERS = 50_000
#: Parts of the pairs, by their first word, that are counted one after the other, so that disks hold one part's exchange.
ROUNDS = 2
#: Bits of a filter: FILTER_ROWS rows of 4 KB, whatever the corpus.
FILTER_ROWS, _BITS = 1_024, 32_768
_PLACES = FILTER_ROWS * _BITS
_IDS = [f"h{i}" for i in range(LONGEST)]
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, pieces): lower-cased texts with a line feed at the end of each piece, about BLOCK bytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            data = (text.as_py() or b"").lower().translate(_CUTS)
            at = 0
            while len(data) - at > BLOCK:
                end = max(data.rfind(b"\n", at, at + BLOCK), 0) or data.find(b"\n", at + BLOCK)
                if end < 0:
                    break
                yield lang, data[at : end + 1]
                at = end + 1
            held.setdefault(lang, []).append(data[at:] + b"\n")
            size += len(data) - at
            if size > BLOCK:
                for k, v in held.items():
                    yield k, b"".join(v)
                held, size = {}, 0
    for k, v in held.items():
        yield k, b"".join(v)


def _words(lang: str, block: bytes, seed: int) -> tuple[np.ndarray, ...]:
    """Of each word of a block: hash, both halves of its code, begin, and the number of its piece."""
    data = np.frombuffer(block, np.uint8)
    low, high, starts = wordhash._codes(data)
    salt = np.uint64(int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little"))
    hashes = wordhash.pair(wordhash.mix(low ^ salt), wordhash.mix(high + salt))
    hashes[hashes == 0] = 1
    return hashes, low, high, starts, np.searchsorted(np.flatnonzero(data == 10), starts)


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows at which each distinct key is found first, and how many rows have it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    at = np.flatnonzero(new)
    return order[at], np.diff(at, append=len(order))


def _vocabulary(seed: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches):
            hashes, low, high, starts, _ = _words(lang, block, seed)
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = False
            for x in (hashes, low, high):
                new[1:] |= x[order[1:]] != x[order[:-1]]
            at = np.flatnonzero(new)
            first, n = order[at], np.diff(at, append=len(order))
            data = np.frombuffer(block, np.uint8)
            begins, ends = wordhash.edges(data)
            sizes = (ends - begins)[first]
            offsets = np.zeros(len(first) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[ragged(begins[first], sizes)]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array([lang] * len(first), pa.string()), words, pa.array(n, pa.int64())], names=["hash", "lang", "word", "n"])

    return run


def bitmap(places: DataFrame) -> np.ndarray:
    """A filter of fixed size over the places (0 to its number of bits) of one column; at most FILTER_ROWS rows reach the driver."""
    p = F.col(places.columns[0])
    rows = places.groupBy((p / _BITS).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.pmod(p, F.lit(_BITS))).alias("bits")).collect()
    out = np.zeros((FILTER_ROWS, _BITS // 8), np.uint8)
    for r in rows:
        out[r["b"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _in(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _word_place(a: np.ndarray) -> np.ndarray:
    return (a & np.uint64(_PLACES - 1)).astype(np.int64)


def _pair_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a ^ (b >> np.uint64(17))) & np.uint64(_PLACES - 1)).astype(np.int64)


def _joined(hashes: np.ndarray, piece: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each word whether it and the next one, of the same piece, may be frequent."""
    may = _in(words, _word_place(hashes))
    out = np.zeros(len(hashes), bool)
    out[:-1] = may[1:] & may[:-1] & (piece[1:] == piece[:-1])
    return out


def _pairs(seed: int, words, part: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches):
            hashes, _, _, _, piece = _words(lang, block, seed)
            at = np.flatnonzero(_joined(hashes, piece, words.value) & (hashes % np.uint64(ROUNDS) == part))
            a, b = hashes[at], hashes[at + 1]
            first, n = _grouped([a, b])
            yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(n, pa.int64())], names=["h0", "h1", "n"])

    return run


def _projections(seed: int, words, pairs):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches):
            hashes, _, _, _, piece = _words(lang, block, seed)
            on = _joined(hashes, piece, words.value)
            at = np.flatnonzero(on)
            on[at] = _in(pairs.value, _pair_place(hashes[at], hashes[at + 1]))
            reach = np.concatenate([on, np.zeros(LONGEST, bool)])
            at = np.flatnonzero(reach[: len(on)] & reach[1 : len(on) + 1])
            held = np.concatenate([hashes, np.zeros(LONGEST, np.uint64)])
            columns, going = [held[at], held[at + 1], held[at + 2]], np.ones(len(at), bool)
            for i in range(3, LONGEST):
                going = going & reach[at + i - 1]
                columns.append(np.where(going, held[at + i], np.uint64(0)))
            first, n = _grouped(columns)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[first].view(np.int64)) for c in columns], pa.array(n, pa.int64())], names=[*_IDS, "n"])

    return run


def extended(columns: list[np.ndarray], counts: np.ndarray, depth: int, least: int) -> Iterator[tuple[list[int], int]]:
    """Frequent phrases that extend the first ``depth`` words, from projections sorted by all columns; depth first."""
    new = np.ones(len(counts), bool)
    if len(counts):
        new[1:] = False
        for c in columns[:depth]:
            new[1:] |= c[1:] != c[:-1]
    roots = np.flatnonzero(new)
    ends = np.append(roots[1:], len(counts))
    total = np.add.reduceat(counts, roots) if len(roots) else counts
    for i in np.flatnonzero(total >= least).tolist():
        stack = [(int(roots[i]), int(ends[i]), [int(c[roots[i]]) for c in columns[:depth]])]
        while stack:
            lo, hi, prefix = stack.pop()
            following = columns[len(prefix)][lo:hi]
            cuts = np.concatenate([[0], np.flatnonzero(following[1:] != following[:-1]) + 1])
            sums = np.add.reduceat(counts[lo:hi], cuts)
            stops = np.append(cuts[1:], hi - lo)
            for j in np.flatnonzero((sums >= least) & (following[cuts] != 0))[::-1].tolist():
                phrase = [*prefix, int(following[cuts[j]])]
                yield phrase, int(sums[j])
                if len(phrase) < len(columns):
                    stack.append((lo + int(cuts[j]), lo + int(stops[j]), phrase))


def _grow(depth: int, least: int):
    def out(columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        found = list(extended(columns, counts, depth, least))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.int64())], names=["ids", "f"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            differs = np.zeros(max(len(held[0]) - 1, 0), bool)
            for c in held[:depth]:
                differs |= c[1:] != c[:-1]
            cuts = np.flatnonzero(differs)
            if len(cuts) and len(held[0]) >= 20_000:
                end = cuts[-1] + 1
                yield out([c[:end] for c in held[:-1]], held[-1][:end])
                held = [c[end:] for c in held]
        if held:
            yield out(held[:-1], held[-1])

    return run


def _phrases(grown: DataFrame, words: int) -> DataFrame:
    return grown.select(F.array(*_IDS[:words]).alias("ids"), F.col("n").alias("f"))


def frequent(texts: DataFrame, least: int = AT_LEAST, pointers: int = POINTERS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(hash, lang, word, n) of all words, and (ids, f) of all phrases of up to LONGEST words with f >= least; from (lang, text)."""
    spark = texts.sparkSession
    ship(spark)
    context = spark.sparkContext
    counted = texts.mapInArrow(_vocabulary(seed), "hash long, lang string, word string, n long").groupBy("hash", "lang", "word").agg(F.sum("n").alias("n"))
    vocabulary = written(counted, "phrase-words")
    release(spark)
    if not vocabulary.groupBy("hash").agg(F.count(F.lit(1)).alias("words")).where("words > 1").isEmpty():
        drop(vocabulary)
        return frequent(texts, least, pointers, seed + 1)
    common = vocabulary.where(F.col("n") >= least)
    words = context.broadcast(bitmap(common.select(F.col("hash").bitwiseAND(_PLACES - 1))))
    parts = []
    for part in range(ROUNDS):
        counted = texts.mapInArrow(_pairs(seed, words, part), "h0 long, h1 long, n long").groupBy("h0", "h1").agg(F.sum("n").alias("n"))
        parts.append(written(counted.where(F.col("n") >= least), "phrase-pairs"))
        release(spark)
    pairs = reduce(DataFrame.unionByName, parts)
    places = F.col("h0").bitwiseXOR(F.shiftrightunsigned("h1", 17)).bitwiseAND(_PLACES - 1)
    seen = context.broadcast(bitmap(pairs.select(places)))
    rest = written(texts.mapInArrow(_projections(seed, words, seen), ", ".join(f"{c} long" for c in [*_IDS, "n"])).groupBy(*_IDS).agg(F.sum("n").alias("n")), "phrase-pointers")
    release(spark)
    found = [common.select(F.array("hash").alias("ids"), F.col("n").alias("f")), _phrases(pairs, 2)]
    sums = pairs
    for depth in range(2, LONGEST):
        hot = sums.where(F.col("n") > pointers)
        few = maybe_in(rest, hot, _IDS[:depth], other=True)
        dealt = few.repartition(*_IDS[:depth]).sortWithinPartitions(*_IDS)
        found.append(written(dealt.mapInArrow(_grow(depth, least), "ids array<long>, f long"), "phrase-grown"))
        if hot.isEmpty():
            break
        rest = written(maybe_in(rest, hot, _IDS[:depth]), "phrase-hot")
        longer = rest.where(F.col(_IDS[depth]) != 0).groupBy(*_IDS[: depth + 1]).agg(F.sum("n").alias("n"))
        sums = written(longer.where(F.col("n") >= least), "phrase-sums")
        found.append(_phrases(sums, depth + 1))
        release(spark)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return vocabulary, written(every, "phrases")


#: floor(1000 * a * n / (l * r)) of a cut, exactly.
_SCORE = "(cast(1000L * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(c.l as decimal(19,0)) * cast(c.r as decimal(19,0)))"


def collocations(docs: DataFrame, least: int = AT_LEAST, top: int = TOP, pointers: int = POINTERS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by their weakest cut."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    vocabulary, phrases = frequent(texts, least, pointers)
    size = F.size("ids")
    cuts = phrases.where(size > 1).select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"))
    part = lambda name, n: phrases.select(F.col("ids").alias(name), F.col("f").alias(n)).hint("merge")
    both = written(cuts.join(part("left", "l"), "left").join(part("right", "r"), "right").select("ids", "a", "k", "l", "r"), "phrase-cuts")
    inside = lambda ends, sub: both.where((size > 2) & ends).select(sub.alias("ids"))
    heads = inside((F.col("k") == size - 1) & (F.col("l") == F.col("a")), F.slice("ids", F.lit(1), size - 1))
    tails = inside((F.col("k") == 1) & (F.col("r") == F.col("a")), F.slice("ids", F.lit(2), size - 1))
    whole = both.groupBy("ids").agg(F.first("a").alias("a"), F.collect_list(F.struct("k", "l", "r")).alias("cuts")).join(heads.union(tails).distinct().hint("merge"), "ids", "left_anti")
    totals = written(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    first = vocabulary.where(F.col("n") >= least).select(F.col("hash").alias("head"), "lang").hint("merge")
    told = whole.withColumn("head", F.col("ids")[0]).join(first, "head").join(totals, "lang")
    weakest = F.expr(f"array_min(transform(cuts, c -> named_struct('score', {_SCORE}, 'k', c.k, 'l', c.l, 'r', c.r)))")
    scored = told.select("lang", "ids", "a", "n", weakest.alias("cut"))
    scored = scored.select("lang", "ids", "a", "n", "cut.score", "cut.l", "cut.r").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(32)))
    strongest = [F.desc("score"), F.desc("a")]
    for by in (["lang", "salt"], ["lang"]):
        scored = scored.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(*strongest))).where(F.col("place") <= top)
    best = written(scored.drop("salt", "place"), "phrase-best")
    spelled = (
        best.select("ids", F.posexplode("ids").alias("i", "hash"))
        .join(vocabulary.where(F.col("n") >= least).select("hash", "word"), "hash")
        .groupBy("ids")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    )
    ranked = best.join(spelled, "ids").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*strongest, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
