"""Periodic runs of words, found by partition refinement over factor lengths.

Positions of a text are put into classes of equal factors: at length 1 by word,
and from length l to l + 1 a position's class is split by the class of the
position after it. Only the smaller parts of each split are carried to the next
length (the largest part splits nothing), so a position is handled O(log n)
times. Neighbours in a class at distance p when the length is p are a square
whose root has no smaller period; squares at neighbouring positions are one run.

Many texts are refined together, as arrays: a class is a segment of one
permutation, its members in order of position are a linked list, and a step
touches only what it moves. Each text ends in a mark of its own, so nothing
crosses texts. Lengths beyond a quarter of a text are not refined, since no run
that is reported has a longer period.

Spark deals the texts; a task holds the words of BLOCK of them, or one longer
text, at about 150 bytes a word. Texts are never cut.

Defined results: a null text has no words, no runs, and the digest of the empty
text; a null doc_id is a row like any other whose words stay as they are; rows
are judged one by one, so repeated rows and ties give equal results; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidied

#: Least length of a run, and least number of its periods.
LEAST, TIMES = 6, 4
#: Words that a task refines together.
BLOCK = 400_000
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all stretches of ``sizes`` numbers from ``starts``, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Classes:
    """Positions of texts in classes of equal factors, refined from one length to the next."""

    def __init__(self, words: np.ndarray, most: np.ndarray):
        """``words``: a number for each word, other ones in each text, each text's last one its mark; ``most``: at each position the last length of interest."""
        n = len(words)
        self.most, self.level = most, 1
        self.order = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.diff(words[self.order], prepend=-1))
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.start, self.size, self.count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), len(first)
        self.start[: self.count] = first
        self.size[: self.count] = np.diff(first, append=n)
        self.kind = np.empty(n, np.int64)
        self.kind[self.order] = np.repeat(np.arange(self.count), self.size[: self.count])
        self.next, self.last = np.full(n, -1), np.full(n, -1)
        self.since = np.ones(n, np.int64)
        self.flag = np.zeros(n, bool)
        same = np.flatnonzero(np.diff(self.kind[self.order]) == 0)
        self.next[self.order[same]] = self.order[same + 1]
        self.last[self.order[same + 1]] = self.order[same]
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def close(self, at: np.ndarray, level: int) -> None:
        """Links from ``at`` end before ``level``; those that stood when the length was their distance are squares."""
        at = at[self.next[at] >= 0]
        gap = self.next[at] - at
        found = (self.since[at] <= gap) & (gap < level) & (gap <= self.most[at])
        if found.any():
            self.squares.append((at[found], gap[found]))

    def split(self, small: np.ndarray) -> np.ndarray:
        """Split classes by the positions that follow, given those in smaller parts; returns the positions in smaller parts of this step."""
        level = self.level = self.level + 1
        at = small[small > 0] - 1
        at = at[(self.size[self.kind[at]] > 1) & (self.most[at] >= level)]
        if not len(at):
            return at
        by, old = self.kind[at + 1], self.kind[at]
        order = np.lexsort((at, by, old))
        at, by, old = at[order], by[order], old[order]
        new_class = np.diff(old, prepend=-1) != 0
        group_at = np.flatnonzero(new_class | (np.diff(by, prepend=-1) != 0))
        group_size = np.diff(group_at, append=len(at))
        parent_at = np.flatnonzero(new_class[group_at])
        parent = old[group_at[parent_at]]
        touched = np.add.reduceat(group_size, parent_at)
        rest = self.size[parent] - touched
        of = np.repeat(np.arange(len(parent)), np.diff(parent_at, append=len(group_at)))
        ranked = np.lexsort((-group_size, of))
        largest = ranked[parent_at]
        keeps = np.zeros(len(group_at), bool)
        keeps[largest[rest == 0]] = True
        minor = np.ones(len(group_at), bool)
        minor[largest[group_size[largest] > rest]] = False
        moved = ~keeps
        if not moved.any():
            return at[:0]
        member = np.repeat(moved, group_size)
        going, own = at[member], old[member]
        self._move(going, own, np.flatnonzero(moved), group_size, parent, of)
        self._link(going, own, level)
        out = [at[np.repeat(minor & moved, group_size)]]
        behind = (rest > 0) & (group_size[largest] > rest)
        if behind.any():
            out.append(self.order[ragged(self.start[parent[behind]], self.size[parent[behind]])])
        return np.concatenate(out)

    def _move(self, going: np.ndarray, own: np.ndarray, groups: np.ndarray, group_size: np.ndarray, parent: np.ndarray, of: np.ndarray) -> None:
        """Put ``going`` at the ends of their classes' segments, each group a class of its own."""
        sizes = group_size[groups]
        less = np.bincount(of[groups], weights=sizes, minlength=len(parent)).astype(np.int64)
        some = less > 0
        begin = self.start[parent[some]] + self.size[parent[some]] - less[some]
        region = ragged(begin, less[some])
        self.flag[going] = True
        there = self.order[region]
        stay = there[~self.flag[there]]
        self.flag[going] = False
        was = self.place[going]
        holes = was[was < np.repeat(begin, less[some])]
        self.order[holes] = stay
        self.place[stay] = holes
        self.order[region] = going
        self.place[going] = region
        self.size[parent] -= less
        fresh = np.arange(self.count, self.count + len(groups))
        self.count += len(groups)
        self.size[fresh] = sizes
        self.start[fresh] = region[np.cumsum(sizes) - sizes]
        self.kind[going] = np.repeat(fresh, sizes)

    def _link(self, going: np.ndarray, own: np.ndarray, level: int) -> None:
        """Take ``going`` out of their old lists and string each new class together."""
        chain = going[np.lexsort((going, own))]
        head = np.ones(len(chain), bool)
        head[1:] = self.last[chain[1:]] != chain[:-1]
        tail = np.append(head[1:], True)
        left, right = self.last[chain[head]], self.next[chain[tail]]
        self.close(going, level)
        self.close(left[left >= 0], level)
        has = left >= 0
        self.next[left[has]] = right[has]
        self.since[left[has]] = level
        has = right >= 0
        self.last[right[has]] = left[has]
        same = self.kind[going[1:]] == self.kind[going[:-1]]
        self.next[going] = np.append(np.where(same, going[1:], -1), -1)
        self.last[going] = np.append(-1, np.where(same, going[:-1], -1))
        self.since[going] = level


def squares(words: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where squares with roots of no smaller period begin, and their periods."""
    classes = Classes(words, most)
    small = np.arange(len(words))
    while len(small):
        small = classes.split(small)
    classes.close(np.arange(len(words)), int(most.max(initial=0)) + 1)
    if not classes.squares:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in classes.squares]), np.concatenate([p for _, p in classes.squares])


def runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each text, given as words, its runs as rows (start, length, period) by start, then period."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words, base = np.empty(bounds[-1], np.int64), 0
    for i, text in enumerate(texts):
        number: dict[bytes, int] = {}
        get = number.setdefault
        words[bounds[i] : bounds[i + 1] - 1] = np.fromiter((get(w, len(number)) for w in text), np.int64, len(text))
        words[bounds[i + 1] - 1] = len(number)
        words[bounds[i] : bounds[i + 1]] += base
        base += len(number) + 1
    at, period = squares(words, np.repeat((sizes - 1) // times, sizes))
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = np.ones(len(at), bool)
    first[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    begin, end = np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], len(at)) - 1
    start, p = at[begin], period[begin]
    length = at[end] + 2 * p - start if len(at) else start
    long = length >= np.maximum(least, times * p)
    found = np.stack([start[long], length[long], p[long]], axis=1)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    cuts = np.searchsorted(found[:, 0], bounds)
    return [found[cuts[i] : cuts[i + 1]] - [bounds[i], 0, 0] for i in range(len(texts))]


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the contract's ``doc_id``: every tenth by checksum repeats a part of itself to its end."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids: list = []
    texts: list[list[bytes]] = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            words = (text.as_py() or b"").split()
            if texts and held + len(words) > BLOCK:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            held += len(words)
    if texts:
        yield ids, texts


def _table(planted: bool):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for ids, texts in _blocks(batches):
            if planted:
                texts = [repeated(t, d) for t, d in zip(texts, ids, strict=True)]
            out = []
            for doc_id, words, found in zip(ids, texts, runs(texts), strict=True):
                listed = found.tolist()
                start, length, period = min(listed, key=lambda r: (-r[1], r[0], r[2])) if listed else (None, None, None)
                said = "".join(f"{s},{n},{p}\n" for s, n, p in listed)
                out.append((doc_id, len(listed), start, length, period, 1000 * length // period if listed else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=names)

    return run


def run_table(docs: DataFrame, planted: bool = False) -> DataFrame:
    """One row per row of ``docs``: its number of runs, the longest one, and digests of all runs and of the collapsed text.

    ``planted``: every tenth text is first made to repeat a part of itself (``repeated``).
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_table(planted), SCHEMA)


@tidied
def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t.as_py() or b"").split() for t in batch.column(1).cast(pa.binary())]
        out = [collapsed(w, f).decode() if len(f) else None for w, f in zip(texts, runs(texts), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "new"])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts keep the first period of each run only; texts without runs stay as they are, white space included."""
    ship(docs.sparkSession)
    row = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    found = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(_collapse, f"row {row}, new string")
    text = next(c for c in docs.columns if c.lower() == "text")
    return found.select(*[F.coalesce("new", F.col("row").getField(c)).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
