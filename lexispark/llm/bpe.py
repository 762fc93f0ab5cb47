"""BPE encoding and decoding.

A text is cut at the tokenizer's added tokens (longest first at each place),
the pieces by its pre-tokenisation pattern, and each pre-token's bytes are
merged: a priority queue holds (merge rank, place) of adjacent symbols, which
are a doubly linked list; an entry whose symbols have changed since is stale
and skipped. Decoding looks each id's string up and concatenates them.

The vocabulary file's path is a parameter; workers read it once. Encoded
pre-tokens of up to REMEMBERED letters are remembered, up to CACHE of them,
after which the memory is emptied. A long text is encoded BLOCK pre-tokens at a
time, and merging one takes some sixty bytes for each of its own, so memory is
bounded by the longest text and the longest run without a cut in it.

Defined results: a null or empty text has no tokens; rows are independent, so
repeated rows get equal results; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidied, tidy

#: Pre-tokens that a worker remembers, letters of one; pre-tokens that are looked at together.
CACHE, REMEMBERED, BLOCK = 400_000, 64, 65_536
#: Bytes of the texts whose ids are held together.
BYTES = 4 << 20
#: Fixed value: the pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_strings() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE tokenizer from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        of_char = byte_strings()
        as_bytes = lambda s: bytes(of_char[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.strings: dict[int, bytes] = {i: as_bytes(s) for s, i in vocab.items()}
        ids = {v: k for k, v in self.strings.items()}
        self.single = [ids.get(bytes([b])) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in added.items()}
        self.added = added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pattern = regex.compile(PATTERN)
        self.words, self.each = pattern.findall, pattern.finditer
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        # Lists are faster, arrays of numbers smaller.
        held = list if len(data) <= BLOCK else lambda xs: array("i", xs)
        symbols = held([self.single[b] for b in data])
        n = len(symbols)
        after, before = held(range(1, n + 1)), held(range(-1, n - 1))
        get = self.merges.get
        # An entry is rank and place in one number; a pair's rank is its own, so a stale entry shows by another rank.
        queue = [found[0] << 32 | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := get(pair))]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            if (left := symbols[i]) < 0 or (j := after[i]) >= n or not (found := get((left, symbols[j]))) or found[0] != entry >> 32:
                continue  # stale: one of the two has been merged since
            joined = found[1]
            symbols[i], symbols[j] = joined, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := get((joined, symbols[k])):
                    heappush(queue, found[0] << 32 | i)
            if (h := before[i]) >= 0 and (found := get((symbols[h], joined))):
                heappush(queue, found[0] << 32 | h)
        return [s for s in symbols if s != -1]

    def _plain(self, text: str) -> bytes:
        if len(text) <= BLOCK:
            return self._ids(self.words(text))
        found = (m[0] for m in self.each(text))
        return b"".join(iter(lambda: self._ids(list(islice(found, BLOCK))), b""))

    def _ids(self, words: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            out = []
            for w in words:
                ids = known.get(w)
                if ids is None:
                    merged = self.merge(w.encode())
                    ids = pack(f"<{len(merged)}I", *merged)
                    if len(w) <= REMEMBERED:
                        if len(known) >= CACHE:
                            known.clear()
                        known[w] = ids
                out.append(ids)
            return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._plain(p) for p in self.cut.split(text) if p)

    def decode(self, ids: bytes) -> str:
        """The text of ids: their strings, concatenated; bytes that are not UTF-8 become U+FFFD."""
        numbers, get = np.frombuffer(ids, "<u4"), self.strings.__getitem__
        return b"".join([b"".join(map(get, numbers[i : i + BLOCK].tolist())) for i in range(0, len(numbers), BLOCK)]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
        tidy()
    return _loaded[path]


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, digests, decoded = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded_sha256 of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = min(256, batch.num_rows - at)
                while size > 1 and batch.slice(at, size).column(1).nbytes > BYTES:
                    size //= 2
                part = batch.slice(at, size)
                at += size
                ids = [bpe.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())),
                        pa.array([hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "token_ids", "decoded_sha256"],
                )

    texts = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, token_ids array<int>, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, token_ids (array of int) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    texts = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(tidied(run), f"doc_id {kind}, token_ids array<int>")


def decode_ids(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, token_ids."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.array(t.as_py() or [], "<u4").tobytes()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", F.col("token_ids")).mapInArrow(tidied(run), f"doc_id {kind}, text string")
