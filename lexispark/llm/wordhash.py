"""Words of many texts at once as numpy codes, hashes of word sequences, and exact names of shingles.

A text is its UTF-8 bytes; words are runs of bytes other than space and
0x09-0x0D. A word's code has 128 bits: its bytes and length where it has 15
bytes at most, so the code is the word itself, otherwise a BLAKE2b digest.
Sequence hashes only choose candidates: they mix the codes pairwise, level by
level, without sums or products that sequences could share. What decides about
equality are names, numbers that two sequences share if and only if their codes
are equal, or digests of the words' bytes.

Texts are taken in chunks of about CHUNK bytes and a long text in pieces of
PIECE bytes, so beside 16 bytes a word memory is bounded by those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

CHUNK, PIECE = 1 << 19, 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Bytes of a word that fit its code; the code's last byte is the length, or LONG for a digest.
SHORT, LONG = 15, np.uint64(0xFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in their order."""
    return mix(mix(a ^ np.uint64(0x9E3779B97F4A7C15)) + b * np.uint64(0xD1342543DE82EF95))


def edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` begin and end; it ends with white space."""
    at = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    return at[0::2], at[1::2]


def _codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two halves of the code of each word, and where it begins."""
    starts, ends = edges(data)
    size = ends - starts
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    low = eight[starts].view(np.uint64).ravel() & _KEEP[np.minimum(size, 8)]
    high = eight[starts + 8].view(np.uint64).ravel() & _KEEP[np.clip(size - 8, 0, 7)]
    high |= np.minimum(size, SHORT).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = data.tobytes()
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        found = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        low[long], high[long] = found[:, 0], (found[:, 1] & _KEEP[7]) | (LONG << np.uint64(56))
    return low, high, starts


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text cut at white space into pieces of about ``size`` bytes (a longer word stays whole)."""
    at = 0
    while len(text) - at > size:
        space = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, size, at)])
        end = at + int(space[-1]) + 1 if len(space) else at + size
        while not len(space) and end < len(text) and not _SPACE[text[end]]:
            block = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, min(size, len(text) - end), end)])
            end += int(block[0]) if len(block) else min(size, len(text) - end)
        yield text[at:end]
        at = end
    yield text[at:]


def codes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the codes of all words in order; offsets[i] is text i's first word, offsets[-1] their number."""
    lows, highs, counts = [], [], np.zeros(len(texts) + 1, np.int64)

    def take(block: list[bytes], first: int) -> None:
        data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
        low, high, starts = _codes(_LOWER[data] if lower else data)
        lows.append(low)
        highs.append(high)
        bounds = np.cumsum([len(t) + 1 for t in block])
        counts[first + 1 : first + 1 + len(block)] += np.diff(np.searchsorted(starts, bounds), prepend=0)

    block: list[bytes] = []
    held = 0
    for i, t in enumerate(texts):
        if block and held + len(t) > PIECE:
            take(block, i - len(block))
            block, held = [], 0
        if len(t) > PIECE:
            for p in pieces(t):
                take([p], i)
        else:
            block.append(t)
            held += len(t)
            if i + 1 == len(texts) or len(texts[i + 1]) > PIECE:
                take(block, i + 1 - len(block))
                block, held = [], 0
    join = lambda xs: xs[0] if len(xs) == 1 else np.concatenate(xs) if xs else np.zeros(0, np.uint64)
    return join(lows), join(highs), np.cumsum(counts)


def hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of each code."""
    return pair(mix(low), high)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (the last n - 1 places are left out)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out, at, level, width = None, 0, hashes, 1
    while n:
        if n & width:
            out = level[at : at + size] if out is None else pair(out, level[at : at + size])
            at += width
            n -= width
        if n:
            level = pair(level[:-width], level[width:])
            width *= 2
    return mix(out)


def _numbers(keys: np.ndarray) -> np.ndarray:
    return pd.factorize(keys)[0].astype(np.int64)


def names(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A number for each code; equal if and only if the codes are."""
    found = _numbers(hashes(low, high))
    first = np.empty(int(found.max(initial=-1)) + 1, np.int64)
    first[found[::-1]] = np.arange(len(found) - 1, -1, -1)
    if (low[first[found]] == low).all() and (high[first[found]] == high).all():
        return found
    return np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)[1].ravel().astype(np.int64)


def gram_names(words: np.ndarray, n: int) -> np.ndarray:
    """A number for the n words from each word on; equal if and only if all n are. From ``names`` of words."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    out, at, level, width = None, 0, words, 1
    both = lambda a, b: _numbers(a * (int(b.max(initial=0)) + 1) + b)
    while n:
        if n & width:
            out = level[at : at + size] if out is None else both(out, level[at : at + size])
            at += width
            n -= width
        if n:
            level = both(level[:-width], level[width:])
            width *= 2
    return out


def shingle_names(texts: list[bytes], width: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct numbers of the shingles of each text; shingles of two texts are equal if and only if their numbers are.

    A text of fewer words is one shingle, all its words.
    """
    low, high, at = codes(texts, lower)
    every = gram_names(names(low, high), width)
    out, short = [], {}
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            whole = (low[a:b].tobytes(), high[a:b].tobytes())
            out.append(np.array([-1 - short.setdefault(whole, len(short))]))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def chunks(rows: Iterable[tuple], size: int = CHUNK) -> Iterator[list[tuple]]:
    """Rows, whose last field is a text in bytes, in lists of about ``size`` bytes."""
    out, total = [], 0
    for row in rows:
        if out and total + len(row[-1]) > size:
            yield out
            out, total = [], 0
        out.append(row)
        total += len(row[-1])
    if out:
        yield out
