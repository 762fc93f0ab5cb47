"""Mixing (against its exact twin) and sharding (against a plain ring)."""

import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexispark.llm import mixing, sharding

from .helpers import SCHEMA, corpus


def twin(rows, weights=(1, 2, 3), cap=3):
    """The same sample by sorting each source as a whole."""
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows}
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r["doc_id"])
    order = sorted(by, key=lambda s: (s is None, s))
    total = {s: sum(size[d] for d in by[s]) for s in order}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, sum(total.values()), sum(weight.values())
    for s in sorted(order, key=lambda s: cap * total[s] / weight[s]):
        target[s] = min(cap * total[s], left * weight[s] / free)
        left, free = left - target[s], free - weight[s]
    copies = {}
    for s in order:
        whole = min(cap, int(target[s] // total[s])) if total[s] else 0
        rest = target[s] - whole * total[s]
        got, chosen = 0, set()
        # Inclusion probabilities: c * size, cut at 1, so that the expected words are the rest.
        sure = set()
        while open_ := [d for d in by[s] if size[d] and d not in sure]:
            c = (rest - sum(size[d] for d in sure)) / sum(size[d] ** 2 for d in open_)
            top = max(size[d] for d in open_)
            if c * top < 1:
                break
            sure |= {d for d in open_ if size[d] == top}
        c = max(c, 0) if size and open_ else 0
        rest -= sum(size[d] for d in sure)
        rank = {}
        for d in open_ if c else []:
            mark = f"{d}:{hashlib.md5(text[d].encode()).hexdigest()}"
            u = (int(hashlib.md5(mark.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = c * size[d]
            q = u / (1 - u) / (p / (1 - p))
            rank[d] = int(q / (1 + q) * 2**40)
        for d in sorted(rank, key=rank.get):
            if got + size[d] > rest:
                break
            got += size[d]
            chosen.add(d)
        gap = rest - got
        more = [d for d in rank if d not in chosen and abs(gap - size[d]) < gap]
        if more:
            chosen.add(min(more, key=lambda d: (abs(gap - size[d]), rank[d])))
        chosen |= sure
        for d in by[s]:
            copies[d] = (whole + (d in chosen)) * (size[d] > 0)
    return target, size, copies


def test_mix_equals_its_twin(spark):
    docs = corpus(spark)
    rows = docs.collect()
    target, size, copies = twin(rows)
    source = {r["doc_id"]: r["source"] for r in rows}
    got = mixing.mix_table(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        d = r["doc_id"]
        assert r["size"] == size[d] and abs(r["target"] - target[source[d]]) < 1e-6
        assert (r["copies"], r["taken"]) == (copies[d], copies[d] * size[d])
    assert sum(r["taken"] for r in got) > 0 and max(r["copies"] for r in got) <= 3


def test_mixed_corpus_repeats_rows_and_keeps_columns(spark):
    docs = corpus(spark)
    _, size, copies = twin(docs.collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n if size[d] else 1 for d, n in copies.items() if n or not size[d]})


def test_targets_stop_at_three_times_the_source(spark):
    rows = [(i, "w " * 1000, None, "a", 0) for i in range(20)] + [(100 + i, "w " * 10, None, "c", 0) for i in range(5)]
    got = {r["doc_id"]: r for r in mixing.mix_table(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100]["target"] == 150.0 and got[100]["copies"] == 3 and abs(got[0]["target"] - 19900.0) < 1e-6


def test_empty_and_wordless_tables(spark):
    empty = corpus(spark).limit(0)
    assert mixing.mix_table(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0), (1, "", None, "a", 0)], SCHEMA)
    assert [(r["taken"], r["target"]) for r in mixing.mix_table(blank).collect()] == [(0, 0.0)] * 2
    assert sharding.shard_rows(empty).count() == 0


def test_inclusion_shares_follow_the_probabilities(spark):
    """Sources of three sizes of documents, each drawn with its own ids: the share taken of each size is its p."""
    sizes = [10] * 30 + [20] * 20 + [30] * 10
    rows = [(60 * s + i, "w " * size, None, f"s{s:03}", 0) for s in range(20) for i, size in enumerate(sizes)]
    found = mixing.mix_table(spark.createDataFrame(rows, SCHEMA), weights=(1, 3)).collect()
    n, taken = Counter(), Counter()
    for r in found:
        assert r["target"] % 1000 == 500  # so p is 500 / (30 * 10**2 + 20 * 20**2 + 10 * 30**2) times the size
        n[r["size"]] += 1
        taken[r["size"]] += r["copies"] - int(r["target"] // 1000)
    for size in (10, 20, 30):
        assert abs(taken[size] / n[size] - size * 500 / 20_000) < 0.06, (size, taken[size] / n[size])


def test_repeated_rows_are_taken_one_by_one(spark):
    rows = [(None, "w " * 10, None, s, 1) for s in "abc" for _ in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = mixing.mix_table(docs).collect()
    words = Counter()
    for r in got:
        words[r["target"]] += r["taken"]
    assert len(got) == 300 and {t: n for t, n in words.items() if abs(t - n) > 10} == {}
    mixed = mixing.mix(docs.withColumns({"__sk": F.lit("mine"), "__n": F.lit(1), "__copies": F.lit(5), "__doc": F.lit(2), "size": F.lit(3)}))
    assert abs(mixed.count() - 300) <= 3 and {r["__sk"] for r in mixed.select("__sk").distinct().collect()} == {"mine"}


def walk(keys, shards, vnodes=128):
    """Rows one by one: first each arc's own shard takes what it has room for, then the others go on clockwise."""
    point = lambda s, v: int(hashlib.md5(f"shard {s} point {v}".encode()).hexdigest()[:4], 16)
    points = sorted({(point(s, v), s) for s in range(shards) for v in range(vnodes)})
    arc = {}
    for k, h in keys.items():
        place = int(h[:4], 16)
        arc[k] = next((i for i, (p, _) in enumerate(points) if p >= place), 0)
    # Arcs in ring order; what lies behind the last point belongs to the first one's arc, and comes after its rows.
    order = sorted(keys, key=lambda k: (arc[k], int(keys[k][:4], 16), int(keys[k][4:19], 16)))
    room = {s: len(keys) // shards + (s < len(keys) % shards) for s in range(shards)}
    out, late = {}, []
    for k in order:
        s = points[arc[k]][1]
        if room[s]:
            room[s] -= 1
            out[k] = s
        else:
            late.append(k)
    for k in late:
        i = arc[k]
        while not room[points[i % len(points)][1]]:
            i += 1
        out[k] = points[i % len(points)][1]
        room[out[k]] -= 1
    return out


def key_of(doc_id, text):
    raw = (text or "").encode()
    return hashlib.md5(f"{'' if doc_id is None else doc_id}:{len(raw) + 1}:{zlib.crc32(raw)}".encode()).hexdigest()


def test_shards_equal_a_plain_walk(spark):
    docs = corpus(spark)
    for shards in (4, 8):
        rows = sharding.shard_rows(docs, shards=shards).collect()
        sizes = Counter(r["shard"] for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == docs.count()
        for s in sizes:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
        keys = {r["doc_id"]: key_of(r["doc_id"], r["text"]) for r in docs.collect()}
        assert {r["doc_id"]: r["shard"] for r in rows} == walk(keys, shards)


def test_few_rows_move_when_a_shard_joins():
    keys = {i: hashlib.md5(str(i).encode()).hexdigest() for i in range(4_000)}
    before, after = walk(keys, 8), walk(keys, 9)
    moved = sum(before[k] != after[k] for k in keys)
    assert len(keys) / 9 - 1 <= moved < 0.3 * len(keys), moved / len(keys)


def test_places_of_many_rows_are_salted(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 20)
    rows = [(None, "a", None, None, 1)] * 500 + [(7, "b", None, None, 1)] * 60 + [(i, f"t{i}", None, None, 1) for i in range(100)]
    got = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 660 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sizes_and_checksums(spark):
    docs = corpus(spark)
    texts = {d: (t or "").encode() for d, t in [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]}
    for r in sharding.shard_rows(docs).collect():
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))


def test_null_and_repeated_ids_are_all_placed(spark):
    rows = [(None, "a", None, None, 1)] * 5 + [(7, "b", None, None, 1)] * 6
    got = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA), shards=3).collect()
    assert len(got) == 11 and max(Counter(r["shard"] for r in got).values()) <= 4 and all(r["shard"] is not None for r in got)
