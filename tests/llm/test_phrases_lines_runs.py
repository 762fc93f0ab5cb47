"""Phrases, line deduplication and periodic runs against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import line_dedup, periodic, phrases

from .helpers import SCHEMA, corpus, plain


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- phrases


def plain_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        rows = []
        for p, a in cand.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]], score))
        for i, (_, _, p, a, left, right, score) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, p.decode(), a, left, right, n[lang], score))
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("pointers", [1, 30, 50_000])
def test_phrases_equal_plain_counts(spark, pointers):
    """Hot prefixes are split at every length and counts stay the same."""
    docs = corpus(spark)
    more = spark.createDataFrame([(100 + i, "Of the Old town, of the old\ttown; of the old mill. a a a a a a", None if i % 2 else "und", None, 1) for i in range(9)], SCHEMA)
    docs = docs.select("doc_id", "text", "lang").unionByName(more.select("doc_id", "text", "lang"))
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = phrase_rows(phrases.collocations(docs, least=5, top=40, pointers=pointers))
    assert got == plain_phrases(rows, 5, 40) and {r[0] for r in got} == {"de", "en", "und"}


def test_phrases_of_odd_tables(spark):
    docs = corpus(spark)
    assert phrases.collocations(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, " .,\t", None, None, 0)], SCHEMA)
    assert phrases.collocations(nulls, least=1).count() == 0
    clash = spark.createDataFrame([(1, "x y", None, "s", 1)] * 3, SCHEMA).selectExpr("*", "'q' AS word", "1 AS hash", "2 AS ids", "3 AS n", "4 AS h0")
    assert phrase_rows(phrases.collocations(clash, least=2)) == [("und", 1, "x y", 3, 3, 3, 6, 2000)]


def test_colliding_word_hashes_are_seen(spark, monkeypatch):
    """With a hash that mixes two words up, the next seed is taken."""
    real, asked = phrases._words, []

    def weak(lang, block, seed):
        hashes, *rest = real(lang, block, seed)
        return (hashes % 3 + 1 if seed == 0 else hashes, *rest)

    docs = spark.createDataFrame([(i, "red green blue black", "en", None, 1) for i in range(5)], SCHEMA)
    rows = [pa_batch for pa_batch in docs.select("lang", "text").toArrow().to_batches()]
    monkeypatch.setattr(phrases, "_words", weak)
    shared = {}
    for b in phrases._vocabulary(0)(iter(rows)):
        for h, w in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            shared.setdefault(h, set()).add(w)
    assert any(len(w) > 1 for w in shared.values()) and sum(map(len, shared.values())) == 4
    monkeypatch.undo()
    vocabulary = spark.createDataFrame([(1, "en", "red", 5), (1, "en", "green", 5)], "hash long, lang string, word string, n long")
    written = phrases.written

    def first_seed_collides(df, label):
        if label == "phrase-words":
            asked.append(label)
            return written(vocabulary if len(asked) == 1 else df, label)
        return written(df, label)

    monkeypatch.setattr(phrases, "written", first_seed_collides)
    got = phrase_rows(phrases.collocations(docs, least=5))
    assert len(asked) == 2 and got == plain_phrases([("en", "red green blue black")] * 5, 5, 2000)


def test_long_texts_are_cut_at_pieces_only(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "BLOCK", 50)
    draw = random.Random(3)
    text = "".join(draw.choice(["ab ", "cd ", "e. ", "f\n", "gh" * 40 + " "]) for _ in range(300))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    blocks = [b for _, b in phrases._blocks(iter([batch]))]
    assert len(blocks) > 20 and b"".join(blocks).decode() == text.replace(".", "\n") + "\n"


# -- lines


def plain_lines(texts, shortest=20, at_least=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= shortest:
                held[key(x)].add(d)
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= at_least and d != max(held[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def line_corpus(spark, n=200, seed=4):
    draw = random.Random(seed)
    stock = [f"a line that many documents share, number {i}" for i in range(12)] + ["Ünïcode lines with ÄÖ are not folded", "short"]
    texts = {}
    for d in range(n):
        lines = [draw.choice(stock) if draw.random() < 0.6 else f"an own line of document {d} {draw.random()}" for _ in range(draw.randint(0, 12))]
        texts[d] = "\n".join(x.upper() if draw.random() < 0.2 and x.isascii() else f" \t{x}\r" if draw.random() < 0.2 else x for x in lines)
    texts[n], texts[n + 1], texts[n + 2] = None, "", "\n".join(f"{stock[0]}" if i % 3 else f"line {i} of a very long text" for i in range(20_000))
    return spark.createDataFrame([(d, t, "en", None, 1) for d, t in texts.items()], SCHEMA), texts


@pytest.mark.parametrize("batches, fanout", [(1, 2), (7, 2), (4, 3)])
def test_lines_equal_brute_force(spark, batches, fanout, monkeypatch):
    docs, texts = line_corpus(spark)
    rows = docs.selectExpr("0L AS part", "doc_id AS at", "doc_id", "text")
    found = line_dedup.gone_lines(rows, batches=batches, fanout=fanout)
    gone = {r["at"]: r["gone"] for r in found.collect()}
    for d, (n, dropped, kept) in plain_lines(texts).items():
        lines = (texts[d] or "").split("\n")
        assert "\n".join(x for i, x in enumerate(lines) if i not in set(gone.get(d, []))) == kept and len(gone.get(d, [])) == dropped


def test_line_table_and_stage(spark):
    docs, texts = line_corpus(spark)
    want = plain_lines(texts)
    docs = docs.selectExpr("*", "'x' AS gone", "1 AS hashes", "2 AS top", "3 AS part", "4 AS at", "5 AS row")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.line_table(docs).collect()}
    assert got == {d: (n, g, sha(t)) for d, (n, g, t) in want.items()}
    left = line_dedup.drop_lines(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"]: r["text"] or "" for r in left.collect()} == {d: t for d, (_, _, t) in want.items()}
    assert left.where("text is null").count() == 1
    assert line_dedup.line_table(docs.limit(0)).count() == 0


def test_lines_of_repeated_and_null_ids(spark):
    line = "this line is longer than twenty characters"
    rows = [(5, line), (5, line), (4, f"x\n{line}"), (None, line), (None, None)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.line_table(docs).collect())
    assert got == sorted([(0, 1, 0, sha("")), (0, 1, 1, sha("")), (4, 2, 1, sha("x")), (5, 1, 0, sha(line)), (5, 1, 0, sha(line))])


def test_line_store_goes_on_and_survives_a_failed_call(spark, tmp_path):
    """Levels, a batch that comes again, a run left aside, and a crash between a compaction's commit and its clean-up."""
    seen = lambda rows: spark.createDataFrame([(h.encode(), t) for h, t in rows], "hash binary, top long")
    state = lambda s: {bytes(r["hash"]).decode(): (r["documents"], r["top"]) for r in s.state().collect()}
    store = line_dedup.LineStore(spark, str(tmp_path / "store"), at_least=3, fanout=2)
    store.add(seen([("a", 9), ("a", 8), ("b", 8)]), "one")
    again = line_dedup.LineStore(spark, str(tmp_path / "store"), at_least=3, fanout=2)
    again.add(seen([("a", 9), ("a", 8), ("b", 8)]), "one")
    assert state(again) == {"a": (2, 9), "b": (1, 8)}
    (tmp_path / "store" / "aside-0-two").mkdir()
    again.add(seen([("a", 7), ("c", 7)]), "two")
    assert [(level, b) for level, _, b in again.runs()] == [(1, ("one", "two"))]
    again.add(seen([("a", 6), ("c", 6), ("c", 5)]), "three")
    assert state(again) == {"a": (3, 9), "b": (1, 8), "c": (3, 7)}, "a settled key gets no more rows"
    old = again.runs()
    again._commit(again.merged(again._read([n for _, n, _ in old])), 5, tuple(b for _, _, x in old for b in x))
    assert len(again.runs()) == 1 and state(again) == {"a": (3, 9), "b": (1, 8), "c": (3, 7)}
    assert again.batches() == {"one", "two", "three"}


# -- periodic runs


def plain_runs(words, least=6, times=4):
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least, times * p):
                part = words[i : j + p]
                if not any(all(x == y for x, y in zip(part, part[q:])) for q in range(1, p)):
                    out.append((i, length, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.lists(st.sampled_from([b"a", b"b"]), max_size=6), st.integers(0, 9)), min_size=1, max_size=6))
def test_runs_equal_brute_force(parts):
    texts = [head + unit * times + head[::-1] for head, unit, times in parts]
    assert [[tuple(r) for r in f.tolist()] for f in periodic.runs(texts)] == [plain_runs(t) for t in texts]


def test_runs_of_long_and_blocked_texts(monkeypatch):
    draw = random.Random(2)
    text = [b"%d" % draw.randrange(50) for _ in range(3000)]
    text[1000:1000] = text[10:200] * 5
    assert [tuple(r) for r in periodic.runs([text])[0].tolist()] == plain_runs(text)
    assert periodic.runs([[b"w"] * 5_000])[0].tolist() == [[0, 5_000, 1]]


def test_run_table(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 100)
    docs = corpus(spark, 300).selectExpr("doc_id", "text", "'x' AS start", "1 AS n_runs")
    more = spark.createDataFrame([(None, "a b a b a b a b c", "x", 1), (1000, None, "x", 1), (1001, "z " * 9, "x", 1), (1001, "z " * 9, "x", 1)], docs.schema)
    docs = docs.unionByName(more)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = []
    for d, t in texts:
        words = periodic.repeated(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()), d)
        found = plain_runs(words)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        milli = 1000 * best[1] // best[2] if found else None
        said = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        want.append((d, len(found), *best, milli, sha(said), sha(b" ".join(w for i, w in enumerate(words) if i not in gone).decode())))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r[c] for c in names) for r in periodic.run_table(docs, planted=True).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(w[1] for w in want)
    assert periodic.run_table(docs.limit(0)).count() == 0


def test_collapse_runs(spark):
    docs = spark.createDataFrame([(1, "so so so so so so it is", None, None, 1), (2, "no  runs\there", None, None, 1), (3, None, None, None, None)], SCHEMA).selectExpr("*", "'k' AS row", "0 AS new")
    left = periodic.collapse_runs(docs)
    assert left.columns == docs.columns and plain(left) == {1: "so it is", 2: "no  runs\there", 3: None}
