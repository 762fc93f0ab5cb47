"""Exact, near and substring deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lexispark.llm import exact_dedup, near_dedup, substring_dedup, wordhash
from lexispark.llm.graph import components

from .helpers import SCHEMA, corpus, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact_twin(texts):
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[t or ""].append(d)
    return {d: (max(g), len(g)) for g in groups.values() for d in g}


def check_exact(docs, rows):
    texts = plain(docs)
    want = exact_twin(texts)
    assert len(rows) == len(texts)
    for r in rows:
        keep, n = want[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, n, keep == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_exact_groups(spark):
    docs = corpus(spark)
    check_exact(docs, exact_dedup.exact_groups(docs).collect())
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in exact_twin(plain(docs)).values()}


def test_colliding_digests_drop_no_document(spark):
    docs = corpus(spark)
    short = lambda t: F.substring(exact_dedup.sha256(t), 1, 1)
    weak = lambda t: F.when(F.length(t) > 0, F.lit(b"x")).otherwise(short(t))  # noqa: E731  all but empty texts collide
    check_exact(docs, exact_dedup.exact_groups(docs, weak).collect())


def test_exact_edge_cases(spark):
    assert exact_dedup.exact_groups(corpus(spark).limit(0)).count() == 0
    rows = [(5, "a", None, None, 1)] * 2 + [(None, "b", None, None, 1)] * 2 + [(None, "a", None, None, 1)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [(0, 2, False), (0, 2, True), (5, 3, False), (5, 3, False), (5, 3, True)]


def test_exact_groups_of_derived_tables(spark, tmp_path):
    """Rows that a plan makes of one scanned row, and columns named like locators, are told apart all the same."""
    spark.createDataFrame([(i, f"t{i % 3}", None, None, 1) for i in range(9)], SCHEMA).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    exploded = docs.withColumn("copy", F.explode(F.array(*map(F.lit, range(3)))))
    for df in (exploded, docs.withColumns({"__file": F.lit("f"), "__row": F.lit(1)}), docs.withColumns({"__file": F.lit("f"), "file": F.lit(1), "at": F.lit(2), "row": F.lit(3)})):
        kept = exact_dedup.drop_exact(df)
        assert kept.count() == 3 and kept.columns == df.columns
        assert exact_dedup.exact_groups(df).where("kept").count() == 3


def test_state_is_kept_between_runs(spark, tmp_path):
    state = str(tmp_path / "state")
    first = spark.createDataFrame([(1, "a", None, None, 1), (2, "a", None, None, 1), (3, "b", None, None, 1)], SCHEMA)
    second = spark.createDataFrame([(9, "a", None, None, 1), (0, "b", None, None, 1), (7, "c", None, None, 1)], SCHEMA)
    told = lambda df: {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df, state=state).collect()}
    assert told(first) == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}
    assert told(second) == {9: (9, 3, True), 0: (3, 2, False), 7: (7, 1, True)}
    weak = lambda t: F.lit(b"x")  # noqa: E731  every text collides, in old and new arrivals alike
    other = str(tmp_path / "weak")
    exact_dedup.exact_groups(first, weak, other).collect()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(second, weak, other).collect()}
    assert got == {9: (9, 3), 0: (3, 2), 7: (7, 1)}


def shingles(text, width):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def near_twin(texts, width, percent=80):
    sets = {d: shingles(t, width) for d, t in texts.items()}
    label = {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_near_groups_equal_brute_force(spark):
    docs = corpus(spark)
    for width in (4, 5):
        want = near_twin(plain(docs), width)
        got = near_dedup.near_groups(docs, width).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = near_dedup.drop_near(docs, 4)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in near_twin(plain(docs), 4).values()}


def family(seed=3, n=120, pairs=12):
    """Texts of one template just below the threshold, with pairs just above it."""
    draw = np.random.default_rng(seed)
    word = lambda: f"w{draw.integers(10**12)}"
    template = [word() for _ in range(400)]
    texts = {}
    for i in range(n):
        own = [word() for _ in range(55)]
        texts[i] = " ".join(template + own)
        if i < pairs:
            texts[1_000 + i] = " ".join(template + own[:9] + [word() for _ in range(46)])
    return texts


def test_pairs_inside_a_family_below_the_threshold(spark, monkeypatch):
    texts = family()
    want = near_twin(texts, 4)
    assert sum(c != d for d, (_, c) in want.items()) == 12
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in texts.items()], SCHEMA)
    for block in (near_dedup.BLOCK, 20):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = near_dedup.near_groups(docs, 4).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_common_counts():
    draw = np.random.default_rng(8)
    sets = [np.unique(draw.integers(0, 9_000, draw.integers(1, 6_000))) for _ in range(9)]
    got = near_dedup.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_near_edge_cases(spark):
    assert near_dedup.near_groups(corpus(spark).limit(0)).count() == 0
    rows = [(1, "a b c d e f", None, None, 1), (1, "a b c d e f", None, None, 1), (None, "a b c d e f", None, None, 1), (3, "one", None, None, 1), (4, "ONE", None, None, 1), (9, None, None, None, 1)]
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (3, 3, True), (4, 3, False), (9, 9, True)]


def test_densified_bins_agree_like_the_sets():
    draw = np.random.default_rng(5)
    same = []
    for _ in range(40):
        a = np.unique(draw.integers(0, 2**63, 10).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[:8], draw.integers(0, 2**63, 2).astype(np.uint64)]))
        x = near_dedup.sketch([a, b])
        same.append((x[0] == x[1]).mean())
    assert abs(np.mean(same) - 8 / 12) < 0.06


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def substring_twin(texts, length=20):
    seen, out = set(), {}
    for d in sorted(texts):
        words = WORD.findall(texts[d] or "")
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                gone[s : s + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    docs = corpus(spark)
    got = substring_dedup.remove_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == substring_twin(plain(docs))
    assert sum(r["n_removed"] for r in got) > 300


def test_repeats_of_common_words_and_within_a_document(spark):
    rows = [(1, "a " * 200, None, None, 1), (2, "a b " * 60 + "z", None, None, 1), (3, "x " + "a b " * 9 + "a b y", None, None, 1), (4, "short text", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = substring_dedup.remove_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == substring_twin(plain(docs))


def test_repeats_edge_cases(spark):
    assert substring_dedup.remove_repeats(corpus(spark).limit(0)).count() == 0
    long = " ".join(map(str, range(30)))
    rows = [(None, long, None, None, 1), (2, long, None, None, 1), (2, long, None, None, 1), (3, None, None, None, 1)]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0), (2, 30), (2, 30), (3, 0)]


def thue_morse(n=1024):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_made_to_collide_are_told_apart(spark):
    """Two words that any polynomial hash modulo a power of two confuses."""
    one, two = thue_morse()
    lead = " ".join(f"w{i}" for i in range(19))
    texts = {1: f"{lead} {one}", 2: f"{lead} {two}", 3: f"x y z {one}", 4: f"x y z {two}", 5: f"x y z {two}"}
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in texts.items()], SCHEMA)
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == dict.fromkeys(texts, 0)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs, 4).collect()} == near_twin(texts, 4)


def test_rows_that_share_a_doc_id_are_told_apart(spark):
    rows = [(3, "a b c d e f g h i j k"), (3, "other text with the id three"), (4, "other text WITH the id three"), (None, "other text with the id three")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 3, 0, True), (3, 3, 3, True), (3, 8, 3, True), (4, 3, 3, False)]


def test_repeats_of_one_long_word_and_of_null_ids(spark):
    rows = [(None, "n " * 30)] * 3 + [(5, "n " * 30), (6, "y" * 300_000 + " z" * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit(1), "at": F.lit(2), "gone": F.lit(3)})
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(0, 30, 29)] * 3 + [(5, 30, 30), (6, 26, 24)]


def test_word_codes_and_names(monkeypatch):
    texts = [b"One two\n three", b"", b"two three", "é two".encode(), b"a word-longer-than-fifteen-bytes a"]
    for piece in (1 << 21, 5):
        monkeypatch.setattr(wordhash, "PIECE", piece)
        low, high, at = wordhash.codes(texts)
        assert at.tolist() == [0, 3, 3, 5, 7, 10]
        names = wordhash.names(low, high).tolist()
        assert names[1] == names[3] == names[6] and names[2] == names[4] and names[7] == names[9] and len(set(names)) == 6
        pairs = wordhash.gram_names(np.array(names), 2)
        hashes = wordhash.grams(wordhash.hashes(low, high), 2)
        assert pairs[1] == pairs[3] and pairs[0] != pairs[1] and hashes[1] == hashes[3] and hashes[0] != hashes[1]
    upper = wordhash.codes([b"ONE"], lower=True)
    assert upper[0][0] == wordhash.codes([b"one"])[0][0]
    # Codes that share a hash still get names of their own.
    monkeypatch.setattr(wordhash, "hashes", lambda low, high: np.zeros(len(low), np.uint64))
    assert sorted(set(wordhash.names(*wordhash.codes([b"x y x z"])[:2]).tolist())) == [0, 1, 2]


def test_a_repeated_call_adds_nothing_to_the_state(spark, tmp_path, monkeypatch):
    """A call that fails before or after its batch is committed and is repeated keeps one row of each text."""
    docs = spark.createDataFrame([(i, f"text {i % 5}", None, None, 1) for i in range(10)], SCHEMA)
    for where in ("_state", "commit"):
        folder = str(tmp_path / where)
        owner = exact_dedup if where == "_state" else exact_dedup._Folder
        real = getattr(owner, where)

        def fail(*args):
            raise RuntimeError("lost")

        monkeypatch.setattr(owner, where, fail)
        for _ in range(2):
            try:
                exact_dedup.drop_exact(docs, folder)
            except RuntimeError:
                pass
        monkeypatch.setattr(owner, where, real)
        assert {r["doc_id"] for r in exact_dedup.drop_exact(docs, folder).collect()} == {5, 6, 7, 8, 9}
        again = exact_dedup.exact_groups(docs, state=folder).collect()
        assert {r["group_size"] for r in again} == {2} and sum(r["kept"] for r in again) == 5
        named = exact_dedup.exact_groups(docs, state=folder, batch="another").collect()
        assert {r["group_size"] for r in named} == {4}


def test_unlike_texts_under_one_doc_id(spark):
    """A row that is like nothing stays when another row with its doc_id is a near copy."""
    a, unique, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "aub")
    rows = [(0, a, None, None, 1), (1, unique, None, None, 1), (1, a + " more", None, None, 1), (2, b, None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 AS print", "8 AS gone")
    kept = near_dedup.drop_near(docs)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(0, a), (1, unique), (2, b)}
