"""Fusion, support, candidates, gate, metrics and analyses on literal cases."""

import random

import pytest

from lexispark.operators import analysis, candidates, fusion, gate, integrity, metrics, support, verify


def test_rrf_ties_keep_the_order_of_first_meeting(spark):
    hits = spark.createDataFrame([("q", "dense", 1, "a"), ("q", "dense", 2, "b"), ("q", "bm25", 1, "b"), ("q", "bm25", 2, "a")], "query_id string, source string, position int, doc_ref string")
    rows = fusion.weighted_rrf(hits, {"dense": 1.0, "bm25": 1.0}).orderBy("rank").collect()
    assert [r["doc_ref"] for r in rows] == ["b", "a"] and rows[0]["sources"] == ["bm25", "dense"]


def test_rrf_counts_repeats_for_positions_only(spark):
    hits = spark.createDataFrame([("q", "s", 1, "a"), ("q", "s", 2, "a"), ("q", "s", 3, "b")], "query_id string, source string, position int, doc_ref string")
    found = {r["doc_ref"]: r["fusion_score"] for r in fusion.weighted_rrf(hits, {"s": 2.0}, k=10).collect()}
    assert found == {"a": 2.0 / 11, "b": 2.0 / 13}


def test_rrf_rejects_bad_weights():
    for weights, k in (({}, 60), ({"a": 0.0}, 60), ({"a": 1.0}, 0)):
        with pytest.raises(ValueError):
            fusion.check_weights(weights, k)


def test_five_view_fusion_matches_the_known_scores(spark):
    rows = [("q", f, p, f"d{(p + s - 1) % 5}") for s, f in enumerate(fusion.VIEWS) for p in range(1, 6)]
    got = {r["doc_ref"]: r["fusion_score"] for r in fusion.fuse_views(spark.createDataFrame(rows, "query_id string, source string, position int, doc_ref string")).collect()}
    for d in got:
        total = 0.0
        for s, f in enumerate(fusion.VIEWS):
            total += fusion.VIEW_WEIGHTS[f] / (60 + next(p for p in range(1, 6) if f"d{(p + s - 1) % 5}" == d))
        assert got[d] == total


def test_vector_top_k_in_blocks_equals_brute_force(spark):
    draw = random.Random(3)
    vectors = [[draw.choice([-1.0, 0.0, 1.0]) for _ in range(4)] for _ in range(60)]
    index = spark.createDataFrame(list(enumerate(vectors)), "idx long, v array<double>")
    queries = index.where("idx < 7").withColumnsRenamed({"idx": "query_id", "v": "q"})
    got = {(r["query_id"], r["position"]): r["idx"] for r in fusion.vector_top_k(queries, index, 5, on=(), block=300).collect()}
    for q in range(7):
        order = sorted(range(60), key=lambda i: (-sum(a * b for a, b in zip(vectors[q], vectors[i], strict=True)), -i))
        assert [got[q, p] for p in range(1, 6)] == order[:5]


def test_balanced_interleave(spark):
    hits = spark.createDataFrame([("q", "law", i, f"L{i}") for i in (1, 2, 3)] + [("q", "court", i, f"C{i}") for i in (1, 2, 3)], "query_id string, kind string, position int, name string")
    assert [r["name"] for r in support.balanced(hits, 5).orderBy("hit_pos").collect()] == ["L1", "C1", "C2", "L2", "C3"]
    courts = hits.where("kind = 'court'")
    assert [r["name"] for r in support.balanced(courts, 5).orderBy("hit_pos").collect()] == ["C1", "C2", "C3"]


def test_sparse_support_and_targeted_vocabulary(spark):
    hits = spark.createDataFrame([("q", "law", 1, "Art. 1 OR", None, "s", "see BGE 1 I 2 E. 3"), ("q", "court", 1, "BGE 1 I 2", "t", "s", "Art. 1 OR")], "query_id string, kind string, position int, citation string, title string, source string, text string")
    laws, courts = spark.createDataFrame([("Art. 1 OR",), ("X",)], "citation string"), spark.createDataFrame([("BGE 1 I 2",), ("X",)], "citation string")
    counts, out = support.sparse_support(hits, support.vocabulary(laws, courts), 5)
    assert {r["citation"]: r["support"] for r in counts.collect()} == {"Art. 1 OR": 2, "BGE 1 I 2": 2}
    assert {r["citation"] for r in out.collect()} == {"BGE 1 I 2 E. 3"}
    assert [r["key"] for r in support.vocabulary_overlap(support.vocabulary(laws, courts)).collect()] == ["X"]
    assert {r["kind"] for r in support.targeted_vocabulary(laws, courts, laws.where("citation = 'X'")).collect()} == {"law"}


def test_gate_reasons_and_wording(spark):
    rows = [("q", f"d{i}", i, s, c) for i, (s, c) in enumerate([(9.0, ["Art. 1 OR", "Art. 2 OR"]), (8.0, ["Art. 1 OR"]), (7.0, ["Art. 1 OR"]), (6.0, ["Art. 1 OR"]), (8.25, ["BGE 9 I 9"])], 1)]
    cands = spark.createDataFrame(rows, "query_id string, doc_ref string, rank int, score double, citations array<string>")
    sup = spark.createDataFrame([("q", "BGE 1 I 1", 2), ("q", "Art. 3 OR", 1)], "query_id string, citation string, support long")
    found = {r["citation"]: (r["accepted"], r["kind"], r["votes_text"]) for r in gate.decisions(gate.gate(cands, sup), gate.Policy()).collect()}
    assert found["Art. 1 OR"] == (True, "law", "dense vote 4/10 + top-1 score 9.0")
    assert found["Art. 2 OR"] == (True, "law", "top-1 score 9.0")
    assert found["BGE 1 I 1"] == (True, "court", "BM25 support 2/5")
    assert found["Art. 3 OR"] == (False, "law", "dense vote 0/10; BM25 support 1/5")
    assert found["BGE 9 I 9"] == (False, "court", "dense vote 1/10; BM25 support 0/5")


def test_policy_is_checked():
    with pytest.raises(ValueError):
        gate.Policy(candidates=0)
    with pytest.raises(ValueError):
        gate.Policy(anchor_score=11)
    assert "8.5" in gate.Policy().describe()


def test_macro_metrics(spark):
    gold = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "query_id string, gold array<string>")
    said = spark.createDataFrame([("a", ["x"]), ("b", ["p", "q", "r"])], "query_id string, predicted array<string>")
    row = metrics.macro(metrics.per_query(gold, said)).first()
    assert (row["f1"], row["tp"], row["fp"], row["fn"]) == (0.5, 1, 3, 1)
    assert metrics.macro(metrics.per_query(gold.limit(0), said)).first()["f1"] == 0.0


def test_error_attribution_and_context(spark):
    df = spark.createDataFrame([("a", ["g1", "g2", "g3"], ["g1", "g2", "r"], ["g1", "r", "n"])], "query_id string, gold array<string>, retrieved array<string>, predicted array<string>")
    row = analysis.error_attribution(df).first()
    assert [row[c] for c in analysis.CATEGORIES] == [["g1"], ["g3"], ["g2"], ["r"], ["n"], []]
    got = analysis.context_metrics(df, k=2).first()
    assert (got["context_precision"], got["context_recall"], got["faithfulness"]) == (1.0, 2 / 3, 1 / 3)
    empty = spark.createDataFrame([("a", [], [], [])], df.schema)
    assert set(analysis.context_metrics(empty).drop("query_id").first()) == {1.0}


def test_identity_and_references(spark):
    df = spark.createDataFrame([("q", None, 7, "d"), ("q", None, 11, "d"), ("q", "q::x", None, "d"), ("q", None, None, "d")], "query_id string, own string, idx long, doc string")
    ids = [r[0] for r in df.select(candidates.candidate_id(df["query_id"], df["own"], df["idx"], df["doc"])).collect()]
    assert ids == ["q::gi7", "q::gi11", "q::x", "q::d"]


def test_materialize_by_row_group(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "c.parquet")
    pq.write_table(pa.table({"n": list(range(10))}), path, row_group_size=4)
    offsets = candidates.row_group_offsets(spark, [path])
    refs = spark.createDataFrame([("c.parquet:rg1:row2",), ("c.parquet:rg2:row1",), ("c.parquet:rg0:row9",)], "doc_ref string")
    located = refs.select("doc_ref", candidates.parse_reference(refs["doc_ref"]).alias("l")).select("doc_ref", "l.*")
    got = {r["doc_ref"]: r["n"] for r in candidates.materialize(located, spark.read.parquet(path), offsets).collect()}
    assert got == {"c.parquet:rg1:row2": 6, "c.parquet:rg2:row1": 9}


def test_score_replies():
    good = '{"scores":[{"candidate_id":"a","score":3,"confidence":0.5,"rationale_de":"x"}]}'
    assert verify.parse_scores(good, ["a"]) == [("a", 3.0, 0.5, "x", None)]
    for bad in ("", "[]", '{"scores":1}', good.replace("3,", "true,"), good.replace("3,", "11,"), good.replace("0.5", "NaN"), good.replace('"x"', '" "'), good.replace('"a"', '""')):
        assert verify.parse_scores(bad, ["a"])[0][4] is not None
    assert verify.parse_scores(good, ["a", "b"])[0][4] == "candidate ids differ"


def test_live_scoring_retries_and_resumes(spark):
    rows = spark.createDataFrame([("q", f"q::{i}", i // 2, i % 2) for i in range(4)], "query_id string, candidate_id string, batch int, slot int")

    def provider():
        calls = []

        def ask(batch):
            calls.append(1)
            if len(calls) == 1:
                raise OSError("busy")
            import json

            return json.dumps({"scores": [{"candidate_id": r["candidate_id"], "score": 1, "confidence": 1, "rationale": "r"} for r in batch]})

        return ask

    done = spark.createDataFrame([("q", 0)], "query_id string, batch int")
    got = verify.score_batches(rows, provider, pause=0.0, done=done).collect()
    assert sorted(r["candidate_id"] for r in got) == ["q::2", "q::3"] and all(r["problem"] is None for r in got)
    failed = verify.score_batches(rows, provider, attempts=1, pause=0.0).collect()
    assert all("busy" in r["problem"] for r in failed)


def test_replay_needs_equal_digests(spark):
    prepared = spark.createDataFrame([("q", "q::a", "d", 1, "text", 0.5)], "query_id string, candidate_id string, doc_id string, rank int, document_text string, fusion_score double")
    prepared = prepared.selectExpr("*", "'ask' as query", "'' as meta_query", "'' as keywords_query", "cast(null as long) as global_idx")
    ready = verify.fingerprinted(prepared, "m", "v1", "system")
    digest = ready.first()["input_sha256"]
    saved = spark.createDataFrame([("q::a", 1, 9.0, 1.0, "r", "m", digest)], "candidate_id string, rank int, score double, confidence double, rationale string, model string, input_sha256 string")
    assert verify.replay(ready, saved, "m")[1].count() == 0
    assert {r["rule"] for r in verify.replay(ready, saved.withColumn("input_sha256", saved["model"]), "m")[1].collect()} == {"input digest"}


def test_surrogate_is_additive_and_repeats(spark):
    rows = [("q", f"c{i}", i % 3 == 0, {"a": float(i % 3), "b": float(i)}) for i in range(9)]
    df = spark.createDataFrame(rows, "query_id string, citation string, accepted boolean, features map<string,double>")
    got = analysis.gate_surrogate(df, iterations=200).collect()
    for r in got:
        assert abs(r["intercept"] + sum(r["contributions"].values()) - r["log_odds"]) < 1e-12
    assert got == analysis.gate_surrogate(df, iterations=200).collect()
    assert integrity.record_rules(df, ["citation"], integrity.gate_candidate_rules()).count() == 0
    assert integrity.surrogate_table_rules(df).count() == 0


def test_perturbation_effects(spark):
    schema = "query_id string, full_score double, ablations array<struct<feature:string,score_without_feature:double,is_evidence:boolean>>"
    df = spark.createDataFrame([("q", 1.0, [("a", 0.5, True), ("b", 0.7, True), ("c", 1.0, False), ("d", 0.9, False)])], schema)
    assert abs(analysis.perturbation_effects(df).first()["targeted_aopc"] - 0.4) < 1e-12
    a, b = (analysis.perturbation_faithfulness(df, trials=50).first() for _ in range(2))
    assert a == b and abs(a["gap"] - (a["targeted_aopc"] - a["random_aopc"])) < 1e-12


def test_integrity_finds_what_is_wrong(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1)], "g string, rank int")
    assert [r["key"] for r in integrity.contiguous(df, ["g"], "rank").collect()] == ["a"]
    with pytest.raises(integrity.IntegrityError):
        integrity.require(integrity.duplicates(df, ["g"]))
    integrity.require(integrity.duplicates(df, ["g", "rank"]))
    assert integrity.non_empty(df.limit(0)).count() == 1
