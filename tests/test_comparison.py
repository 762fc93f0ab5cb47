"""Replays and comparisons pinned to inputs and results, settings, command lines, and the provider's replies."""

import hashlib
import io
import json
import math
import random
import statistics

import pytest

from lexispark import __main__ as cli
from lexispark.operators import analysis, candidates, integrity
from lexispark.plans import comparison, index, offline
from lexispark.sources import providers, readers

from .test_plans import fixture


def inputs(spark, tmp_path):
    fixture(tmp_path)
    queries = readers.query_table(spark, str(tmp_path / "queries.csv"), gold=True)
    documents = readers.documents(spark, str(tmp_path / "documents.jsonl"))
    traces = readers.sparse_traces(spark, str(tmp_path / "traces"))
    laws, courts = (readers.citation_table(spark, str(tmp_path / f"{n}.csv")) for n in ("laws", "courts"))
    prepared = spark.createDataFrame([("qa", f"qa::gi{i}", f"d{i}", i, i) for i in range(1, 6)], "query_id string, candidate_id string, doc_id string, rank int, global_idx long")
    return queries, documents, traces, laws, courts, prepared


def test_historical_replay_is_pinned(spark, tmp_path):
    queries, documents, traces, laws, courts, prepared = inputs(spark, tmp_path)
    scores = [(f"qa::rank{i}::gi{i}", 8.0 - i, 1.0) for i in range(1, 5)]
    lines = spark.createDataFrame([("m", True, "b1", scores[:2]), ("m", True, "b2", scores[2:]), ("other", False, "b3", [])], "model_key string, ok boolean, batch_id string, scores array<struct<candidate_id:string,score:double,confidence:double>>")
    want = comparison.Expected({"queries": "x"}, 5, 4, 2, {"qa::rank5::gi5"}, 1.0)
    run = lambda expected, actual={"queries": "x"}, rows=lines: comparison.historical_replay(queries, prepared, rows, documents, traces, laws, courts, "m", expected, actual)
    _, predicted, figures = run(want)
    assert figures["metrics"]["f1"] == 1.0 and predicted.first()["citations"] == ["Art. 41 OR", "BGE 145 III 1"]
    with pytest.raises(integrity.IntegrityError, match="pinned input"):
        run(want, {"queries": "y"})
    with pytest.raises(integrity.IntegrityError, match="another shape"):
        run(comparison.Expected({"queries": "x"}, 5, 5, 2, set(), 1.0))
    with pytest.raises(integrity.IntegrityError, match="macro F1"):
        run(comparison.Expected({"queries": "x"}, 5, 4, 2, {"qa::rank5::gi5"}, 1.0 - 1e-11))


def test_model_comparison_needs_whole_batches_of_one_model(spark, tmp_path):
    queries, documents, traces, laws, courts, prepared = inputs(spark, tmp_path)
    batched = candidates.batches(prepared, 5)
    scores = batched.selectExpr("candidate_id", "8.0D - rank AS score", "1.0D AS confidence", "'m' AS model")
    run = lambda s, shape=(1, 1, 5): comparison.model_comparison(queries, batched, s, documents, traces, laws, courts, ({"i": "x"}, {"i": "x"}), shape)
    assert run(scores)[1]["f1"] == 1.0
    with pytest.raises(integrity.IntegrityError, match="candidates"):
        run(scores, (1, 1, 6))
    with pytest.raises(integrity.IntegrityError, match="exactly one value"):
        run(scores.selectExpr("candidate_id", "score", "confidence", "candidate_id AS model"))
    with pytest.raises(integrity.IntegrityError, match="missing"):
        run(scores.where("score < 7"))


@pytest.mark.parametrize("bad", [{"base_url": "http://a"}, {"model": " "}, {"api_key_env": "1A"}, {"limit_batches": 21}, {"max_attempts": 0}, {"retry_delay_seconds": -1}, {"temperature": 2.5}])
def test_comparison_settings(bad):
    good = {"base_url": "https://a", "model": "m"}
    comparison.ComparisonConfig(**good)
    with pytest.raises(ValueError, match="settings break"):
        comparison.ComparisonConfig(**good | bad)


@pytest.mark.parametrize("bad", [{"model": " "}, {"model_revision": ""}, {"model_revision": "SET_IMMUTABLE_REVISION"}, {"batch_size_short": 0}, {"checkpoint_rows": -1}])
def test_encoding_settings(bad):
    with pytest.raises(ValueError):
        index.EncodingConfig(**{"model": "m", "model_revision": "r"} | bad)


def test_command_lines(spark, tmp_path, capsys):
    assert cli.main(["offline", fixture(tmp_path), "--output", str(tmp_path / "out")], spark) == 0
    assert json.loads(capsys.readouterr().out)["metrics"]["f1"] == 1.0
    lines = {"gold": ("gold_citations", ["a", "b"]), "retrieved": ("retrieved_citations", ["a", "c"]), "predicted": ("predicted_citations", ["a", "c"])}
    for name, (column, values) in lines.items():
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"query_id": "q", column: values}) + "\n")
    assert cli.main(["report", "--queries", str(tmp_path / "gold.jsonl"), "--retrieval", str(tmp_path / "retrieved.jsonl"), "--predictions", str(tmp_path / "predicted.jsonl"), "--output", str(tmp_path / "report")], spark) == 0
    assert json.loads(capsys.readouterr().out)["Predictions"] == {"precision": 0.5, "recall": 0.5}
    assert "| precision | 0.500000 |" in (tmp_path / "report/report.md").read_text()


def test_endpoint_over_a_stub(monkeypatch):
    with pytest.raises(ValueError, match="HTTPS"):
        providers.ChatEndpoint("http://a", "k", "m")
    sent = []

    def answer(request, timeout):
        sent.append((request.full_url, dict(request.header_items()), json.loads(request.data), timeout))
        return io.BytesIO(replies.pop(0).encode())

    monkeypatch.setattr(providers.urllib.request, "urlopen", answer)
    endpoint = providers.ChatEndpoint("https://a/v1/", "key", "m", timeout=5)
    body = lambda content, finish="stop": json.dumps({"choices": [{"message": {"content": content}, "finish_reason": finish}]})
    replies = [body("<think>x</think> yes"), body("cut", "length"), body(" "), "no json", body("<think>open"), "{}"]
    assert endpoint.complete("s", "u") == "yes"
    url, headers, data, timeout = sent[0]
    assert url == "https://a/v1/chat/completions" and headers["Authorization"] == "Bearer key" and data["messages"][1] == {"role": "user", "content": "u"} and data["response_format"] == {"type": "json_object"} and timeout == 5
    while replies:
        with pytest.raises(providers.ProviderError):
            endpoint.complete("s", "u")


def test_surrogate_equals_a_plain_descent(spark):
    draw = random.Random(2)
    rows = [(f"q{i}", "c", i % 3 == 0, {"a": draw.random() + (i % 3 == 0), "b": 2.0, "c": draw.random()}) for i in range(24)]
    got = {r["query_id"]: r for r in analysis.gate_surrogate(spark.createDataFrame(rows, "query_id string, citation string, accepted boolean, features map<string,double>"), iterations=60).collect()}
    rows.sort()
    names, n = ["a", "b", "c"], len(rows)
    mean = {f: sum(r[3][f] for r in rows) / n for f in names}
    scale = {f: math.sqrt(sum((r[3][f] - mean[f]) ** 2 for r in rows) / n) or 1.0 for f in names}
    z = [[(r[3][f] - mean[f]) / scale[f] for f in names] for r in rows]
    bias, w = 0.0, [0.0] * 3
    for _ in range(60):
        off = [1 / (1 + math.exp(-(bias + sum(a * b for a, b in zip(x, w))))) - r[2] for x, r in zip(z, rows)]
        bias, w = bias - 0.1 * sum(off) / n, [b - 0.1 * (sum(o * x[j] for o, x in zip(off, z)) / n + 0.01 * b) for j, b in enumerate(w)]
    p = [1 / (1 + math.exp(-(bias + sum(a * b for a, b in zip(x, w))))) for x in z]
    for r, q in zip(rows, p):
        assert math.isclose(got[r[0]]["probability"], q, rel_tol=1e-9) and got[r[0]]["prediction"] == (q >= 0.5)
    assert math.isclose(got["q0"]["brier"], sum((q - r[2]) ** 2 for q, r in zip(p, rows)) / n, rel_tol=1e-9)
    assert math.isclose(got["q0"]["log_loss"], -sum(math.log(q if r[2] else 1 - q) for q, r in zip(p, rows)) / n, rel_tol=1e-9)
    assert math.isclose(got["q0"]["raw_coefficients"]["a"], w[0] / scale["a"], rel_tol=1e-9)


def test_perturbation_baseline_equals_a_plain_draw(spark):
    ablations = [(f"f{i}", 1.0 - i / 10, i < 2) for i in range(7)]
    found = analysis.perturbation_faithfulness(spark.createDataFrame([("q", 1.0, ablations)], "query_id string, full_score double, ablations array<struct<feature:string,score_without_feature:double,is_evidence:boolean>>"), seed=17, trials=200).first()
    evidence, controls = ([1.0 - s for _, s, e in ablations if e == want] for want in (True, False))
    draw = random.Random(int.from_bytes(hashlib.sha256(b"17\0q").digest()[:8], "big"))
    means = [sum(draw.sample(controls, k=2)) / 2 for _ in range(200)]
    assert found["targeted_aopc"] == sum(evidence) / 2 and math.isclose(found["random_aopc"], sum(means) / 200, rel_tol=1e-12)
    assert math.isclose(found["random_std"], statistics.pstdev(means), rel_tol=1e-9) and math.isclose(found["gap"], sum(evidence) / 2 - sum(means) / 200, rel_tol=1e-9)


def test_settings_of_a_run_keep_their_defaults():
    assert offline.Settings.from_config({}) == offline.Settings()
