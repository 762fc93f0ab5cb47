"""Whole runs on small inputs of our own, and the driver's contract."""

import json
import os

import pytest

from lexispark.operators import fusion, integrity
from lexispark.plans import catalog, durable, index, offline, online, stages, tables
from lexispark.session import shared_dir
from lexispark.operators.fusion import VIEWS

from .oracle_check import SF_DIR, differences


def fixture(tmp_path):
    """Two queries, five documents each, rankings equal in all views; the answers are known by hand."""
    (tmp_path / "traces/a").mkdir(parents=True)
    (tmp_path / "queries.csv").write_text("query_id,query,gold_citations\nqa,Which rule governs damages?,Art. 41 OR;BGE 145 III 1\n")
    (tmp_path / "laws.csv").write_text("citation\nArt. 41 OR\nArt. 97 OR\n")
    (tmp_path / "courts.csv").write_text("citation\nBGE 145 III 1\n")
    texts = ["See Art. 41 OR.", "Art. 41 OR applies.", "Art. 41 OR and Art. 97 OR.", "Art. 41 OR again.", "Nothing, or Art. 99 OR."]
    ranks = [{"query_id": "qa", "field": f, "rank": r, "doc_id": f"d{r}", "score": 1.0 / r, "metadata": {"fixture": True}} for f in VIEWS for r in range(1, 6)]
    (tmp_path / "rankings.jsonl").write_text("\n".join(map(json.dumps, ranks)))
    (tmp_path / "documents.jsonl").write_text("\n".join(json.dumps({"doc_id": f"d{i}", "full_document_text": t, "court": "x"}) for i, t in enumerate(texts, 1)))
    scores = [{"candidate_id": f"qa::d{i}", "rank": i, "score": 8.0 - i, "confidence": 1.0, "rationale": "r", "model": "m", "input_sha256": "", "batch_sha256": ""} for i in range(1, 6)]
    (tmp_path / "scores.jsonl").write_text("\n".join(map(json.dumps, scores)))
    hit = lambda c: {"citation": c, "source": "s", "score": 1.0}
    (tmp_path / "traces/a/trace.json").write_text(json.dumps({"query_id": "qa", "candidate_law_hits": [hit("Art. 97 OR")], "candidate_court_hits": [hit("BGE 145 III 1"), hit("BGE 145 III 1")]}))
    names = {n: f"{n}.{e}" for n, e in (("queries", "csv"), ("laws", "csv"), ("courts", "csv"), ("rankings", "jsonl"), ("documents", "jsonl"), ("scores", "jsonl"))} | {"traces": "traces"}
    (tmp_path / "config.toml").write_text("[paths]\n" + "\n".join(f'{k} = "{v}"' for k, v in names.items()) + "\n[retrieval]\nrrf_k = 60\n")
    return str(tmp_path / "config.toml")


def test_offline_run_from_files(spark, tmp_path):
    summary = offline.run_files(spark, fixture(tmp_path), str(tmp_path / "out"))
    assert summary["metrics"]["f1"] == 1.0
    assert (tmp_path / "out/submission.csv").read_text(encoding="utf-8-sig").splitlines() == ["query_id,predicted_citations", "qa,Art. 41 OR;BGE 145 III 1"]
    with pytest.raises(FileExistsError):
        offline.run_files(spark, str(tmp_path / "config.toml"), str(tmp_path / "out"))


def test_offline_run_refuses_gaps(spark, tmp_path):
    config = fixture(tmp_path)
    kept = (tmp_path / "scores.jsonl").read_text().splitlines()[1:]
    (tmp_path / "scores.jsonl").write_text("\n".join(kept))
    with pytest.raises(integrity.IntegrityError, match="missing"):
        offline.run_files(spark, config, str(tmp_path / "out"))


def test_index_build_and_retrieval(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "corpus").mkdir()
    (tmp_path / "views").mkdir()
    pq.write_table(pa.table({"full_text": ["alpha Art. 1 OR", "beta", "gamma"], "regeste": [None, "r", ""]}), tmp_path / "corpus/c.parquet", row_group_size=2)
    lines = [{"source_parquet": "c.parquet", "row_group": g, "row_index_in_group": r, "content": json.dumps({"normal_query": n})} for g, r, n in ((0, 0, "one"), (0, 1, "two"), (1, 0, "three"))]
    (tmp_path / "views/v.jsonl").write_text("\n".join(map(json.dumps, lines)))

    def make():
        def encode(texts):
            return [[1.0, 0.0, 0.0] if "one" in t or "alpha" in t else [0.0, 1.0, 0.0] if "two" in t or "beta" in t else [0.0, 0.0, 1.0] for t in texts]

        return encode

    args = (spark, str(tmp_path / "corpus"), str(tmp_path / "views"), str(tmp_path / "index"), make)
    manifest = index.build(*args, {"model": "m", "dims": 3}, step=2)
    assert manifest["rows"] == 3
    vectors = spark.read.parquet(str(tmp_path / "index/parts")).select("field", "idx", "v")
    assert vectors.count() == 15
    metadata = spark.read.parquet(str(tmp_path / "index/metadata"))
    queries = spark.createDataFrame([("q", f, [1.0, 0.0, 0.0]) for f in VIEWS], "query_id string, field string, q array<double>")
    found = offline.retrieve_index(queries, vectors, metadata, offline.Settings(per_view=1)).orderBy("rank").collect()
    assert found[0]["doc_id"] in ("c.parquet:rg0:row0", "c.parquet:rg1:row0") and len(found[0]["hits"]) >= 2
    assert {r["nonempty"]["citations"] for r in metadata.where("global_idx = 0").collect()} == {True}


def test_online_stages(spark):
    docs = spark.createDataFrame([("d1", "text of d1", ["Art. 1 OR"], "x"), ("d2", "text", ["BGE 1 I 1"], "x")], "doc_ref string, text string, citations array<string>, court string")
    ranking = lambda refs: spark.createDataFrame([("q", r, i) for i, r in enumerate(refs, 1)], "query_id string, doc_ref string, position int")
    hits = online.retrieve(ranking(["d1", "d2"]), ranking(["d2"]), docs)
    assert [r["doc_ref"] for r in hits.orderBy("rank").collect()] == ["d2", "d1"]
    vocabulary = spark.createDataFrame([("Art. 1 OR",), ("BGE 1 I 1",)], "citation string")
    reply = '{"score": 9, "confidence": 0.5, "rationale_de": "gut"}'
    replies = hits.selectExpr("query_id", "doc_ref", "rank", "citations", f"'{reply}' as response")
    scored, violations = online.score_documents(replies, vocabulary)
    assert violations.count() == 0
    bad = replies.selectExpr("query_id", "doc_ref", "rank", "array('Art. 9 OR') as citations", "'{\"score\": true}' as response")
    assert {r["rule"] for r in online.score_documents(bad, vocabulary)[1].collect()} >= {"reply", "closed vocabulary"}
    decided = online.control(scored, ranking(["d2"]), docs)
    assert {r["citation"]: r["accepted"] for r in decided.collect()} == {"Art. 1 OR": True, "BGE 1 I 1": True}
    assert online.answer_evidence(scored, decided, 1).count() == 1
    answers = spark.createDataFrame([("q", "By Art. 1 OR.")], "query_id string, answer string")
    assert online.check_answers(answers, decided, vocabulary).first()["problem"] is None
    views = online.changed_views(spark.createDataFrame([("q", "Which rule?")], "query_id string, query string"), spark.createDataFrame([("q", "Which rule?", "x", "which rule", "Which rule?", "Which rule?")], "query_id string, " + ", ".join(f"{v} string" for v in VIEWS)))
    assert views.first()["fields"] == ["meta_searchterm"] or "meta_searchterm" in views.first()["fields"]
    understood = online.understand(spark.createDataFrame([("q", "Art. 1 OR?")], "query_id string, query string"), spark.createDataFrame([("q", '{"issues": ["i"], "keywords": ["k"], "language": "de"}')], "query_id string, response string")).first()
    assert understood["explicit_citations"] == ["Art. 1 OR"] and understood["key_concepts"] == ["i", "k"] and understood["problem"] is None
    with pytest.raises(ValueError):
        online.check_settings(5, 3, 10, "http://x", ["*"], "short")


def test_contract(spark):
    import __spark_entry__ as contract

    found = contract.entry(spark)
    assert found.columns == ["query_id", "doc_ref", "rank", "fusion_score"] and found.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_analyses_run_with_the_defaults_of_their_operators(spark, monkeypatch):
    seen = {}

    def stand_in(name):
        def run(*args, **options):
            seen[name] = (len(args), options)
            raise KeyError(name)

        return run

    for query, operator in (("surrogate_fit", "gate_surrogate"), ("perturbation_baseline", "perturbation_faithfulness")):
        monkeypatch.setattr(catalog.analysis, operator, stand_in(operator))
        with pytest.raises(KeyError):
            catalog.queries()[query](spark, SF_DIR)
    assert seen == {"gate_surrogate": (1, {}), "perturbation_faithfulness": (1, {})}


def test_materialized_rows_of_several_files(spark, tmp_path):
    """A table of many files, whose rows are not numbered by doc_id, with a doc_id and a label that come twice."""
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 5), "de", "s") for i in [*range(40), 7]], "doc_id long, text string, lang string, source string")
    docs.repartition(5, "text").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(0, 60), 9]], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert not differences(spark, catalog.materialize_rows, catalog.oracle_sql()["materialize_rows"], connect_some(tmp_path), str(tmp_path))


def connect_some(folder):
    import duckdb

    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return connection


def test_plans_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    """Labels are ranked once, not once a query; line items and files of row groups are dealt by their size."""
    plan = catalog.online_rrf_two_source(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert any("windowspecdefinition(label" in line for line in plan.splitlines())
    rows = spark.range(1_000).withColumnRenamed("id", "k")
    assert tables.dealt(rows, "k", each=50).rdd.getNumPartitions() == 20
    monkeypatch.setattr(durable, "GROUPED", 1_000)
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    durable.row_group_reads(spark, SF_DIR)
    made = [d for d in os.listdir(shared_dir(spark).removeprefix("file://")) if d not in before and "groups" in d]
    assert len([f for f in os.listdir(f"{shared_dir(spark).removeprefix('file://')}/{made[0]}") if f.endswith(".parquet")]) > 3


def test_costly_rows_are_made_once(spark):
    """Citations of answers, and saved rankings, are written before the steps that read them several times."""
    answers = catalog.answer_validation(spark, SF_DIR)
    assert any("lexispark-answers" in f for f in answers.inputFiles()) and not any("lineitem" in f for f in answers.inputFiles())
    ranked = stages.saved_ranking_retrieval(spark, SF_DIR)
    assert any(".parquet" in f and "lexispark-rankings" in f for f in ranked.inputFiles()) and not any(f.endswith(".json") for f in ranked.inputFiles())


def test_saved_rankings_are_dealt_once(spark):
    """The lines are compressed and removed once kept; after that, groups, ranks and metadata need one exchange."""
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    ranked = stages.saved_ranking_retrieval(spark, SF_DIR)
    made = [d for d in os.listdir(folder) if d not in before and "rankings" in d]
    assert len(made) == 1 and any(f.endswith(".parquet") for f in os.listdir(f"{folder}/{made[0]}"))
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_rules_and_hits_of_saved_rankings(spark):
    """Repeated documents keep all their hits; each broken rule is found with its key."""
    shape = "query_id string, field string, rank int, doc_id string, score double, metadata string"
    queries = spark.createDataFrame([("q",)], "query_id string")
    good = [("q", f, r, d, 1.0 / r, '{"a":1}' if d == "x" else None) for f in VIEWS for r, d in ((1, "x"), (2, "y"), (3, "x"))]
    found = {r["doc_id"]: r for r in offline.retrieve_saved(queries, spark.createDataFrame(good, shape), offline.Settings()).collect()}
    assert [(h["field"], h["rank"]) for h in found["x"]["hits"]] == [(f, r) for f in VIEWS for r in (1, 3)] and found["x"]["metadata"] == '{"a":1}'
    assert [h["score"] for h in found["y"]["hits"]] == [0.5] * 5 and found["y"]["metadata"] is None and (found["x"]["rank"], found["y"]["rank"]) == (1, 2)

    def broken(rows):
        return {(v["rule"], v["key"]) for v in fusion.saved_ranking_violations(spark.createDataFrame(rows, shape), queries).collect()}

    assert broken(good) == set()
    assert broken([*good, ("q", "keywords", 3, "z", 1.0, None)]) == {("unique", "q::keywords::3"), ("contiguous ranks", "q::keywords")}
    assert broken([*good, ("q", "keywords", 5, "z", 1.0, None)]) == {("contiguous ranks", "q::keywords")}
    assert broken([r for r in good if r[1] != "fulltext"]) == {("no empty ranking", "q::fulltext")}
    assert broken([*good, ("p", "other", 1, "z", 1.0, None)]) == {("known query", "p"), ("known field", "p::other")}
    # A document without metadata has an empty object, which differs from any other.
    assert broken([*good, ("q", "keywords", 4, "x", 1.0, None)]) == {("one metadata object", "x")}
