"""Sources, sinks and digests on small files."""

import hashlib
import json

import pytest

from lexispark.operators import digests, integrity
from lexispark.sources import readers, sinks


def test_json_lines_round_trip_and_failures(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    df = spark.createDataFrame([(2, "ä"), (1, None)], "z int, b string")
    sinks.write_json_lines(df, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["z"]) == [{"b": None, "z": 1}, {"b": "ä", "z": 2}]


def test_queries_and_submission(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿query_id,query,gold_citations\n q2 ,"two, lines",a; b\nq1,one,\n', encoding="utf-8")
    q = readers.query_table(spark, str(tmp_path / "q.csv"), gold=True)
    assert [r["query_id"] for r in q.orderBy("ordinal").collect()] == ["q2", "q1"]
    said = spark.createDataFrame([("q1", ["b", "a", "a"])], "query_id string, citations array<string>")
    sinks.write_submission(q, said, str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_text(encoding="utf-8") == "﻿query_id,predicted_citations\nq2,\nq1,a;b\n"
    assert {r["query_id"]: r["predicted"] for r in readers.submission(spark, str(tmp_path / "s.csv")).collect()} == {"q2": [], "q1": ["a", "b"]}
    (tmp_path / "bad.csv").write_text("query_id,query\nq,x\nq,y\n")
    with pytest.raises(integrity.IntegrityError):
        readers.query_table(spark, str(tmp_path / "bad.csv"))


def test_traces_rankings_and_views(spark, tmp_path):
    (tmp_path / "t/q1").mkdir(parents=True)
    (tmp_path / "t/q1/trace.json").write_text(json.dumps({"query_id": "q1", "candidate_law_hits": [{"citation": "L"}], "candidate_court_hits": [{"citation": "C"}, {"citation": "D"}]}, indent=1))
    assert {(r["kind"], r["position"], r["citation"]) for r in readers.sparse_traces(spark, str(tmp_path / "t")).collect()} == {("law", 1, "L"), ("court", 1, "C"), ("court", 2, "D")}
    (tmp_path / "v").mkdir()
    lines = [{"source_parquet": "x/c.parquet", "row_group": 0, "row_index_in_group": "1", "content": "{}"}, {"source_parquet": "c.parquet", "row_group": True, "row_index_in_group": "01"}]
    (tmp_path / "v/a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    views = readers.document_views(spark, str(tmp_path / "v"))
    rows = views.orderBy("global_idx").collect()
    assert (rows[0]["source_file"], rows[0]["row_group"], rows[0]["row_index"]) == ("c.parquet", 0, 1) and rows[1]["row_group"] is None and rows[1]["row_index"] is None
    offsets = spark.createDataFrame([("c.parquet", 0, 0, 5)], "file string, row_group long, first_row long, rows long")
    assert {r["rule"] for r in readers.view_record_violations(views, offsets).collect()} == {"row group", "row", "known row group", "row in group"}


def test_half_matrix_and_index(spark, tmp_path):
    import numpy as np

    values = np.eye(3, dtype="<f2")
    (tmp_path / "m.bin").write_bytes(values.tobytes())
    rows = readers.half_matrix(spark, str(tmp_path / "m.bin"), 3, 3, "keywords")
    assert [r["v"] for r in rows.orderBy("idx").collect()] == values.tolist()
    manifest = {"fields": ["keywords"], "dtype": "float16", "rows": 3, "dims": 3, "model": "m", "revision": "r"}
    sinks.write_index(rows, spark.range(3).withColumnRenamed("id", "global_idx"), manifest, str(tmp_path / "index"))
    assert readers.index_manifest(str(tmp_path / "index/manifest.json"), ["keywords"], "m", "r")["rows"] == 3
    with pytest.raises(FileExistsError):
        sinks.refuse_non_empty(spark, str(tmp_path / "index"))
    with pytest.raises(integrity.IntegrityError):
        readers.index_manifest(str(tmp_path / "index/manifest.json"), ["keywords"], "other")


def test_tree_digest_orders_by_path_component(spark, tmp_path):
    for name, data in (("a/b.txt", b"1"), ("a.txt", b"2"), ("a/c/d", b"3")):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_bytes(data)
    files = digests.file_digests(spark, str(tmp_path / "tree"))
    want = hashlib.sha256()
    for name in sorted(["a/b.txt", "a.txt", "a/c/d"], key=lambda p: p.split("/")):
        want.update(f"{name}\0{hashlib.sha256((tmp_path / 'tree' / name).read_bytes()).hexdigest()}".encode())
    row = digests.tree_digest(files).first()
    assert (row["sha256"], row["files"], row["bytes"]) == (want.hexdigest(), 3, 3)


def test_missing_files_are_told(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="laws is missing"):
        readers.exists(spark, str(tmp_path / "none"), "laws")


def test_settings_files_and_providers(spark, tmp_path):
    from lexispark.sources import providers, settings

    env = {"SERVICE_BASE_URL": "https://x", "SERVICE_TOKEN": "t" * 16, "SERVICE_MODELS": "a, b,a", "SERVICE_ORIGINS": "https://o", "SERVICE_RERANK_N": "7"}
    got = settings.ServiceSettings.from_environment(env)
    assert got.models == ("a", "b") and got.rerank_n == 7
    for change in ({"SERVICE_TOKEN": ""}, {"SERVICE_RERANK_N": "0"}, {"SERVICE_ORIGINS": "*"}, {"SERVICE_BASE_URL": "http://x"}):
        with pytest.raises(ValueError):
            settings.ServiceSettings.from_environment(env | change)
    (tmp_path / "b.parquet").write_text("")
    (tmp_path / "a.parquet").write_text("")
    assert [p.rsplit("/", 1)[1] for p in settings.corpus_files(spark, str(tmp_path), "*.parquet")] == ["a.parquet", "b.parquet"]
    with pytest.raises(FileNotFoundError):
        settings.corpus_files(spark, str(tmp_path), "*.csv")
    body = lambda text, reason="stop": json.dumps({"choices": [{"message": {"content": text}, "finish_reason": reason}]})
    assert providers.content_of(body("<think>x</think> yes")) == "yes"
    for bad in ("{}", body(" "), body("x", "length"), body("<think>x"), body("a</think>")):
        with pytest.raises(providers.ProviderError):
            providers.content_of(bad)
    with pytest.raises(ValueError):
        providers.ChatEndpoint("http://x", "k", "m")
    assert providers.ChatEndpoint("https://x/v1/", "k", "m").request("s", "u").full_url == "https://x/v1/chat/completions"


def test_analysis_inputs(spark, tmp_path):
    write = lambda name, rows: (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
    write("q", [{"query_id": "a", "query": "x", "gold_citations": ["g"]}])
    write("r", [{"query_id": "a", "retrieved_citations": ["g", "h"]}])
    write("p", [{"query_id": "a", "predicted_citations": []}])
    paths = [str(tmp_path / n) for n in "qrp"]
    assert readers.analysis_tables(spark, *paths).first()["retrieved"] == ["g", "h"]
    write("p", [{"query_id": "b", "predicted_citations": []}])
    with pytest.raises(integrity.IntegrityError):
        readers.analysis_tables(spark, *paths)


def test_batches_and_checkpoints(spark):
    from lexispark.operators import candidates, verify

    rows = candidates.batches(spark.createDataFrame([("q", f"q::{i}", i) for i in (1, 2, 3)], "query_id string, candidate_id string, rank int"), 2)
    assert verify.batch_shape(rows, 1, 2, 3).count() == 0 and verify.batch_shape(rows, 1, 2, 4).count() == 1
    now = rows.selectExpr("query_id", "batch", "concat('h', batch) as batch_sha256", "candidate_id")
    assert verify.checkpoint_violations(now.where("batch = 0"), now).count() == 0
    assert {r["rule"] for r in verify.checkpoint_violations(now.where("candidate_id = 'q::1'"), now).collect()} == {"incomplete batch"}
    assert {r["rule"] for r in verify.checkpoint_violations(now.withColumn("batch_sha256", now["candidate_id"]), now).collect()} == {"stale batch"}
    with pytest.raises(integrity.IntegrityError):
        verify.same_settings({"a": 1}, {"a": 2})


def test_trees_are_listed_and_written_by_executors(spark, tmp_path, monkeypatch):
    """Files at any depth, names that URIs would escape, a root that is a file; the driver asks for no list."""
    rows = spark.range(50).selectExpr("id % 7 as folder", "concat('f%41 ', id, '.txt') as name", "repeat('x', cast(id as int)) as text")
    root = tmp_path / "tree"
    assert sinks.write_files(rows, str(root)) == 50
    (root / "deep" / "er").mkdir(parents=True)
    for name in ("deep/er/a.txt", "top.txt", "deep/_hidden.txt", "deep/b.csv"):
        (root / name).write_text(name)
    found = {r["path"]: (r["size"], r["sha256"]) for r in digests.file_digests(spark, str(root), "*.txt").collect()}
    want = {str(p.relative_to(root)): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in root.rglob("*.txt") if not p.name.startswith("_")}
    assert found == want and len(found) == 52
    assert [r["path"] for r in digests.file_digests(spark, str(root / "top.txt")).collect()] == ["top.txt"]
    with pytest.raises(FileNotFoundError):
        digests.file_digests(spark, str(root / "none"))
