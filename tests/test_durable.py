"""What must outlive a run: files published whole, raw matrices, point reads, resumed builds, scores paid for once."""

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexispark.operators import fusion, integrity, verify
from lexispark.plans import index
from lexispark.sources import matrices, places, rowgroups, sinks

# -- publishing


def test_a_failing_rename_leaves_the_old_file_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m.json")
    sinks.write_json(spark, path, {"a": 1})
    sinks.write_json(spark, path, {"a": 2, "é": None})
    assert (tmp_path / "m.json").read_text() == '{\n  "a": 2,\n  "é": null\n}\n'

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(places, "replace_file", fail)
    with pytest.raises(OSError):
        sinks.write_json(spark, path, {"a": 3})
    assert json.loads((tmp_path / "m.json").read_text())["a"] == 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["m.json"]


def test_a_failing_rename_leaves_the_old_folder_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    sinks.write_json_lines(spark.range(3), path)
    sinks.write_json_lines(spark.range(5), path)
    assert spark.read.json(path).count() == 5
    real = places.hadoop

    class Failing:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return False if ".partial" in a.toString() else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(places, "hadoop", lambda s, p: (Failing(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(OSError):
        sinks.write_json_lines(spark.range(9), path)
    monkeypatch.setattr(places, "hadoop", real)
    assert spark.read.json(path).count() == 5


def test_an_interrupted_replacement_is_undone(spark, tmp_path):
    (tmp_path / "rows.replaced").mkdir()
    (tmp_path / "rows.replaced/old").write_text("x")
    places.restore_folder(spark, str(tmp_path / "rows"))
    assert (tmp_path / "rows/old").read_text() == "x" and not (tmp_path / "rows.replaced").exists()


# -- raw matrices


def vectors_of(spark, n, dims=3, fields=("a", "b")):
    rows = [(f, i, [float((i * 7 + j + k) % 11) / 8 for k in range(dims)]) for j, f in enumerate(fields) for i in range(n)]
    return spark.createDataFrame(rows, "field string, idx long, v array<double>").repartition(5), rows


def test_matrices_have_exact_bytes_and_come_back(spark, tmp_path):
    df, rows = vectors_of(spark, 23)
    matrices.write(df, str(tmp_path / "m"), ["a", "b"], 23, 3, step=10)
    files = matrices.listing(spark, str(tmp_path / "m"))["files"]
    assert [(f["field"], f["first"], f["rows"]) for f in files] == [(f, a, n) for f in "ab" for a, n in ((0, 10), (10, 10), (20, 3))]
    for f in files:
        raw = (tmp_path / "m" / f["file"]).read_bytes()
        want = np.array([v for g, i, v in rows if g == f["field"] and f["first"] <= i < f["first"] + f["rows"]], "<f2")
        assert raw == want.tobytes() and f["sha256"] == hashlib.sha256(raw).hexdigest()
    back = matrices.read_listed(spark, str(tmp_path / "m"), span=4)
    assert back.rdd.getNumPartitions() == 2 * (3 + 3 + 1)
    assert sorted((r["field"], r["idx"], r["v"]) for r in back.collect()) == sorted(rows)
    assert not [p for p in os.listdir(tmp_path / "m") if p.startswith("_staging")]


def test_matrices_refuse_gaps_and_wrong_sizes(spark, tmp_path):
    df, _ = vectors_of(spark, 8)
    for bad, rows, dims in ((df.where("idx <> 4"), 8, 3), (df.union(df.where("idx = 2")), 8, 3), (df, 9, 3), (df, 8, 4), (df.where("field = 'a'"), 8, 3)):
        path = tmp_path / f"bad{rows}{dims}{bad.count()}"
        with pytest.raises(Exception, match="gap|rows|components"):
            matrices.write(bad, str(path), ["a", "b"], rows, dims, step=100)
        assert not (path / matrices.LISTING).exists()
    (tmp_path / "short.f16").write_bytes(b"\0" * 10)
    with pytest.raises(Exception, match="bytes"):
        matrices.read(spark, [("a", str(tmp_path / "short.f16"), 0, 2)], 3).collect()


# -- point reads


def corpus_of(tmp_path):
    (tmp_path / "corpus").mkdir()
    pq.write_table(pa.table({"n": list(range(40)), "t": [f"text {i}" * 50 for i in range(40)]}), tmp_path / "corpus/a.parquet", row_group_size=10)
    pq.write_table(pa.table({"n": list(range(100, 107))}), tmp_path / "corpus/b.parquet", row_group_size=4)
    return str(tmp_path / "corpus")


REFERENCE = "doc_ref string, file string, row_group long, row long"


def test_point_reads_open_wanted_groups_only(spark, tmp_path):
    """The pages of a group that is not asked for are overwritten with rubbish; nobody notices."""
    root = corpus_of(tmp_path)
    corpus = spark.read.schema("n long, t string").parquet(root)
    offsets = sorted(tuple(r) for r in rowgroups.footers(spark, corpus.inputFiles()).collect())
    assert offsets == [("a.parquet", g, 10 * g, 10) for g in range(4)] + [("b.parquet", 0, 0, 4), ("b.parquet", 1, 4, 3)]
    meta = pq.ParquetFile(f"{root}/a.parquet").metadata
    data = bytearray((tmp_path / "corpus/a.parquet").read_bytes())
    for g in (0, 2):
        for c in range(2):
            column = meta.row_group(g).column(c)
            at = column.dictionary_page_offset or column.data_page_offset
            data[at : at + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    (tmp_path / "corpus/a.parquet").write_bytes(data)
    refs = spark.createDataFrame([("x", "a.parquet", 1, 9), ("y", "a.parquet", 1, 0), ("y", "a.parquet", 1, 0), ("y2", "a.parquet", 1, 0), ("z", "a.parquet", 3, 5), ("w", "b.parquet", 1, 2)], REFERENCE)
    got = {r["doc_ref"]: (r["n"], r["t"]) for r in rowgroups.point_read(refs, corpus).collect()}
    assert got == {"x": (19, "text 19" * 50), "y": (10, "text 10" * 50), "y2": (10, "text 10" * 50), "z": (35, "text 35" * 50), "w": (106, None)}
    assert rowgroups.point_read(refs, corpus, ["n"]).columns == ["n", "doc_ref"]
    assert rowgroups.point_read(refs.limit(0), corpus).count() == 0
    broken = spark.createDataFrame([("x", "a.parquet", 2, 1)], REFERENCE)
    with pytest.raises(Exception):
        rowgroups.point_read(broken, corpus).collect()


@pytest.mark.parametrize("file, group, row, what", [("a.parquet", 4, 0, "IndexError"), ("a.parquet", 1, 10, "IndexError"), ("b.parquet", 1, 3, "IndexError"), ("c.parquet", 0, 0, "FileNotFoundError")])
def test_point_reads_out_of_range_are_errors(spark, tmp_path, file, group, row, what):
    corpus = spark.read.parquet(corpus_of(tmp_path))
    with pytest.raises(Exception, match=what):
        rowgroups.point_read(spark.createDataFrame([("r", file, group, row)], REFERENCE), corpus).collect()


# -- the build ledger


def inputs(tmp_path, n=11):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "views").mkdir()
    pq.write_table(pa.table({"full_text": [f"text {i} Art. {i + 1} OR" for i in range(n)]}), tmp_path / "corpus/c.parquet", row_group_size=3)
    lines = [{"source_parquet": "c.parquet", "row_group": i // 3, "row_index_in_group": i % 3, "content": json.dumps({"normal_query": f"q{i}"})} for i in range(n)]
    (tmp_path / "views/v.jsonl").write_text("\n".join(map(json.dumps, lines)))
    return str(tmp_path / "corpus"), str(tmp_path / "views")


def encoder(scale=1.0, width=2):
    return lambda: lambda texts: [[len(t) * scale / 64, *[0.5] * (width - 1)] for t in texts]


def matrix_bytes(root):
    out = {}
    for f in json.loads((root / "matrices/listing.json").read_text())["files"]:
        out[f["file"]] = (root / "matrices" / f["file"]).read_bytes()
    return out


def test_a_resumed_build_equals_an_uninterrupted_one(spark, tmp_path):
    corpus, views = inputs(tmp_path)
    settings = {"model": "m", "revision": "r"}
    whole = index.build(spark, corpus, views, str(tmp_path / "whole"), encoder(), settings, step=4)
    part = str(tmp_path / "part")

    def failing():
        def encode(texts):
            if any("q5" in t for t in texts):
                raise RuntimeError("lost")
            return encoder()()(texts)

        return encode

    with pytest.raises(Exception, match="lost"):
        index.build(spark, corpus, views, part, failing, settings, step=4)
    ledger = json.loads((tmp_path / "part/_state/ledger.json").read_text())
    assert ledger["committed"] == [[0, 0]] and not (tmp_path / "part/manifest.json").exists()
    with pytest.raises(FileExistsError):
        index.build(spark, corpus, views, part, encoder(), settings, step=4)
    assert index.build(spark, corpus, views, part, encoder(), settings, step=4, resume=True, sitting=1)["committed"] == [[0, 1]]
    resumed = index.build(spark, corpus, views, part, encoder(), settings, step=4, resume=True)
    assert resumed == whole and matrix_bytes(tmp_path / "part") == matrix_bytes(tmp_path / "whole")
    assert (tmp_path / "part/manifest.json").read_bytes() == (tmp_path / "whole/manifest.json").read_bytes()
    assert len(matrix_bytes(tmp_path / "whole")) == 15 and all(len(b) == (4 if "-4.f16" in n else 3) * 2 * 2 for n, b in matrix_bytes(tmp_path / "whole").items())
    with pytest.raises(FileExistsError):
        index.build(spark, corpus, views, part, encoder(), settings, step=4, resume=True)


def test_a_build_is_resumed_with_what_it_was_begun_with_only(spark, tmp_path):
    corpus, views = inputs(tmp_path, 5)
    output, settings = str(tmp_path / "out"), {"model": "m", "revision": "r"}
    with pytest.raises(FileNotFoundError):
        index.build(spark, corpus, views, output, encoder(), settings, step=2, resume=True)
    index.build(spark, corpus, views, output, encoder(), settings, step=2, sitting=1)
    for options in ({"make_encoder": encoder(width=3)}, {"manifest": settings | {"model": "b"}}, {"step": 3}):
        given = {"make_encoder": encoder(), "manifest": settings, "step": 2} | options
        with pytest.raises(integrity.IntegrityError, match="other inputs or settings"):
            index.build(spark, corpus, views, output, resume=True, **given)
    ledger = tmp_path / "out/_state/ledger.json"
    good = json.loads(ledger.read_text())
    for bad in ({"schema_version": 2}, {"extra": 1}, {"committed": [[0, 9]]}, {"committed": [[1, 0]]}):
        (tmp_path / "out/_state/.ledger.json.crc").unlink(missing_ok=True)
        ledger.write_text(json.dumps(good | bad))
        with pytest.raises(integrity.IntegrityError):
            index.build(spark, corpus, views, output, encoder(), settings, step=2, resume=True)
    ledger.write_text(json.dumps(good))
    with open(tmp_path / "views/v.jsonl", "a") as more:
        more.write("\n" + json.dumps({"source_parquet": "c.parquet", "row_group": 0, "row_index_in_group": 0, "content": "{}"}))
    with pytest.raises(integrity.IntegrityError):
        index.build(spark, corpus, views, output, encoder(), settings, step=2, resume=True)


def test_ledger_merges_stretches():
    ledger = index.Ledger(1, "f", 100, 2, 10, True, [])
    for n in (3, 1, 0, 7, 2, 9, 8):
        ledger.commit(n)
    assert ledger.committed == [[0, 3], [7, 9]] and ledger.has(8) and not ledger.has(5)


# -- heaps


@pytest.mark.parametrize("k, tasks", [(1, 1), (7, 4), (50, 8), (500, 3)])
def test_heaps_equal_a_full_sort(spark, k, tasks, monkeypatch):
    draw = np.random.default_rng(k)
    rows = [(f, i, draw.integers(-3, 4, 5).astype(float).tolist()) for f in ("a", "b") for i in range(300)]
    rows += [("a", 900, None), ("a", 901, [1.0]), ("b", 902, [float("nan")] * 5), (None, 903, [1.0] * 5)]
    index_ = spark.createDataFrame(rows, "field string, idx long, v array<double>").repartition(tasks)
    queries = spark.createDataFrame([(f"q{i}", f, draw.integers(-3, 4, 5).astype(float).tolist()) for i in range(40) for f in ("a", "b")] + [("none", "a", None)], "query_id string, field string, q array<double>")
    monkeypatch.setattr(fusion, "INDEX_BLOCK", 16)
    want = {}
    for q, f, v in queries.where("q is not null").collect():
        own = sorted(((float(np.dot(v, x)), i) for g, i, x in rows if g == f and x is not None and len(x) == 5 and not np.isnan(x).any()), reverse=True)[:k]
        want |= {(q, f, p): (i, s) for p, (s, i) in enumerate(own, 1)}
    for block in (1 << 20, 3_000):
        got = {(r["query_id"], r["field"], r["position"]): (r["idx"], r["score"]) for r in fusion.vector_top_k(queries, index_, k, block=block).collect()}
        assert got == want
    plan = fusion.vector_top_k(queries, index_, k)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def asked_batches(spark, folder, n=200):
    """Batches of two rows, and a provider that notes whom it was asked for."""
    rows = spark.range(2 * n).selectExpr("cast(id div 20 as string) as query_id", "concat('c', id) as candidate_id", "cast(id div 2 % 10 as int) as batch", "cast(id % 2 as int) as slot")
    lines = places.Lines(str(folder))

    def make():
        def ask(batch):
            lines.add(json.dumps({"who": batch[0]["candidate_id"]}).encode())
            return json.dumps({"scores": [{"candidate_id": r["candidate_id"], "score": 1, "confidence": 1, "rationale": "r"} for r in batch]})

        return ask

    return rows, make


def test_scored_batches_are_lines_of_few_files_and_asked_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(verify, "BUCKETS", 3)
    rows, make = asked_batches(spark, tmp_path / "asked")
    store = str(tmp_path / "store")
    found = verify.score_batches(rows, make, store=store)
    assert found.count() == found.count() == 400
    files = [os.path.join(top, name) for top, _, names in os.walk(store) for name in names]
    assert len(files) == 3
    with open(files[0], "rb+") as out:  # a task that ended in the middle of its last line
        out.truncate(os.path.getsize(files[0]) - 5)
    assert verify.stored_scores(spark, store).count() == 398
    assert found.where("problem is null").count() == 400 and verify.stored_scores(spark, store).count() == 400
    assert spark.read.json(str(tmp_path / "asked")).groupBy("who").count().where("count > 1").count() == 1


def test_batches_are_scored_by_streams_of_rows(spark, tmp_path):
    """No group of a batch is dealt to pandas, and the rows of a batch come in their order, whatever the dealing."""
    rows, make = asked_batches(spark, tmp_path / "asked")
    found = verify.score_batches(rows.repartition(7), make)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["query_id"], r["batch"], r["candidate_id"]) for r in found.collect()} == {(r["query_id"], r["batch"], r["candidate_id"]) for r in rows.collect()}
    firsts = {r["who"] for r in spark.read.json(str(tmp_path / "asked")).collect()}
    assert firsts == {f"c{i}" for i in range(0, 400, 2)}


def test_heaps_hold_half_as_much_again_at_most(spark):
    """Rows that wait are cut while a block is scored, and deals count the bytes that heaps take."""
    draw = np.random.default_rng(3)
    heaps, most = fusion.Heaps(draw.normal(size=(600, 4)), 400), 0
    for at in range(0, 8_192, 1_024):
        heaps.add(np.arange(at, at + 1_024), draw.normal(size=(1_024, 4)))
        most = max(most, sum(len(p[0]) for p in heaps.parts))
    assert most <= 1.5 * 600 * 400 + fusion.QUERY_BLOCK * fusion.INDEX_BLOCK
    queries = spark.range(1_000).selectExpr("id as query_id", "'a' as field", "array(1d) as q")
    index_ = spark.range(5).selectExpr("id as idx", "'a' as field", "array(2d) as v")
    plan = fusion.vector_top_k(queries, index_, 1_000)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") >= 2
