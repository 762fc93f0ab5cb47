"""Ordered folds, served event streams, scores that are paid for once, and the surrogate over many tasks."""

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import Row

from lexispark.operators import analysis, verify
from lexispark.streaming import ordered, runs, served

# -- ordered fold


def keep(states: list):
    return lambda rows, number: states.append((number, [r.asDict() for r in rows.collect()]))


def run_events():
    kinds = ["run_start", *["step_start", "step_complete"] * 6, "final_answer", "run_complete", "stream_end"]
    return [(key, i, kind, key, (i + 1) // 2 if "step" in kind else None, None) for key in ("r1", "r2", "r3") for i, kind in enumerate(kinds)]


def test_events_shuffled_over_batches_give_the_batch_result(spark, tmp_path, monkeypatch):
    events = run_events()
    draw = random.Random(4)
    mixed = events + draw.sample(events, 9)
    draw.shuffle(mixed)
    parts = [mixed[i::5] for i in range(5)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, runs.EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema(runs.EVENT).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states: list = []
    ordered.fold_ordered(stream, idle=None).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(keep(states)).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    last = {r["run_key"]: r for _, rows in sorted(states, key=lambda s: s[0]) for r in rows}
    want = {r["run_key"]: r.asDict() for r in runs.fold_batch(spark.createDataFrame(events, runs.EVENT)).collect()}
    assert len(states) >= 5 and set(last) == set(want)
    for key, row in want.items():
        assert {k: v for k, v in last[key].items() if k != "following"} == row and last[key]["following"] == 16


def test_runs_that_never_end_leave_the_state(spark, tmp_path):
    """One run waits for an event that is missing, one is cut off, one has ended."""
    rows = [("gap", 0, "run_start", "gap", None, None), ("gap", 2, "run_complete", "gap", None, None), ("cut", 0, "run_start", "cut", None, None), ("end", 0, "run_start", "end", None, None), ("end", 1, "run_complete", "end", None, None)]
    spark.createDataFrame(rows, runs.EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    states: list = []
    stream = spark.readStream.schema(runs.EVENT).parquet(str(tmp_path / "in"))
    query = ordered.fold_ordered(stream, idle=1).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(keep(states)).start()
    until = time.time() + 90
    while time.time() < until and sum(len(r) for _, r in states) < 5:
        time.sleep(0.5)
    query.stop()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    last = {r["run_key"]: r for _, rows in sorted(states, key=lambda s: s[0]) for r in rows}
    assert {k: (r["status"], r["error"]) for k, r in last.items()} == {"gap": ("error", "event 1 is missing"), "cut": ("error", "no event for too long"), "end": ("completed", None)}


class Held:
    """The state of one run, in place of a stream's, and the calls to it."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def getValueState(self, name, schema):
        return Value(self)

    def getMapState(self, name, key, value):
        return Map(self)


class Value:
    def __init__(self, held):
        self.held = held

    def exists(self):
        self.held.calls += 1
        return self.held.value is not None

    def get(self):
        self.held.calls += 1
        return self.held.value

    def update(self, value):
        self.held.calls += 1
        self.held.value = value

    def clear(self):
        self.held.value = None


class Map(Value):
    def exists(self):
        self.held.calls += 1
        return bool(self.held.map)

    def containsKey(self, key):
        self.held.calls += 1
        return key in self.held.map

    def getValue(self, key):
        self.held.calls += 1
        return self.held.map[key]

    def updateValue(self, key, value):
        self.held.calls += 1
        self.held.map[key] = value

    def removeKey(self, key):
        self.held.calls += 1
        del self.held.map[key]

    def clear(self):
        self.held.map.clear()


def told(fold, events):
    """The row of a micro-batch of events (seq, type, run_id, step, message)."""
    names = ("seq", "type", "run_id", "step", "message")
    (row,) = fold.handleInputRows(("r",), iter([Row(event=json.dumps(dict(zip(names, e)))) for e in events]), None)
    return json.loads(row[0])


def test_waiting_events_are_kept_by_pages():
    draw = random.Random(5)
    events = [(i, draw.choice(["step_start", "step_complete", "error"]), "r", i % 6 + 1, f"{i}") for i in range(1_000)]
    mixed = events + draw.sample(events, 300)
    draw.shuffle(mixed)
    held, fold = Held(), ordered.OrderedFold(None)
    fold.init(held)
    for i in range(4):
        row = told(fold, mixed[i::4])
    whole = runs.Fold()
    for _, *event in events:
        whole.add(*event)
    status, server, steps, *rest = whole.state()
    assert [row["status"], row["server_run"], {s["step"]: s["is"] for s in row["steps"]}, row["error"], row["answered"], row["events"]] == [status, server, steps, *rest]
    assert row["following"] == 1_000 and held.map == {}
    assert held.calls < 150  # not one for each event that waits


def test_an_event_that_waited_and_comes_again_does_not_wait_on():
    held, fold = Held(), ordered.OrderedFold(None)
    fold.init(held)
    far = ordered.PAGE + 3
    told(fold, [(2, "run_complete", "r", None, None), (far, "error", "r", 1, "late")])
    row = told(fold, [(i, "run_start", "r", None, None) for i in (1, 0)] + [(2, "run_complete", "r", None, None), (far, "error", "r", 1, "again")])
    assert (row["status"], row["following"]) == ("completed", 3)
    assert json.loads(next(fold.handleExpiredTimer(("r",), None, None))[0])["error"] == "event 3 is missing"  # the far one waits
    told(fold, [(2, "run_complete", "r", None, None)])
    assert told(fold, [(i, "run_start", "r", None, None) for i in (1, 0, 2)])["following"] == 3
    told(fold, [(3, "run_complete", "r", None, None)])
    assert list(fold.handleExpiredTimer(("r",), None, None)) == [] and held.map == {}


def test_no_events_have_no_states(spark, tmp_path):
    from lexispark.plans import catalog

    spark.createDataFrame([], "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert catalog.queries()["ordered_run_states"](spark, str(tmp_path)).collect() == []


# -- served events


@pytest.fixture
def endpoint():
    """A stub that serves what has been said so far, by byte ranges."""
    said = bytearray()

    class Stub(BaseHTTPRequestHandler):
        def do_GET(self):
            first, last = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            part = bytes(said[first : last + 1])
            self.send_response(206 if part else 416)
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield said, f"http://127.0.0.1:{server.server_port}/run"
    server.shutdown()


def test_whole_events_of_cut_frames():
    text = "event: a\r\ndata: 1\r\n\r\n: note\n\nevent: b\rdata: é\rdata: 3\r\rdata: 4".encode()
    assert [(k, d) for _, k, d in served.whole_events(text)] == [("a", "1"), ("b", "é\n3")]
    for size in range(len(text)):
        found = served.whole_events(text[:size])
        end = found[-1][0] if found else 0
        rest = served.whole_events(text[end:])
        assert [(k, d) for _, k, d in found + rest] == [("a", "1"), ("b", "é\n3")]


def test_a_served_stream_is_stopped_and_resumed(spark, tmp_path, endpoint):
    said, url = endpoint
    frames = [served.frame("step_start", json.dumps({"step": i, "text": "é" * (i % 5)})).encode() for i in range(40)]
    whole = b"".join(frames)
    out = str(tmp_path / "frames")

    def sitting(until: int, want: int) -> None:
        said.extend(whole[len(said) : until])
        stream = served.read_events(spark, url, "run/1", most=300)
        query = served.write_frames(stream, out, str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
        deadline = time.time() + 90
        while time.time() < deadline and len(events()) < want:
            time.sleep(0.3)
        query.stop()

    def events() -> list:
        folder = tmp_path / "frames" / "run%2F1"
        text = b"".join(p.read_bytes() for p in sorted(folder.glob("*.sse"))) if folder.exists() else b""
        return [(k, d) for _, k, d in served.whole_events(text)]

    cut = len(b"".join(frames[:17])) + 5
    sitting(cut, 17)
    assert len(events()) == 17
    sitting(len(whole), 40)
    assert [json.loads(d)["step"] for _, d in events()] == list(range(40)) and {k for k, _ in events()} == {"step_start"}
    raw = spark.createDataFrame([("run/1", i, k, d) for i, (k, d) in enumerate(events())], served.EVENTS)
    assert runs.decode_events(raw).where("problem IS NULL AND step BETWEEN 1 AND 6").count() == 6


def test_a_failing_batch_leaves_the_error_path(spark, tmp_path):
    rows = [("r", 0, "run_start", '{"run_id": "r"}'), ("r", 1, "final_answer", '{"score": NaN}')]
    spark.createDataFrame(rows, served.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(served.EVENTS).parquet(str(tmp_path / "in"))
    query = served.write_frames(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        query.awaitTermination()
    text = (tmp_path / "out/errors/000000000.sse").read_bytes()
    assert [k for _, k, _ in served.whole_events(text)] == ["error", "stream_end"] and b"NaN" not in text
    assert not (tmp_path / "out/r").exists()


@pytest.mark.parametrize("kind, payload", [("", "{}"), ("a\nb", "{}"), ("a", "[]"), ("a", "1"), ("a", "no"), ("a", '{"x": Infinity}')])
def test_frames_that_are_none(kind, payload):
    with pytest.raises(ValueError):
        served.frame(kind, payload)


# -- durable scores


def test_a_batch_is_asked_once_over_interrupted_runs(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{q}", b, s, f"q{q}::{b}{s}") for q in range(3) for b in range(2) for s in range(2)], "query_id string, batch int, slot int, candidate_id string")
    asked, store = str(tmp_path / "asked"), str(tmp_path / "store")

    def provider(stop: str | None):
        def make():
            def ask(batch):
                if batch[0]["candidate_id"] == stop:
                    raise SystemExit("the executor is lost")
                with open(asked, "a") as log:
                    log.write(batch[0]["candidate_id"] + "\n")
                return json.dumps({"scores": [{"candidate_id": r["candidate_id"], "score": 3, "confidence": 1, "rationale": "r"} for r in batch]})

            return ask

        return make

    score = lambda stop, settings=None: verify.score_batches(rows.repartition(1), provider(stop), pause=0.0, store=store, settings=settings)
    for stop in ("q1::10", "q2::00"):
        with pytest.raises(Exception):
            score(stop).collect()
    once = score(None)
    assert once.count() == 12 and once.where("problem IS NULL").count() == 12
    log = open(asked).read().split()
    assert sorted(log) == sorted({f"q{q}::{b}0" for q in range(3) for b in range(2)})
    kept = verify.stored_scores(spark, store)
    assert sorted(r["candidate_id"] for r in kept.collect()) == sorted(r["candidate_id"] for r in rows.collect())
    assert verify.checkpoint_violations(kept.select("query_id", "batch", "batch_sha256", "candidate_id"), kept.select("query_id", "batch", "batch_sha256", "candidate_id")).count() == 0
    score(None, {"model": "other"}).collect()
    assert len(open(asked).read().split()) == 12


def test_a_batch_that_fails_is_not_kept(spark, tmp_path):
    rows = spark.createDataFrame([("q", 0, 0, "q::1")], "query_id string, batch int, slot int, candidate_id string")
    got = verify.score_batches(rows, lambda: lambda batch: "no", attempts=1, pause=0.0, store=str(tmp_path / "s")).collect()
    assert got[0]["problem"] == "not JSON" and not (tmp_path / "s").exists()


# -- surrogate


def plain_fit(x, y, iterations, rate=0.1, l2=0.01):
    mean, deviation = x.mean(axis=0), np.sqrt(((x - x.mean(axis=0)) ** 2).mean(axis=0))
    scale = np.where(deviation > 0, deviation, 1.0)
    z, bias, w = (x - mean) / scale, 0.0, np.zeros(x.shape[1])
    for _ in range(iterations):
        off = 1 / (1 + np.exp(-(bias + z @ w))) - y
        bias, w = bias - rate * off.mean(), w - rate * (z.T @ off / len(y) + l2 * w)
    return bias, w / scale, 1 / (1 + np.exp(-(bias + z @ w)))


@pytest.mark.parametrize("tasks", [1, 4])
def test_the_surrogate_is_the_same_on_any_number_of_tasks(spark, tasks):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(60, 3))
    y = (x[:, 0] + draw.normal(size=60) > 0).astype(float)
    rows = [(f"q{i:03}", "c", bool(y[i]), dict(zip("abc", map(float, x[i])))) for i in range(60)]
    df = spark.createDataFrame(rows, "query_id string, citation string, accepted boolean, features map<string,double>").repartition(7)
    bias, coefficients, p = plain_fit(x, y, 150)
    got = {r["query_id"]: r for r in analysis.gate_surrogate(df, iterations=150, tasks=tasks).collect()}
    assert len(got) == 60
    for i, (key, r) in enumerate(sorted(got.items())):
        assert abs(r["probability"] - p[i]) < 1e-12 and abs(r["intercept"] - bias) < 1e-12
        assert max(abs(r["raw_coefficients"][n] - c) for n, c in zip("abc", coefficients)) < 1e-12
        assert abs(r["brier"] - ((p - y) ** 2).mean()) < 1e-12 and abs(r["accuracy"] - ((p >= 0.5) == (y > 0)).mean()) < 1e-12
    assert analysis.gate_surrogate(df.limit(0), iterations=5, tasks=tasks).count() == 0
