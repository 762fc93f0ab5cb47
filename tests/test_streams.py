"""Run events: SSE parsing, the fold of a run's state, and stream = batch."""

from lexispark.streaming import runs


def test_sse_in_any_pieces_and_line_ends():
    text = "event: a\r\ndata: 1\r\n\r\n: note\nevent: b\rdata: 2\rdata: 3\r\rdata: 4"
    expected = [("a", "1"), ("b", "2\n3"), ("message", "4")]
    for size in (1, 2, 3, 100):
        parser, got = runs.SseParser(), []
        for i in range(0, len(text), size):
            got += parser.push(text[i : i + size])
        assert got + parser.finish() == expected


def test_fold_of_a_run():
    def end(events):
        fold = runs.Fold()
        for e in events:
            fold.add(*e)
        return fold.state()

    whole = [("run_start", "r", None, None), ("step_start", "r", 1, None), ("step_complete", "r", 1, None), ("final_answer", "r", None, None), ("run_complete", "r", None, None), ("stream_end", None, None, None)]
    assert end(whole)[0] == "completed" and end(whole)[2] == {1: "completed"}
    assert end([whole[0], whole[-1]])[0] == "error"
    assert end([whole[0], ("step_start", "other", 1, None)])[3] == "events of different runs are mixed"
    assert end([whole[0], ("cancel", None, None, None)])[0] == "cancelled"
    assert end([whole[0], ("error", "r", 2, "bad")])[:4] == ("error", "r", {2: "error"}, "bad")


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r1", 0, "run_start", "r1", None, None), ("r1", 1, "step_start", "r1", 1, None), ("r2", 0, "run_start", "r2", None, None), ("r1", 2, "step_complete", "r1", 1, None), ("r1", 3, "run_complete", "r1", None, None), ("r2", 1, "error", "r2", 3, "no")]
    events = spark.createDataFrame(rows, runs.EVENT)
    for i in range(3):
        events.where(f"seq % 3 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = runs.fold_stream(stream).writeStream.format("memory").queryName("run_states").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.table("run_states").collect():
        if r["run_key"] not in last or last[r["run_key"]]["events"] <= r["events"]:
            last[r["run_key"]] = r
    batch = {r["run_key"]: r for r in runs.fold_batch(events).collect()}
    assert {k: v["events"] for k, v in last.items()} == {k: v["events"] for k, v in batch.items()}
    assert last["r2"]["status"] == batch["r2"]["status"] == "error"


def test_planned_events_of_a_failed_run(spark):
    df = spark.createDataFrame([("ok", None), ("bad", 2)], "run_id string, failed_step int")
    got = {}
    for r in runs.planned_events(df).orderBy("run_id", "seq").collect():
        got.setdefault(r["run_id"], []).append(r["type"])
    assert len(got["ok"]) == 16 and got["ok"][-2:] == ["run_complete", "stream_end"]
    assert got["bad"] == ["run_start", "step_start", "step_complete", "step_start", "error", "stream_end"]
