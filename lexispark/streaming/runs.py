"""Run events as streams: event rows, SSE text to events, and the state of each run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

STEPS = ("understand", "generate queries", "retrieve", "rerank", "control citations", "answer")
KINDS = ("run_start", "step_start", "step_complete", "final_answer", "run_complete", "error", "cancel", "stream_end")
EVENT = "run_key string, seq long, type string, run_id string, step int, message string"
STATE = "status string, server_run string, steps map<int,string>, error string, answered boolean, events long"


def planned_events(runs: DataFrame) -> DataFrame:
    """(run_id, seq, type, step) of runs that succeed or fail at a step (run_id, failed_step or null)."""
    step = lambda kind: F.transform(F.sequence(F.lit(1), F.lit(len(STEPS))), lambda s: F.struct((2 * s - (1 if kind == "step_start" else 0)).cast("long").alias("seq"), F.lit(kind).alias("type"), s.alias("step")))
    one = lambda seq, kind, s=None: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("type"), (F.lit(s).cast("int") if not hasattr(s, "cast") else s).alias("step"))
    last = 2 * len(STEPS)
    steps = F.filter(F.concat(step("step_start"), step("step_complete")), lambda e: F.col("failed_step").isNull() | (e["step"] < F.col("failed_step")) | ((e["step"] == F.col("failed_step")) & (e["type"] == "step_start")))
    end = F.when(F.col("failed_step").isNull(), F.array(one(last + 1, "final_answer"), one(last + 2, "run_complete"))).otherwise(F.array(one(last + 1, "error", F.col("failed_step").cast("int"))))
    events = F.concat(F.array(one(0, "run_start")), steps, end, F.array(one(last + 3, "stream_end")))
    return runs.select("run_id", F.explode(events).alias("e")).select("run_id", "e.*")


class Fold:
    """A run's state over its events in order of arrival."""

    def __init__(self, state: tuple | None = None):
        self.status, self.server, steps, self.error, self.answered, self.events = state or ("running", None, None, None, False, 0)
        self.steps = dict(steps or {})

    def add(self, kind: str, run_id: str | None, step: int | None, message: str | None) -> None:
        if kind == "cancel":
            if self.status == "running":
                self.status, self.error = "cancelled", None
            return
        self.events += 1
        if self.server is not None and run_id is not None and run_id != self.server:
            self.status, self.error = "error", "events of different runs are mixed"
            return
        if kind == "run_start":
            self.server = run_id
        elif kind == "step_start":
            self.steps[step] = "running"
        elif kind == "step_complete":
            self.steps[step] = "completed"
        elif kind == "final_answer":
            self.answered = True
        elif kind == "run_complete":
            self.status = "completed"
        elif kind == "error":
            self.status, self.error = "error", message
            if step is not None:
                self.steps[step] = "error"
        elif kind == "stream_end" and self.status == "running":
            self.status, self.error = "error", "the stream ended before the run completed"

    def state(self) -> tuple:
        return self.status, self.server, self.steps, self.error, self.answered, self.events


_COLUMNS = ["seq", "type", "run_id", "step", "message"]


def _apply(fold: Fold, rows: pd.DataFrame) -> None:
    for _, kind, run_id, step, message in rows.sort_values("seq", kind="stable")[_COLUMNS].itertuples(index=False):
        fold.add(kind, None if pd.isna(run_id) else run_id, None if pd.isna(step) else int(step), None if pd.isna(message) else message)


def _row(key: tuple, fold: Fold) -> pd.DataFrame:
    names = ["run_key", *[c.split()[0] for c in STATE.split(", ")]]
    return pd.DataFrame([(key[0], *fold.state())], columns=names)


def fold_batch(events: DataFrame) -> DataFrame:
    """The final state of each run of a table of events (EVENT)."""

    ship(events.sparkSession)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        fold = Fold()
        _apply(fold, rows)
        return _row(key, fold)

    return events.groupBy("run_key").applyInPandas(run, f"run_key string, {STATE}")


def fold_stream(events: DataFrame) -> DataFrame:
    """The state of each run after every micro-batch of a stream of events; the state is the stream's own."""

    ship(events.sparkSession)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = Fold(state.get if state.exists else None)
        rows = list(batches)
        if rows:
            _apply(fold, pd.concat(rows))
        state.update(fold.state())
        yield _row(key, fold)

    return events.groupBy("run_key").applyInPandasWithState(run, f"run_key string, {STATE}", STATE, "update", "NoTimeout")


class SseParser:
    """Server-sent events from text in pieces of any size; LF, CR and CRLF end lines."""

    def __init__(self):
        self.rest, self.kind, self.data = "", None, []

    def push(self, text: str) -> list[tuple[str, str]]:
        self.rest += text
        out = []
        while True:
            ends = [i for i in (self.rest.find("\n"), self.rest.find("\r")) if i >= 0]
            if not ends:
                return out
            end = min(ends)
            if self.rest[end] == "\r":
                if end + 1 == len(self.rest):
                    return out  # a line feed may follow
                size = 2 if self.rest[end + 1] == "\n" else 1
            else:
                size = 1
            line, self.rest = self.rest[:end], self.rest[end + size :]
            out += self._line(line)

    def finish(self) -> list[tuple[str, str]]:
        """What the end of the text completes."""
        out = []
        if self.rest:
            line, self.rest = self.rest.removesuffix("\r"), ""
            out += self._line(line)
        return out + self._line("")

    def _line(self, line: str) -> list[tuple[str, str]]:
        if not line:
            event = [(self.kind or "message", "\n".join(self.data))] if self.data else []
            self.kind, self.data = None, []
            return event
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "event":
            self.kind = value
        elif name == "data":
            self.data.append(value)
        return []


def sse_events(frames: DataFrame) -> DataFrame:
    """(run_key, seq, type, payload) of raw SSE text (run_key, text); a row is one complete stream."""

    ship(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, text in zip(rows["run_key"], rows["text"], strict=True):
                parser = SseParser()
                out += [(key, i, kind, data) for i, (kind, data) in enumerate(parser.push(text or "") + parser.finish())]
            yield pd.DataFrame(out, columns=["run_key", "seq", "type", "payload"])

    return frames.select("run_key", "text").mapInPandas(run, "run_key string, seq long, type string, payload string")


def decode_events(raw: DataFrame) -> DataFrame:
    """Events of EVENT from (run_key, seq, type, payload JSON), with the problem of those that are none."""
    body = F.try_parse_json("payload")
    get = lambda name, kind: F.try_variant_get(body, f"$.{name}", kind)
    step, run_id = get("step", "int"), get("run_id", "string")
    problem = (
        F.when(~F.col("type").isin(*KINDS), "unknown type")
        .when(~F.coalesce(F.startswith(F.schema_of_variant(body), F.lit("OBJECT")), F.lit(False)), "payload is no object")
        .when(F.col("type").isin("step_start", "step_complete") & ~F.coalesce(step.between(1, len(STEPS)), F.lit(False)), "step is out of range")
        .when((F.col("type") == "run_start") & run_id.isNull(), "run_id is missing")
        .when((F.col("type") == "error") & get("message", "string").isNull(), "message is missing")
    )
    return raw.select("run_key", "seq", "type", run_id.alias("run_id"), step.alias("step"), get("message", "string").alias("message"), problem.alias("problem"))


def request_limits(requests: DataFrame, models: list[str], query_chars: int = 8_000, turns: int = 20, history_chars: int = 32_000) -> DataFrame:
    """Adds rejection: why a request (query, model, history array of role and content) is refused, or null."""
    size = F.aggregate(F.coalesce(F.col("history"), F.array().cast("array<struct<role:string,content:string>>")), F.lit(0), lambda s, m: s + F.length(m["content"]))
    why = (
        F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "query is empty")
        .when(F.length("query") > query_chars, "query is too long")
        .when(~F.col("model").isin(models), "model is not allowed")
        .when(F.coalesce(F.size("history"), F.lit(0)) > turns, "history has too many turns")
        .when(size > history_chars, "history is too long")
    )
    return requests.withColumn("rejection", why)
