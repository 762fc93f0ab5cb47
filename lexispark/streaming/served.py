"""Served event streams: server-sent events as a streaming source and as a streaming sink.

Source: an endpoint that serves one run's frames, and more of them as time goes
by. The offset is the number of bytes that complete events have taken, and how
many events they were; a read asks for the bytes from there on (``Range``) and
keeps whole events only, so the tail of a cut frame is read again. A batch that
is replayed asks for its own byte range. A stream that is stopped and started
again from its checkpoint therefore neither loses nor repeats an event.

Sink: rows (run_key, seq, type, payload) become frames. A task writes its runs'
frames aside; the commit of a micro-batch renames them to
``<run>/<batch>-<part>.sse``, where a batch that is committed again replaces
itself, and names sort in the order of the batches. If a batch fails, its runs
are not known on the driver, so ``errors/<batch>.sse`` gets the error path: an
``error`` event with a code and a message that tells nothing of the inside, then
``stream_end``. A payload that is no JSON object, or holds a number that JSON
lacks, fails the batch.
"""

from __future__ import annotations

import json
import sys
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, SimpleDataSourceStreamReader, WriterCommitMessage

from ..sources import places

#: Bytes that one read takes at most, and seconds that it waits for an answer.
MOST, TIMEOUT = 8 << 20, 30.0
EVENTS = "run_key string, seq long, type string, payload string"


def whole_events(data: bytes) -> list[tuple[int, str, str]]:
    """(bytes up to and with its end, type, data) of each complete event; a blank line ends one, LF, CR or CRLF end lines."""
    out, kind, held, at = [], None, [], 0
    while True:
        end = min((i for i in (data.find(b"\n", at), data.find(b"\r", at)) if i >= 0), default=-1)
        if end < 0 or (data[end : end + 1] == b"\r" and end + 1 == len(data)):
            return out  # a cut line, or a CR that an LF may follow
        line = data[at:end].decode()
        at = end + (2 if data[end : end + 2] == b"\r\n" else 1)
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if not line:
            if held:
                out.append((at, kind or "message", "\n".join(held)))
            kind, held = None, []
        elif name == "event":
            kind = value
        elif name == "data":
            held.append(value)


class SseReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.key = options["url"], options["run_key"]
        self.most, self.token = int(options.get("most", MOST)), options.get("token")
        if urlparse(self.url).scheme not in ("http", "https"):
            raise ValueError("the endpoint must be an HTTP URL")

    def initialOffset(self) -> dict:
        return {"bytes": 0, "events": 0}

    def _bytes(self, first: int, last: int) -> bytes:
        headers = {"Range": f"bytes={first}-{last}", "Accept": "text/event-stream"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, headers=headers), timeout=TIMEOUT) as reply:
                if reply.status == 200 and first:  # the endpoint knows no ranges
                    reply.read(first)
                return reply.read(last - first + 1)
        except urllib.error.HTTPError as error:
            if error.code == 416:  # nothing new
                return b""
            raise

    def _rows(self, start: dict, data: bytes) -> tuple[list[tuple], dict]:
        events = whole_events(data)
        rows = [(self.key, start["events"] + i, kind, payload) for i, (_, kind, payload) in enumerate(events)]
        return rows, {"bytes": start["bytes"] + (events[-1][0] if events else 0), "events": start["events"] + len(events)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        size = self.most
        while True:
            data = self._bytes(start["bytes"], start["bytes"] + size - 1)
            rows, end = self._rows(start, data)
            if rows or len(data) < size:
                return iter(rows), end
            size *= 2  # an event longer than what was asked for

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if end["bytes"] <= start["bytes"]:
            return iter([])
        rows, found = self._rows(start, self._bytes(start["bytes"], end["bytes"] - 1))
        if found != end:
            raise ValueError(f"{self.url} no longer serves what it served: {found} and not {end}")
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Frames(WriterCommitMessage):
    files: list[tuple[str, str]]


def frame(kind: str, payload: str) -> str:
    """A frame of a payload that must be a JSON object with numbers that JSON has."""

    def refuse(name: str):
        raise ValueError(f"{name} is no JSON number")

    value = json.loads(payload, parse_constant=refuse)
    if not isinstance(value, dict):
        raise ValueError("a payload must be an object")
    if not kind or "\n" in kind or "\r" in kind:
        raise ValueError("an event needs a type of one line")
    return f"event: {kind}\ndata: {json.dumps(value, ensure_ascii=False, separators=(',', ':'))}\n\n"


class SseWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, iterator) -> Frames:
        runs: dict[str, list[tuple[int, str]]] = {}
        for row in iterator:
            runs.setdefault(row["run_key"], []).append((row["seq"], frame(row["type"], row["payload"])))
        out = []
        for key, frames in runs.items():
            name = f"{self.path}/_staging/{uuid.uuid4().hex}.sse"
            system, path = places.place(name)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as target:
                target.write("".join(f for _, f in sorted(frames)).encode())
            out.append((key, name))
        return Frames(out)

    def commit(self, messages: list[Frames | None], batchId: int) -> None:
        parts: dict[str, int] = {}
        for key, name in sorted(f for m in messages if m for f in m.files):
            part = parts[key] = parts.get(key, -1) + 1
            system, source = places.place(name)
            _, base = places.place(self.path)
            target = f"{base}/{quote(key, safe='')}/{batchId:09d}-{part:04d}.sse"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            places.move_over(system, source, target)

    def abort(self, messages: list[Frames | None], batchId: int) -> None:
        system, path = places.place(f"{self.path}/errors/{batchId:09d}.sse")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write((frame("error", json.dumps({"code": "internal_error", "message": "the run failed"})) + frame("stream_end", "{}")).encode())


class ServedEvents(DataSource):
    """``sse``: options url and run_key (reading), path (writing)."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema) -> SseReader:
        return SseReader(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> SseWriter:
        return SseWriter(dict(self.options))


def _registered(spark: SparkSession) -> None:
    from pyspark import cloudpickle

    for module in (sys.modules[__name__], places):  # the planner's Python has no files of the session's
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(ServedEvents)


def read_events(spark: SparkSession, url: str, run_key: str, token: str | None = None, most: int = MOST) -> DataFrame:
    """A stream of (run_key, seq, type, payload) of an endpoint; ``runs.decode_events`` gives their meaning."""
    _registered(spark)
    found = spark.readStream.format("sse").option("url", url).option("run_key", run_key).option("most", most)
    return (found.option("token", token) if token else found).load()


def write_frames(events: DataFrame, path: str, checkpoint: str):
    """A writer, to be started, of a stream of (run_key, seq, type, payload) as frames below ``path``; a run's rows of a batch go to one task."""
    _registered(events.sparkSession)
    rows = events.select("run_key", "seq", "type", "payload").repartition("run_key")
    return rows.writeStream.format("sse").option("path", places.qualified(events.sparkSession, path)).option("checkpointLocation", checkpoint)
