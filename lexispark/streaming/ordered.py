"""The state of runs over a stream whose events come late, twice or in any order."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship
from .runs import STATE, Fold

#: Milliseconds without an event after which a run is given up.
IDLE = 60 * 60 * 1_000
#: Consecutive numbers whose waiting events are one value of the state.
PAGE = 128
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = ["run_key", *[c.split()[0] for c in STATE.split(", ")], "following"]
_SCHEMA = f"run_key string, {STATE}, following long".replace("map<int,string>", "array<struct<step:int,is:string>>")
_Out = Row("row")
_dumps = json.JSONEncoder(separators=(",", ":")).encode


def _text(events: dict[int, list]) -> str:
    return _dumps([(seq, *event) for seq, event in events.items()])


def _events(rows: list) -> dict[int, list]:
    return {seq: event for seq, *event in rows}


class OrderedFold(StatefulProcessor):
    """A run's fold, the number of the event it waits for, and events that came before their turn.

    A call to the state goes through a socket, so events wait by pages: those of
    the page of the awaited event beside the fold, later ones in a map that is
    not looked at while it is empty. Events come, and rows leave, as JSON, which
    Spark writes and reads: each value of a row is dear in Python.
    """

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "state string")
        self.pages = handle.getMapState("pages", "page long", "events string")

    def _known(self) -> tuple[Fold, int, dict[int, list], int]:
        """The fold so far, the number of the next event, what waits on its page and how many events wait on later ones."""
        if not self.folded.exists():  # to get what is not there leaves a warning in the log
            return Fold(), 0, {}, 0
        following, near, far, status, server, steps, *rest = json.loads(self.folded.get()[0])
        return Fold((status, server, dict(steps), *rest)), following, _events(near), far

    def _page(self, page: int) -> dict[int, list]:
        return _events(json.loads(self.pages.getValue((page,))[0])) if self.pages.containsKey((page,)) else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fold, following, near, far = self._known()
        page = following // PAGE
        later: dict[int, dict[int, list]] = {}
        for seq, *event in map(dict.values, json.loads(f"[{','.join(row[0] for row in rows)}]")):
            if seq >= following:  # what has been applied comes twice, as does what waits
                (near if seq // PAGE == page else later.setdefault(seq // PAGE, {})).setdefault(seq, event)
        while following in near:
            fold.add(*near.pop(following))
            following += 1
            if following == (page + 1) * PAGE:
                page += 1
                near = later.pop(page, {})
                if far and (found := self._page(page)):
                    self.pages.removeKey((page,))
                    near, far = near | found, far - len(found)
        for number, events in later.items():
            found = self._page(number) if far else {}
            if added := len(events.keys() - found.keys()):
                self.pages.updateValue((number,), (_text(events | found),))
                far += added
        status, server, steps, *rest = fold.state()
        self.folded.update((_dumps([following, [(seq, *event) for seq, event in near.items()], far, status, server, list(steps.items()), *rest]),))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._row(key, fold, following)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fold, following, near, far = self._known()
        missing = near or far
        self.folded.clear()
        self.pages.clear()
        if fold.status == "running" or missing:
            fold.status, fold.error = "error", f"event {following} is missing" if missing else "no event for too long"
            yield self._row(key, fold, following)

    @staticmethod
    def _row(key, fold: Fold, following: int) -> Row:
        status, server, steps, *rest = fold.state()
        steps = [{"step": step, "is": state} for step, state in steps.items()]
        return _Out(_dumps(dict(zip(_COLUMNS, (key[0], status, server, steps, *rest, following), strict=True))))

    def close(self) -> None:
        pass


def fold_ordered(events: DataFrame, idle: int | None = IDLE) -> DataFrame:
    """The state of each run of a stream of events (EVENT) after each micro-batch, as if they had come in order.

    A run's events are numbered by ``seq`` from 0 without gaps. An event that
    comes before its turn waits in the state until those before it are there;
    one that comes again is passed over. A run without events for ``idle``
    milliseconds leaves the state: if it had not ended, or still waited for an
    event, a last row says so. (Timers keep a stream going, so one that is to end
    by itself, with the trigger ``availableNow``, needs ``idle`` None: its runs
    stay in the state.) ``following`` is the number that a run waits for. The
    state store of the session becomes RocksDB, which this needs.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    event = F.to_json(F.struct("seq", "type", "run_id", "step", "message"), {"ignoreNullFields": "false"})
    runs = events.select(event.alias("event"), "run_key").groupBy("run_key")
    rows = runs.transformWithState(OrderedFold(idle), "row string", "update", "None" if idle is None else "ProcessingTime")
    return rows.select(F.from_json("row", _SCHEMA).alias("r")).select("r.*").withColumn("steps", F.map_from_entries("steps"))
