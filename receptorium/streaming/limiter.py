"""Per-key sliding-log rate control, as a stream and as a batch job."""

from __future__ import annotations

from collections import deque
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from receptorium.constants import TRAILING_SECONDS

OUTPUT = "key string, event_id long, ts timestamp, accepted boolean"
ROWS_AT_ONCE = 100_000


WINDOW = TRAILING_SECONDS * 1_000_000


def step(log: deque, now: int, limit: int) -> bool:
    """Forget entries older than the window (in microseconds), then accept while there is room; a rejected event is not kept."""
    while log and now - log[0] > WINDOW:
        log.popleft()
    if len(log) >= limit:
        return False
    log.append(now)
    return True


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.dt.as_unit("us").astype("int64").to_numpy()


class _Limiter(StatefulProcessor):
    def __init__(self, limit: int, expires: bool):
        self.limit, self.expires = limit, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        log = deque(t for (t,) in self.log.get())
        # of a key's rows in one micro-batch only time and id are held, 16 bytes each
        parts = [(_micros(f["ts"]), f["event_id"].to_numpy(np.int64)) for f in rows]
        ts, ids = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.lexsort((ids, ts))
        ts, ids = ts[order], ids[order]
        for start in range(0, len(ts), ROWS_AT_ONCE):
            now = ts[start:start + ROWS_AT_ONCE]
            yield pd.DataFrame({"key": key[0], "event_id": ids[start:start + ROWS_AT_ONCE], "ts": pd.to_datetime(now, unit="us"),
                                "accepted": [step(log, t, self.limit) for t in now.tolist()]})
        if log:
            self.log.put([(t,) for t in log])
            if self.expires:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
                self.handle.registerTimer(log[-1] // 1000 + TRAILING_SECONDS * 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The last accepted event has left the window of every event still to come: the key is as if never seen."""
        self.log.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, limit: int, delay: str | None = None) -> DataFrame:
    """Accept or reject a stream of events (key, event_id, ts); state per key is at most ``limit`` entries. With a ``delay`` (how late
    events may come, as for a watermark) the state of a key is removed once its last accepted event is out of reach."""
    if delay is None:
        return events.groupBy("key").transformWithStateInPandas(_Limiter(limit, False), OUTPUT, "Append", "None")
    return events.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(_Limiter(limit, True), OUTPUT, "Append", "EventTime")


def _batch(limit: int):
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for batch in rows:
            verdict = []
            for key, t in zip(batch["key"], _micros(batch["ts"]).tolist()):
                if key != current:
                    current, log = key, deque()
                verdict.append(step(log, t, limit))
            yield batch.assign(accepted=verdict)[["key", "event_id", "ts", "accepted"]]
    return run


def limit_batch(events: DataFrame, limit: int) -> DataFrame:
    """The same rule over a finished table: keys sorted by time stream through a task; only a log of ``limit``
    entries is held, so a key of any length passes."""
    return events.select(F.col("key").cast("string"), "event_id", "ts").repartition("key") \
        .sortWithinPartitions("key", "ts", "event_id").mapInPandas(_batch(limit), OUTPUT)


def trailing_count(events: DataFrame) -> DataFrame:
    """Events of the same key in the sixty seconds up to each event, itself and its peers included.

    The window of an event lies in its own minute and the one before, so every event also visits the next
    minute and a busy key is counted minute by minute, not in one piece.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    size = TRAILING_SECONDS * 1_000_000
    rows = events.withColumn("_t", micros).withColumn("_own", F.floor(F.col("_t") / size))
    visits = rows.withColumn("_slot", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy("key", "_slot").orderBy("_t").rangeBetween(-size, 0)
    return visits.withColumn("n_trailing", F.count(F.lit(1)).over(w)).filter("_slot = _own").drop("_t", "_own", "_slot")
