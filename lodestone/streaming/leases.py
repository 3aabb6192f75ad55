"""The lease state machine of work cells, as keyed state of a stream.

A cell is claimed by an owner until it expires, renewed, settled or taken over. Expiry re-opens a cell by itself: a timer tells when the watermark
passes it, though nothing more is heard of the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OPEN = ("PENDING", "SHALLOW", "FAILED", "EXPIRED")
NEW = ("PENDING", None, None, 0)
BUCKET = "buckets int, due long, cells array<struct<cell string, state string, owner string, expires double, attempts int>>"
CHANGES = "cell string, ts double, event_id long, kind string, owner string, accepted boolean, state string, holder string, expires double, attempts int"
STREAM_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def step(cell: tuple, ts: float, kind: str, by: str, settled: str | None, ttl: float, most: int) -> tuple[bool, tuple]:
    """One event of a cell (state, owner, expires, attempts): is it accepted, and the cell after it.

    claim: of an open cell, or of one whose lease has run out, up to ``most`` times; counts an attempt. renew: by the holder, from its own time
    on, even if late, as long as nobody took over. settle: by the holder; clears the lease.
    """
    state, owner, expires, attempts = cell
    if kind == "claim":
        free = state in OPEN or state == "IN_PROGRESS" and expires is not None and expires < ts
        return (True, ("IN_PROGRESS", by, ts + ttl, attempts + 1)) if free and attempts < most else (False, cell)
    if owner is None or owner != by:
        return False, cell
    if kind == "renew":
        return True, ("IN_PROGRESS", owner, ts + ttl, attempts)
    if kind == "settle":
        return True, (settled or "ANALYZED", None, None, attempts)
    return False, cell


class Lease(StatefulProcessor):
    """Events (cell, ts, event_id, kind, owner, settled) of a bucket's cells in the order of (ts, event_id) within a batch; batches as they come.

    A call for a key, a round trip to its state and a frame cost far more than an event, so a key is a bucket of cells: its cells are read and written together, and
    it has one timer, for the first of its leases to run out.
    """

    def __init__(self, ttl: float, most: int, buckets: int):
        self.ttl, self.most, self.buckets = ttl, most, buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", BUCKET)

    def _read(self) -> tuple[dict[str | None, tuple], int | None]:
        """The bucket's cells by name, and when its timer is due."""
        if not self.bucket.exists():
            return {}, None
        buckets, due, cells = self.bucket.get()
        if buckets != self.buckets:
            raise ValueError(f"this checkpoint was written with {buckets} buckets, not {self.buckets}")
        return {name: tuple(cell) for name, *cell in cells}, due

    def _write(self, cells: dict[str | None, tuple], old: int | None) -> None:
        """Keep the cells, with a timer for the first lease to run out in place of the one due at ``old``."""
        due = min((_due(expires) for state, _, expires, _ in cells.values() if state == "IN_PROGRESS"), default=None)
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if due is not None:
                self.handle.registerTimer(due)
        self.bucket.update((self.buckets, due, [(name, *cell) for name, cell in cells.items()]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cells, due = self._read()
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for name, ts, event_id, kind, by, settled in zip(*(events[c].tolist() for c in ("cell", "ts", "event_id", "kind", "owner", "settled"))):
            ok, cell = step(cells.get(name, NEW), ts, kind, by, settled, self.ttl, self.most)
            cells[name] = cell
            out.append((name, ts, event_id, kind, by, ok, *cell))
        self._write(cells, due)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cells, due = self._read()
        now = timerValues.getCurrentWatermarkInMs()  # timers due at or before it fire
        out = []
        for name, (state, owner, expires, attempts) in cells.items():
            if state == "IN_PROGRESS" and _due(expires) <= now:
                # the holder is kept: it may still renew or settle while nobody takes over
                cells[name] = ("EXPIRED", owner, expires, attempts)
                out.append((name, expires, None, "expire", owner, True, *cells[name]))
        self._write(cells, due)
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _due(expires: float) -> int:
    """The first whole millisecond at which a lease has run out: it still holds at the moment of its end."""
    return round(expires * 1e6) // 1000 + 1


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in CHANGES.split(", ")])
    return frame.astype({"event_id": "Int64", "attempts": "int32", "ts": "float64", "expires": "float64"})


def lease_changes(events: DataFrame, ttl: float = 600.0, most: int = 10, late: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """Every event with the cell after it, and an ``expire`` row for each lease that runs out: CHANGES, for a stream in update mode.

    events: cell string, at timestamp, ts double (the same in seconds), event_id long, kind string, owner string, settled string. The session needs a
    state store that keeps timers (STREAM_CONF). What is kept is one row for each of ``buckets`` parts of the cells, by hash; the number stays as it is for
    the life of a checkpoint. A task holds one bucket's cells, and its events of a batch. Watermarks have whole milliseconds: a lease is told once one has passed its end.
    """
    bucket = F.pmod(F.xxhash64("cell"), F.lit(buckets)).cast("int").alias("bucket")
    known = events.withWatermark("at", late).select(bucket, "cell", "at", "ts", "event_id", "kind", "owner", "settled")
    return known.groupBy("bucket").transformWithStateInPandas(Lease(ttl, most, buckets), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")
