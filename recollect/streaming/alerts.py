"""The stall alert as a stateful stream that is right for rows in any order.

Progress may arrive out of order by up to ``lateness``. A series keeps its last final
progress, whether its alert is open, and the first and last time in every slot of the limit's
length that the watermark has not passed: two rows of a slot are never more than the limit
apart, so state grows with the time that is open, not with the rows of a busy series. Nothing
is decided before the watermark has passed it, so no alert is ever taken back. An alert is
reported when the watermark passes the limit, and once more, with the time, when its series
resumes. Rows behind the watermark change nothing and go to a side output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.telemetry import STALL_HOLD_SECONDS, STALL_SECONDS, failed_state_alerts

FIRED, RESUMED, LATE = "fired", "resumed", "late"
ALERT_SCHEMA = "kind string, series string, last_progress_ms bigint, fired_at_ms bigint, resumed_at_ms bigint, late_ms bigint"
COLUMNS = [c.split()[0] for c in ALERT_SCHEMA.split(", ")]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StallProcessor(StatefulProcessor):
    """All state of a series is one value, read once and written once a call: every access is a message to the JVM."""

    def __init__(self, limit_ms: int) -> None:
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ``slots`` holds the first and last time of each slot as pairs of 64-bit numbers, in order.
        self.state = handle.getValueState("series", "at bigint, open boolean, slots binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        found: list[tuple] = []
        spans = []
        for batch in rows:
            times = batch["ts_ms"].to_numpy(np.int64)
            found += [(LATE, key[0], None, None, None, int(t)) for t in times[times < passed]]
            times = times[times >= passed]
            spans.append(self._spans(np.stack([times, times], 1)))
        yield from self._settled(key[0], passed, spans, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key[0], timerValues.getCurrentWatermarkInMs(), [], [])

    def close(self) -> None:
        pass

    @staticmethod
    def _result(rows: list[tuple]) -> pd.DataFrame:
        columns = dict(zip(COLUMNS, zip(*rows)))
        return pd.DataFrame({c: v if c in COLUMNS[:2] else pd.array(v, "Int64") for c, v in columns.items()})

    def _spans(self, spans: np.ndarray) -> np.ndarray:
        """The first and last time of each slot, by slot, of (first, last) pairs in any order."""
        if len(spans) < 2:
            return spans
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        new = np.flatnonzero(np.diff(spans[:, 0] // self.limit, prepend=spans[0, 0] // self.limit - 1))
        return np.stack([spans[new, 0], np.maximum.reduceat(spans[:, 1], new)], 1)

    def _settled(self, series: str, passed: int, spans: list[np.ndarray], found: list[tuple]) -> Iterator[pd.DataFrame]:
        """Decide all that lies before ``passed``, and set a timer for what comes next."""
        known = self.state.get()
        last, is_open, held = known if known is not None else (None, False, b"")
        slots = self._spans(np.concatenate([np.frombuffer(held, np.int64).reshape(-1, 2), *spans]))
        waiting, rest = [], slots[:0]
        for at, (low, high) in enumerate(slots.tolist()):
            if low >= passed:
                waiting.append(low)
                rest = np.concatenate([rest, slots[at:]])
                break
            if last is not None and low - last > self.limit:
                found.append((RESUMED if is_open else FIRED, series, last, last + self.limit, low, None))
                is_open = False
            if high < passed:
                last, is_open = high, False
            else:
                # Up to the slot's last row there is no gap.
                last, is_open = low, False
                rest = np.array([[high, high]], np.int64)
                waiting.append(high)
        if last is not None:
            if not is_open and last + self.limit < passed:
                found.append((FIRED, series, last, last + self.limit, None, None))
                is_open = True
            if not is_open:
                waiting.append(last + self.limit)
        if last is not None or len(rest):
            self.state.update((last, is_open, rest.tobytes()))
        if waiting:
            self.handle.registerTimer(max(min(waiting), passed) + 1)
        if found:
            yield self._result(found)


def stall_alert_stream(
    progress: DataFrame, key: str, lateness: str, time: str = "ts",
    quiet_seconds: int = STALL_SECONDS, hold_seconds: int = STALL_HOLD_SECONDS,
) -> DataFrame:
    """Events (``ALERT_SCHEMA``) of series without progress for quiet + hold seconds of event time.

    ``fired`` rows are alerts, with ``resumed_at_ms`` if the series is known to have resumed;
    else a ``resumed`` row follows. ``late`` rows are progress that came more than
    ``lateness`` behind the newest; choose it from how far sources fall behind. Rows with a
    null key or time are left out. The session needs the RocksDB state store
    (``STATE_STORE``).
    """
    rows = progress.select(F.col(key).cast("string").alias("series"), F.col(time).cast("timestamp").alias("at"))
    # Without the watermarked column the operator gets late rows too, and can report them.
    rows = rows.filter("series is not null and at is not null").withWatermark("at", lateness)
    rows = rows.select("series", F.unix_millis("at").alias("ts_ms"))
    return rows.groupBy("series").transformWithStateInPandas(
        StallProcessor((quiet_seconds + hold_seconds) * 1000), ALERT_SCHEMA, "Append", "EventTime"
    )


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts, late progress) of a written ``stall_alert_stream``: one row per alert, with the time it resumed."""
    alerts = events.filter(F.col("kind") != LATE).groupBy("series", "last_progress_ms", "fired_at_ms")
    late = events.filter(F.col("kind") == LATE).select("series", "late_ms")
    return alerts.agg(F.max("resumed_at_ms").alias("resumed_at_ms")), late


def failed_state_stream(states: DataFrame) -> DataFrame:
    """Failed states fire at once; a stateless filter."""
    return failed_state_alerts(states)
