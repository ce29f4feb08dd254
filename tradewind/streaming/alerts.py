"""Alerts with a cooldown on a stream: values wait until the watermark has passed them, so batches don't matter."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000_000


class Cooldown(StatefulProcessor):
    """State of a key: values that reached the threshold but aren't settled yet, and the day of the last firing.

    One timer a key stands at what comes next: the earliest waiting value, or
    the end of the cooldown, when the last firing is forgotten.
    """

    def __init__(self, key: str, at: str, value: str, cooldown_days: int) -> None:
        self.key, self.at, self.value, self.days = key, at, value, max(1, cooldown_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, value double")
        self.last = handle.getValueState("last", "day bigint")

    def _wake(self, micros: int, over: int = -1) -> None:
        """Sets the key's timer, unless an earlier one is set; those up to ``over`` have run off."""
        due = -(-micros // 1000)
        held = [t for t in self.handle.listTimers() if t > over]
        if held and min(held) <= due:
            return
        for t in held:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(a), float(v)) for pdf in rows for a, v in zip(pdf[self.at].to_numpy().astype("datetime64[us]").astype(np.int64), pdf[self.value])]
        self.waiting.appendList(new)
        self._wake(min(a for a, _ in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        now = mark * 1000
        waiting = sorted((int(a), float(v)) for a, v in self.waiting.get())
        last = int(self.last.get()[0]) if self.last.exists() else None
        fired = []
        for at, value in (w for w in waiting if w[0] <= now):
            if last is None or at // DAY - last >= self.days:
                last = at // DAY
                fired.append((at, value))
        rest = [w for w in waiting if w[0] > now]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        over = None if last is None else (last + self.days) * DAY
        if over is None or over <= now:
            self.last.clear()
        else:
            self.last.update((last,))
            self._wake(over, mark)
        if rest:
            self._wake(rest[0][0], mark)
        if fired:
            at, value = zip(*fired)
            yield pd.DataFrame({self.key: [key[0]] * len(at), "fired_at": np.array(at, "datetime64[us]"), "observed": value})


def cooled_alerts(rows: DataFrame, key: str, value: str, at: str, threshold: float, cooldown_days: int, delay: str = "1 hour") -> DataFrame:
    """(key, fired_at, observed): a key fires when its value reaches the threshold, and again ``cooldown_days`` later at the earliest, once a day at most.

    Values are judged in order of time (ties: the smaller first) when the
    watermark has passed them; later ones than that are dropped by Spark.
    """
    kind = rows.schema[key].dataType.simpleString()
    marked = rows.select(key, at, value).withWatermark(at, delay)
    # rows under the threshold move the watermark too; a filter that reads the time isn't pushed below it
    hits = marked.where(F.when((F.col(value) >= threshold) & F.col(key).isNotNull(), F.col(at)).isNotNull())
    schema = f"{key} {kind}, fired_at timestamp, observed double"
    return hits.groupBy(key).transformWithStateInPandas(Cooldown(key, at, value, cooldown_days), schema, "append", "EventTime")
