"""Running totals that are kept: distinct combinations sold per pair and bin, added up as the stream goes on.

The batch figure, `plans.live.pair_series`, defines what is right. It counts the whole window again on each refresh; here
each key keeps the combinations of its open bins, its total, and a timer at the end of the next bin. When the watermark
passes that end the bin is given out, also if nothing was sold in it, and forgotten.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfline.functions.text import not_empty

# the state of keyed operators with timers needs this store
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BinTotals(StatefulProcessor):
    """State of one key: the (bin, value) pairs seen in open bins, the number of them per bin, and (next bin, total)."""

    def __init__(self, origin: int, step: int) -> None:
        self.origin, self.step = origin, step  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "bin long, value string", "here boolean")
        self.counts = handle.getMapState("counts", "bin long", "n long")
        self.total = handle.getValueState("total", "next long, cum long")

    def _end(self, number: int) -> int:
        return self.origin + (number + 1) * self.step

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.total.exists():
            self.total.update((0, 0))
            self.handle.registerTimer(self._end(0))
        due = self.total.get()[0]
        for row in rows:
            number = (int(row["millis"]) - self.origin) // self.step
            if number < due or self.seen.containsKey((number, row["value"])):
                continue
            self.seen.updateValue((number, row["value"]), (True,))
            before = self.counts.getValue((number,)) if self.counts.containsKey((number,)) else None
            self.counts.updateValue((number,), ((before[0] if before else 0) + 1,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        number, cum = self.total.get()
        out = []
        while self._end(number) <= now:
            here = (number,)
            if self.counts.containsKey(here):
                cum += self.counts.getValue(here)[0]
                self.counts.removeKey(here)
                for entry in [k for k in self.seen.keys() if k[0] == number]:
                    self.seen.removeKey(entry)
            out.append(Row(key=key[0], millis=self._end(number) - self.step, cum=cum))
            number += 1
        self.total.update((number, cum))
        self.handle.registerTimer(self._end(number))
        return iter(out)

    def close(self) -> None:
        pass


def running_totals(rows: DataFrame, key: str, value: str, ts: str, origin: Column, step: datetime.timedelta, watermark: str) -> DataFrame:
    """(event_time, key, cum) of a stream: for every bin from `origin` on that the watermark has passed, the distinct values
    of each bin up to it added up. Append mode; rows later than the watermark, or before `origin`, do not count.

    Needs `STATE_STORE` among the session's settings.
    """
    start = rows.sparkSession.range(1).select(F.unix_millis(origin)).first()[0]
    named = rows.where(not_empty(value)).select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.col(ts).alias("ts"))
    timed = named.withWatermark("ts", watermark).withColumn("millis", F.unix_millis("ts"))
    found = timed.groupBy("key").transformWithState(
        BinTotals(start, step // datetime.timedelta(milliseconds=1)), "key string, millis long, cum long", "append", "eventTime"
    )
    return found.select(F.timestamp_millis("millis").alias("event_time"), F.col("key").alias(key), "cum")


def pair_totals(orders: DataFrame, holding: DataFrame, origin: Column, step: datetime.timedelta, watermark: str = "10 minutes") -> DataFrame:
    """Running totals of the pairs in `holding` (combination_id, pair_key) over a stream of orders.

    A combination sold in two bins counts in both, as in the batch figure.
    """
    sold = orders.where(not_empty("combination_id")).select("combination_id", "event_time")
    return running_totals(sold.join(holding, "combination_id"), "pair_key", "combination_id", "event_time", origin, step, watermark)
