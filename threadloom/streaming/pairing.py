"""Customer-to-brand pairs on a stream: whichever comes first, message or reply, waits for the other in state.

The session needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.shipping import ship

PAIR = "id long, parent long, brand string, text string, author string, p_text string, p_author string, time timestamp"
_SAID = "id long, brand string, text string, author string, time timestamp"


class PairState(StatefulProcessor):
    """Of one message id: the customer's message, once it is there, or else the replies that wait for it."""

    def __init__(self, keep_seconds: int):
        self.keep = 1000 * keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "text string, author string")
        self.waiting = handle.getListState("waiting", _SAID)
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        latest = 0
        for r in rows:
            latest = max(latest, int(r["time"].timestamp() * 1000))
            if r["brand"] is None:
                if not self.asked.exists():
                    self.asked.update((r["text"], r["author"]))
                    for w in self.waiting.get():
                        yield self._pair(key, w)
                    self.waiting.clear()
            else:
                said = (r["id"], r["brand"], r["text"], r["author"], r["time"])
                if self.asked.exists():
                    yield self._pair(key, said)
                else:
                    self.waiting.appendValue(said)
        # one timer, moved on by what came last
        before = self.until.get()[0] if self.until.exists() else 0
        if latest + self.keep > before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(latest + self.keep)
            self.until.update((latest + self.keep,))

    def _pair(self, key, said) -> Row:
        text, author = self.asked.get()
        return Row(id=said[0], parent=key[0], brand=said[1], text=said[2], author=said[3], p_text=text, p_author=author, time=said[4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.asked, self.waiting, self.until):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def pair_stream(messages: DataFrame, brands: list[str], late: str = "1 hour", keep_seconds: int = 30 * 86400) -> DataFrame:
    """PAIR: each reply of the brands with the customer's message that it answers, as soon as both are there.

    messages: the columns of ``typed`` and ``time``. Messages may come in any order within ``late``; later ones, and those whose id
    was there within it, are left out. A message or a reply waits ``keep_seconds`` of event time after the last row of its
    id; what comes after that finds no partner. Messages without an id or time, and replies without a parent, make no pairs.
    """
    ship(messages.sparkSession)
    low = F.lower("author")
    once = messages.where("id > 0 and time is not null").withWatermark("time", late).dropDuplicatesWithinWatermark(["id"])
    brand = F.when(~F.col("inbound") & low.isin([b.lower() for b in brands]), low)
    # a customer's message stands under its own id, a reply under its parent's
    key = F.when(F.col("inbound"), F.col("id")).when(brand.isNotNull() & (F.col("parent") > 0), F.col("parent"))
    rows = once.select(key.alias("key"), "id", F.when(~F.col("inbound"), brand).alias("brand"), "text", "author", "time").where("key is not null")
    return rows.groupBy("key").transformWithState(PairState(keep_seconds), PAIR, "Append", "EventTime", eventTimeColumnName="time")
