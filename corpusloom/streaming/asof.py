"""The first later row over two streams, by timers of event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, id string, at timestamp, right_at timestamp, payload string"


class FirstLater(StatefulProcessor):
    """Left rows wait until the watermark passes a right row at or after them: then no earlier one can come any more.

    A timer stands at each right row's time; when it fires, all left rows that wait and aren't later get that row. A left row that no
    right row follows waits on, however long.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id string, at timestamp")
        self.rights = handle.getMapState("rights", "ms long", "payload string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        for part in rows:  # a batch of a key may come in several parts; none is held
            left = part[part.side == "left"]
            self.waiting.appendList([(str(i), t.to_pydatetime()) for i, t in zip(left.id, left["at"])]) if len(left) else None
            for t, payload in part.loc[part.side == "right", ["at", "payload"]].itertuples(index=False):
                ms = (int(t.value // 1000 + 999) // 1000,)
                held = self.rights.getValue(ms) if self.rights.containsKey(ms) else None
                new = (f"{t.value:020d}|{payload}",)
                if held is None:
                    self.handle.registerTimer(ms[0])
                self.rights.updateValue(ms, new if held is None else min(held, new))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        ms = (expiredTimerInfo.getExpiryTimeInMs(),)
        at, payload = self.rights.getValue(ms)[0].split("|", 1)
        time = pd.Timestamp(int(at))
        self.rights.removeKey(ms)
        left = [(i, pd.Timestamp(t)) for i, t in self.waiting.get()]
        told, rest = [x for x in left if x[1] <= time], [x for x in left if x[1] > time]
        self.waiting.put([(i, t.to_pydatetime()) for i, t in rest]) if rest else self.waiting.clear()
        if told:
            yield pd.DataFrame({"key": key[0], "id": [i for i, _ in told], "at": [t for _, t in told], "right_at": time, "payload": payload})

    def close(self) -> None:
        pass


def first_later(left: DataFrame, right: DataFrame, late: str) -> DataFrame:
    """key, id, at, right_at and payload: each row of ``left`` (key, id, at) with the first of ``right`` (key, at, payload) at or after it.

    Rows may come in any order within ``late`` of the newest; later ones are dropped. Of right rows of one time the smallest payload
    counts; right rows are taken to differ by a millisecond or to be of one time. Null times match nothing.
    """
    a = left.select(F.col("key").cast("string").alias("key"), F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("payload"), F.lit("left").alias("side"))
    b = right.select(F.col("key").cast("string").alias("key"), F.lit(None).cast("string").alias("id"), F.col("at").cast("timestamp").alias("at"), F.col("payload").cast("string").alias("payload"), F.lit("right").alias("side"))
    both = a.unionByName(b).where("at is not null").withWatermark("at", late)
    return both.groupBy("key").transformWithStateInPandas(FirstLater(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
