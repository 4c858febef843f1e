"""Change detection, versions and outcomes over a stream of fetched documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = "url string, seq long, change string, version long"


class ChangeDetector(StatefulProcessor):
    """Keeps each key's last hash and version; a batch's rows of a key are taken in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("hash", StringType()), StructField("version", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.last.get() if self.last.exists() else None
        digest, version = (held[0], held[1]) if held else (None, 0)
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            change = "baseline" if version == 0 else "unchanged" if row.hash == digest else "changed"
            version += change != "unchanged"
            digest = row.hash
            yield pd.DataFrame({"url": [key[0]], "seq": [row.seq], "change": [change], "version": [version]})
        self.last.update((digest, version))

    def close(self) -> None:
        pass


def detect_changes(fetched: DataFrame) -> DataFrame:
    """url, seq, change (baseline, unchanged, changed) and version of a stream with url, seq and hash."""
    return fetched.select("url", "seq", "hash").groupBy("url").transformWithStateInPandas(ChangeDetector(), outputStructType=SCHEMA, outputMode="Append", timeMode="None")


def first_seen(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; later copies are dropped, and keys are forgotten once it has passed."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, group: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and group; rows later than the watermark are dropped."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(window.alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def session_counts(stream: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Events of each session of a key."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there now, batch by batch, with ``each``; a later run goes on where this one ended."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
