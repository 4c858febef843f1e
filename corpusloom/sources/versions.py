"""Tables that are read again when their files change, and records rebuilt from saved originals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.scratch import exists, signature


@dataclass
class Reloaded:
    """A reader of several paths that belong together, current by the signature (names, sizes, times) of their files.

    ``get`` gives the frame of ``load(spark, *paths)``, read again only after a change. Where a file is gone, or ``load`` or ``check``
    (a reason against it, or None) fails, it gives None and remembers the signature, so broken files are tried once and not at every
    call; restored ones are read again.
    """

    spark: SparkSession
    paths: tuple[str, ...]
    load: Callable[..., DataFrame]
    check: Callable[[DataFrame], str | None] = lambda frame: None
    loads: int = 0
    reason: str | None = None
    _frame: DataFrame | None = field(default=None, repr=False)
    _mark: str | None = field(default=None, repr=False)
    _failed: str | None = field(default=None, repr=False)

    def get(self) -> DataFrame | None:
        if not all(exists(self.spark, p) for p in self.paths):
            self._frame, self._mark, self.reason = None, None, "files are gone"
            return None
        mark = signature(self.spark, *self.paths)
        if mark == self._mark:
            return self._frame
        if mark == self._failed:
            return None
        self.loads += 1
        try:
            frame = self.load(self.spark, *self.paths)
            self.reason = self.check(frame)
        except Exception as e:  # noqa: BLE001  whatever a half-written file raises
            frame, self.reason = None, f"{type(e).__name__}: {str(e)[:160]}"
        if self.reason is not None:
            self._frame, self._mark, self._failed = None, None, mark
            return None
        self._frame, self._mark, self._failed = frame, mark, None
        return frame


def reparsed(state: DataFrame, originals: DataFrame, parse: Callable[[Column], Column], problem: Callable[[Column], Column]) -> DataFrame:
    """url, source, outcome, reason, fetched_at, run_id, hash and record of every staged url, parsed again from its saved original.

    state: url, source, original_url, outcome, fetched_at, run_id (one row a url). originals: url, saved_at, content (the last one saved
    of a url counts). parse: the text of a content; problem: why a text can't be used, or null. Dates and runs stay those of the fetch;
    a url without an original is an error, a text that another url had before (by run, fetch and url) is quarantined, and a good one
    keeps "changed" where it was that, else it is "new".
    """
    last = originals.groupBy("url").agg(F.max_by("content", "saved_at").alias("content")).withColumnRenamed("url", "original_url")
    read = state.join(last, "original_url", "left").withColumn("record", parse(F.col("content")))
    read = read.withColumn("hash", F.sha2(F.col("record"), 256)).withColumn("bad", F.when(F.col("content").isNull(), "no original").otherwise(problem(F.col("record"))))
    # Copies meet by their hash in a minimum, which is combined before the shuffle; no group is ever sorted as a whole.
    place = F.struct("run_id", "fetched_at", "url")
    first = read.where("content is not null").groupBy("hash").agg(F.min(place).alias("first"))
    both = read.join(first, "hash", "left").withColumn("copy", F.col("content").isNotNull() & (F.col("first.url") != F.col("url")))
    outcome = F.when(F.col("content").isNull(), "error").when(F.col("copy") | F.col("bad").isNotNull(), "quarantined").when(F.col("outcome") == "changed", "changed").otherwise("new")
    reason = F.when(F.col("copy"), F.concat(F.lit("same text as "), F.col("first.url"))).otherwise(F.col("bad"))
    return both.select("url", "source", outcome.alias("outcome"), reason.alias("reason"), "fetched_at", "run_id", "hash", F.when(reason.isNull(), F.col("record")).alias("record"))
