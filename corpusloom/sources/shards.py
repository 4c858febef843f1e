"""Vectors of texts as resumable shards: computed once for each text, a range of keys at a time, counted before they are believed.

Layout of a folder: ``vectors/<shard>`` has key, unit and vector of one step, ``log`` a line for each finished shard (its units and
their counts). A step writes its shard first and its line last: what a run leaves behind without a line isn't read, and the next run
does that step again and no other. A line whose counts don't agree with its shard isn't believed either.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.scratch import exists
from corpusloom.sources.sinks import append_log, cache_key

UNITS = 256  # ranges of the key, by its first two digits
STEP_ROWS = 100_000  # vectors of a step, about: what an interrupted run loses at most
_LOG = "shard string, unit int, n bigint, source string, at timestamp"
_SHARD = "key string, unit int, vector array<double>"


@dataclass(frozen=True)
class Progress:
    """What a run found and did; complete: every text has its vector."""

    texts: int
    reused: int
    embedded: int
    missing: int
    steps: int
    complete: bool


def unit(key: Column) -> Column:
    return F.conv(F.left(key, F.lit(2)), 16, 10).cast("int")


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LOG).json(f"{path}/log") if exists(spark, f"{path}/log") else spark.createDataFrame([], _LOG)


def believed(spark: SparkSession, path: str) -> list[str]:
    """Shards whose rows, counted by unit, are what the log says (a count by unit is read, no vector)."""
    told = _log(spark, path)
    names = [r.shard for r in told.select("shard").distinct().collect()]  # a row a step
    there = [n for n in names if exists(spark, f"{path}/vectors/{n}")]
    if not there:
        return []
    rows = spark.read.schema(_SHARD).parquet(*(f"{path}/vectors/{n}" for n in there)).withColumn("shard", F.regexp_extract(F.input_file_name(), r"/vectors/([0-9a-f]+)/", 1))
    held = rows.groupBy("shard", "unit").agg(F.count(F.lit(1)).alias("held"))
    both = told.join(held, ["shard", "unit"], "full").groupBy("shard").agg(F.bool_and(F.col("n").eqNullSafe(F.col("held"))).alias("same"))
    return sorted(r.shard for r in both.where("same").collect())


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """key, unit and vector of all believed shards."""
    names = believed(spark, path)
    return spark.read.schema(_SHARD).parquet(*(f"{path}/vectors/{n}" for n in names)) if names else spark.createDataFrame([], _SHARD)


def _write(rows: DataFrame, path: str, source: str) -> int:
    """One shard and, once its rows are counted, its lines in the log."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.select("key", "unit", "vector").write.parquet(f"{path}/vectors/{name}")
    counts = spark.read.schema(_SHARD).parquet(f"{path}/vectors/{name}").groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    lines = counts.select(F.lit(name).alias("shard"), "unit", "n", F.lit(source).alias("source"), F.current_timestamp().alias("at")).coalesce(1)
    append_log(lines, f"{path}/log")
    return _log(spark, path).where(F.col("shard") == name).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def embed_missing(texts: DataFrame, path: str, model: str, embed: Callable[[Column], Column], text: str = "text", step_rows: int = STEP_ROWS, steps: int | None = None, seconds: float | None = None) -> Progress:
    """Compute the vectors that ``path`` lacks, step by step, until all are there, or ``steps`` or ``seconds`` are used up.

    embed: vector (array<double>) of a text column. Equal texts are one text; null texts have no vector. A step is a run of units
    that lack about ``step_rows`` vectors together.
    """
    spark, start = texts.sparkSession, time.monotonic()
    keyed = texts.where(F.col(text).isNotNull()).select(cache_key(model, F.col(text)).alias("key"), F.col(text).alias("text")).withColumn("unit", unit(F.col("key")))
    held = vectors(spark, path).select("key")
    lack = keyed.join(held, "key", "left_anti")
    by_unit = {r.unit: r.n for r in lack.groupBy("unit").agg(F.count_distinct("key").alias("n")).collect()}  # 256 rows at most
    total = keyed.select("key").distinct().count()
    missing, done, taken = sum(by_unit.values()), 0, 0
    while by_unit and (steps is None or taken < steps) and (seconds is None or time.monotonic() - start < seconds):
        chosen, rows = [], 0
        for u in sorted(by_unit):
            if chosen and rows + by_unit[u] > step_rows:
                break
            chosen.append(u)
            rows += by_unit[u]
        part = keyed.where(F.col("unit").isin(chosen)).join(held, "key", "left_anti").groupBy("key", "unit").agg(F.min("text").alias("text"))
        done += _write(part.withColumn("vector", embed(F.col("text")).cast("array<double>")), path, "embedded")
        taken += 1
        for u in chosen:
            del by_unit[u]
    return Progress(total, total - missing, done, missing - done, taken, missing == done)


def seed(earlier: DataFrame, path: str, model: str, expected: int, text: str = "text") -> int:
    """Take over vectors of an earlier index (text, vector) that are new here; nothing where its rows aren't ``expected``. Returns how many."""
    spark = earlier.sparkSession
    if earlier.count() != expected:
        return 0
    keyed = earlier.where(F.col(text).isNotNull() & F.col("vector").isNotNull()).select(cache_key(model, F.col(text)).alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    new = keyed.groupBy("key").agg(F.min("vector").alias("vector")).join(vectors(spark, path).select("key"), "key", "left_anti").withColumn("unit", unit(F.col("key")))
    return _write(new, path, "seeded")


def assembled(chunks: DataFrame, path: str, model: str, text: str = "text") -> DataFrame:
    """``chunks`` with their vectors; a chunk without one is an error of the build, so ask ``Progress.complete`` first."""
    keyed = chunks.withColumn("__key", cache_key(model, F.col(text)))
    return keyed.join(vectors(chunks.sparkSession, path).select(F.col("key").alias("__key"), "vector"), "__key").drop("__key")
