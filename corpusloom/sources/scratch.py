"""Tables that a long job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset in the warehouse, or in a temporary folder in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read back: what is read several times is computed once, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


_BY_SIGNATURE: dict[tuple[str, str], str] = {}


def signature(spark: SparkSession, *paths: str) -> str:
    """One value for the files below paths: their names, sizes and times, summed where they are listed; no content is read."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "modificationTime")
    row = files.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("mix")).first()
    return f"{row.n}-{row.size}-{row.mix}"


def stored_once(spark: SparkSession, name: str, mark: str, build: Callable[[str], None]) -> str:
    """Folder of what ``build`` wrote for ``mark``; built once in an application, and again only where the mark is another one."""
    at = (spark.sparkContext.applicationId, f"{name}-{mark}")
    if at not in _BY_SIGNATURE:
        path = scratch_path(spark, name)
        build(path)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
        _BY_SIGNATURE[at] = path
    return _BY_SIGNATURE[at]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any of Spark's file systems."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
