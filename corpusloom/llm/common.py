"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
#: Rows of whole texts in a batch that goes to a Python worker: texts and what is made of them are held several times,
#: on both sides, and Spark's 10,000 rows would take some hundred MB a task.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Let batches of rows for Python workers hold at most BATCH_ROWS from now on (a setting of the session)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset one in the warehouse, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return _FALLBACK[app]


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder below ``shared_dir``; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/corpusloom-{spark.sparkContext.applicationId}"
    files, place = _file_system(spark, folder)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return folder


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back; lost executors then cost no recomputation.

    The application's tables go when it ends; those that nothing will read any more can go earlier (``release``).
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``materialise`` that nothing will read any more."""
    for path in paths:
        files, place = _file_system(spark, path)
        files.delete(place, True)


def held_out(key: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4 (false for a null id)."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file: in ``folder``, or where the installed vocabulary package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
