"""A corpus pipeline: language identification, line dedup, SimHash near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import materialise, release
from corpusloom.llm.decontamination import decontamination_stage
from corpusloom.llm.language_id import language_stage
from corpusloom.llm.line_dedup import line_dedup_stage
from corpusloom.llm.sentencepiece_codec import sentencepiece_stage
from corpusloom.llm.simhash import simhash_stage

STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]
#: Compression, XXH64 and the model's merges have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each other stage returns is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:  # all that is read from now on is in the new table
            release(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
