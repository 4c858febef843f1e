"""Retrieval quality: ranks, hit rates, sweeps, histograms, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hits(results: DataFrame, gold: DataFrame, question: str, item: str) -> DataFrame:
    """question and rank of its first accepted result (null: none). results: question, item, rank; gold: question, item."""
    found = results.join(gold.select(question, item).distinct(), [question, item], "left_semi").groupBy(question).agg(F.min("rank").alias("rank"))
    return gold.select(question).distinct().join(found, question, "left")


def hit_rates(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """k, hits and questions."""
    wide = ranks.agg(F.count("*").alias("questions"), *(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks))
    return wide.select("questions", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks))).alias("e")).select("e.k", "e.hits", "questions")


def compared(before: DataFrame, after: DataFrame, question: str, missing: int = 99) -> DataFrame:
    """Both ranks of each question and whether the later run is better, worse or the same; no rank counts as ``missing``."""
    both = before.select(question, F.col("rank").alias("rank_before")).join(after.select(question, F.col("rank").alias("rank_after")), question, "full")
    a, b = F.coalesce("rank_before", F.lit(missing)), F.coalesce("rank_after", F.lit(missing))
    return both.withColumn("verdict", F.when(b < a, "better").when(b > a, "worse").otherwise("same"))


def threshold_sweep(scores: DataFrame, thresholds: list[float], score: str, right: str) -> DataFrame:
    """threshold, answered and correct, in one pass over the scores."""
    wide = scores.agg(*(x for i, t in enumerate(thresholds) for x in (F.count_if(F.col(score) >= t).alias(f"a{i}"), F.count_if((F.col(score) >= t) & F.col(right)).alias(f"c{i}"))))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("answered"), F.col(f"c{i}").alias("correct")) for i, t in enumerate(thresholds)))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def score_histogram(scores: DataFrame, score: str, edges: list[float]) -> DataFrame:
    """bucket (from 0) and rows; buckets without rows are there, too."""
    bucket = sum((F.when(F.col(score) >= e, 1).otherwise(0) for e in edges[1:]), F.when(F.col(score) >= edges[0], 1).otherwise(0))
    wide = scores.where(F.col(score).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = scores.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(wide, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def transition_matrix(a: DataFrame, b: DataFrame, key: str, status: str) -> DataFrame:
    """Rows of each pair of statuses in two runs."""
    both = a.select(key, F.col(status).alias("status_a")).join(b.select(key, F.col(status).alias("status_b")), key)
    return both.groupBy("status_a", "status_b").agg(F.count("*").alias("n"))
