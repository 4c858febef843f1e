"""From hits to the context of an answer, for a table of questions: gates, fallbacks, exact sections, neighbours and their texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ContextOptions:
    """Gates by relevance, and how much goes into a context."""

    k: int = 5
    threshold: float = 0.65
    support: float = 0.55
    floor: float = 0.50
    neighbours: bool = True
    whole: int = 4
    chars: int = 6000
    passage: int = 1200


def _best(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__best", F.max("relevance").over(Window.partitionBy("qid")))


def gated(questions: DataFrame, hits: DataFrame, raw: DataFrame, options: ContextOptions = ContextOptions()) -> DataFrame:
    """qid, key, relevance, how and nth of the hits that may reach an answer; a question without any has no row.

    A question whose best hit reaches the threshold keeps the hits that do and, as support, sections down to ``support`` ("gate"). For
    the others the hits of the question as it was typed that reach it count ("raw"), or else, where the question has legal terms, the
    best ``k`` of both down to ``floor`` ("rescued").
    hits, raw: qid, key, rank, relevance, is_section. questions: qid, legal (boolean).
    """
    o = options
    keep = ["qid", "key", "relevance", "rank"]
    passes = (F.col("__best") >= o.threshold) & ((F.col("relevance") >= o.threshold) | (F.col("is_section") & (F.col("relevance") >= o.support)))
    gate = _best(hits).where(passes).select(*keep, F.lit("gate").alias("how"))
    left = questions.join(gate.select("qid").distinct(), "qid", "left_anti")
    typed = raw.join(left.select("qid"), "qid", "left_semi").where(F.col("relevance") >= o.threshold).select(*keep, F.lit("raw").alias("how"))
    rest = left.join(typed.select("qid").distinct(), "qid", "left_anti").where("legal")
    pool = hits.unionByName(raw).join(rest.select("qid"), "qid", "left_semi").groupBy("qid", "key").agg(F.max("relevance").alias("relevance")).where(F.col("relevance") >= o.floor)
    order = Window.partitionBy("qid").orderBy(F.desc("relevance"), "key")
    rescued = pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= o.k).select(*keep, F.lit("rescued").alias("how"))
    return gate.unionByName(typed).unionByName(rescued).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "key"))).drop("rank")


def context(questions: DataFrame, hits: DataFrame, raw: DataFrame, exact: DataFrame, sections: DataFrame, listed: DataFrame | None = None, options: ContextOptions = ContextOptions()) -> DataFrame:
    """qid, place, key, how, relevance and text of what an answer is given.

    exact: qid, key, at: sections that a question names, which come first in their order. listed: key, section_key: tables of contents
    among the hits, which give way to the sections that they list. Then come the gated hits that aren't there yet, ``k`` in all. The
    sections before and behind the first one follow it, if it is a section, was named or reached the threshold, and they aren't there
    yet (a repealed one only beside a repealed one). sections: key, law, seq, status, text. The first ``whole`` sections have their text up to ``chars``,
    what follows a passage of ``passage`` characters; keys that aren't sections have none. Every list is one question's and short.
    """
    o, by_question = options, Window.partitionBy("qid")
    found = gated(questions, hits, raw, o)
    if listed is not None:
        inner = found.join(listed, "key").select("qid", F.col("section_key").alias("key"), "relevance", F.lit("listed").alias("how"), "nth")
        found = found.join(listed.select("key").distinct(), "key", "left_anti").select(*inner.columns).unionByName(inner)
        once = Window.partitionBy("qid", "key").orderBy("nth", "how")
        found = found.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    named = exact.select("qid", "key", F.lit(1.0).alias("relevance"), F.lit("exact").alias("how"), F.col("at").alias("nth"))
    rows = named.withColumn("part", F.lit(0)).unionByName(found.join(named, ["qid", "key"], "left_anti").select(*named.columns).withColumn("part", F.lit(1)))
    placed = rows.withColumn("place", F.row_number().over(by_question.orderBy("part", "nth", "key"))).where(F.col("place") <= o.k).select("qid", "place", F.lit(0).alias("sub"), "key", "how", "relevance")
    if o.neighbours:
        top = placed.where((F.col("place") == 1) & (F.col("relevance") >= o.threshold)).join(sections.select("key", "law", "seq", F.col("status").alias("__status")), "key")
        asked = top.select("qid", "law", "__status", F.explode(F.array(F.struct(F.lit(1).alias("sub"), (F.col("seq") - 1).alias("seq")), F.struct(F.lit(2).alias("sub"), (F.col("seq") + 1).alias("seq")))).alias("x")).select("qid", "law", "__status", "x.*")
        near = asked.join(sections.select("key", "law", "seq", "status"), ["law", "seq"]).where(F.coalesce(F.col("status") != "repealed", F.lit(True)) | F.col("__status").eqNullSafe(F.lit("repealed")))
        near = near.join(placed.select("qid", "key"), ["qid", "key"], "left_anti").select("qid", F.lit(1).alias("place"), "sub", "key", F.lit("neighbour").alias("how"), F.lit(None).cast("double").alias("relevance"))
        placed = placed.unionByName(near)
    ordered = placed.withColumn("n", F.row_number().over(by_question.orderBy("place", "sub"))).join(sections.select("key", F.col("text").alias("__text")), "key", "left")
    nth_section = F.count("__text").over(by_question.orderBy("n"))
    text = F.when(nth_section <= o.whole, F.left("__text", F.lit(o.chars))).otherwise(F.left("__text", F.lit(o.passage)))
    return ordered.select("qid", F.col("n").alias("place"), "key", "how", "relevance", text.alias("text"))
