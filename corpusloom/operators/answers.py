"""Steps between retrieval and answer: gates, expansion, neighbours, references, and the checks' report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import checks


def chat_hits(hits: DataFrame, question: str, threshold: float = 0.65, support: float = 0.55, fallback: float = 0.60) -> DataFrame:
    """Hits of each question above the threshold, with weaker ones as support; without any, those above the fallback."""
    w = Window.partitionBy(question)
    best = F.max("relevance").over(w)
    return hits.withColumn("__b", best).where(((F.col("__b") >= threshold) & (F.col("relevance") >= support)) | ((F.col("__b") < threshold) & (F.col("relevance") >= fallback))).drop("__b")


def with_neighbours(hits: DataFrame, sections: DataFrame, question: str, law: str = "law", seq: str = "seq") -> DataFrame:
    """The sections next to each question's first hit in its law, unless among the hits (or repealed while the hit isn't)."""
    top = hits.where("rank = 1").select(question, law, F.col(seq).alias("__seq"), F.col("status").alias("__status"))
    near = top.select("*", F.explode(F.array(F.col("__seq") - 1, F.col("__seq") + 1)).alias(seq)).join(sections, [law, seq])
    allowed = F.coalesce(F.col("status") != "repealed", F.lit(True)) | F.col("__status").eqNullSafe(F.lit("repealed"))
    return near.where(allowed).join(hits.select(question, law, seq), [question, law, seq], "left_anti").drop("__seq", "__status")


def expanded_sections(hits: DataFrame, sections: DataFrame, question: str, key: str, most: int = 4, chars: int = 6000) -> DataFrame:
    """Full text of the first ``most`` sections of each question, each cut to ``chars``."""
    w = Window.partitionBy(question)
    first = hits.groupBy(question, key).agg(F.min("rank").alias("rank")).withColumn("n", F.row_number().over(w.orderBy("rank", key))).where(F.col("n") <= most)
    return first.join(sections.select(key, F.left("text", F.lit(chars)).alias("text")), key).drop("n")


def section_references(text: Column) -> Column:
    """Structs number and law of the sections that a text refers to; the law is the act named after the number, if any."""
    pattern = rf"(?<!\w)(?i:{T.ANNOUNCING}|ss\.)\s*({T.NUMBERED})(?:\([^)]*\))*(?:,?\s+(?:of\s+)?(?:the\s+)?({checks.ACT_NAME}))?"
    part = lambda m, i: F.regexp_extract(m, pattern, i)
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: T.is_section_number(part(m, 1)))
    return F.transform(found, lambda m: F.struct(T.section_number(part(m, 1)).alias("number"), F.nullif(part(m, 2), F.lit("")).alias("law")))


def merged_entities(entities: DataFrame, key: str) -> DataFrame:
    """Entities of a document by type and normalised text: count, best score, first place and its surface."""
    name = T.one_space(F.lower("text"))
    return entities.groupBy(key, "type", name.alias("name")).agg(F.count("*").alias("n"), F.max("score").alias("score"), F.min("at").alias("first_at"), F.min_by("text", "at").alias("surface"))


def merged_replies(parts: DataFrame, key: str) -> DataFrame:
    """Replies to the parts of a document as one: first type, last outcome, points without repeats in order."""
    points = parts.select(key, "part", F.posexplode("points").alias("at", "point"))
    first = points.groupBy(key, "point").agg(F.min(F.struct("part", "at")).alias("place"))
    listed = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "point"))), lambda x: x["point"]).alias("points"))
    ends = parts.groupBy(key).agg(F.min_by("type", F.when(F.col("type").isNotNull(), F.col("part"))).alias("type"), F.max_by("outcome", F.when(F.col("outcome").isNotNull(), F.col("part"))).alias("outcome"))
    return ends.join(listed, key, "left")


def renumbered(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Adds numbers: the old source number of each new one, by first citation, and the text with its markers rewritten."""
    order = checks.cited_order(F.col(text))
    renamed = F.aggregate(order, F.col(text), lambda t, n: F.replace(t, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.concat(F.lit("[\x01"), F.array_position(order, n).cast("string"), F.lit("]"))))
    return answers.withColumns({"numbers": order, "renumbered": F.replace(renamed, F.lit("\x01"), F.lit(""))})


def citation_report(answers: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """Per answer: markers without a source, section references that no passage backs, and figures that no passage names.

    answers: key, text, sources (their number); passages: key, number, owner, text.
    """
    refs = answers.select(key, F.explode(section_references(F.col("text"))).alias("r")).select(key, "r.number", F.filter(F.split(F.coalesce("r.law", F.lit("")), " "), lambda w: F.length(w) > 3).alias("words")).distinct()
    backed = refs.join(passages.select(key, "number", F.lower("owner").alias("__o")), [key, "number"]).where(F.forall("words", lambda w: F.contains(F.col("__o"), F.lower(w)))).select(key, "number", "words").distinct()
    missing = refs.join(backed, [key, "number", "words"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("number")).alias("unbacked"))
    named = answers.select(key, F.explode(checks.figures(F.col("text"))).alias("f")).distinct()
    known = passages.select(key, F.explode(checks.figures(F.col("text"))).alias("f")).distinct()
    odd = named.join(known, [key, "f"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("f")).alias("unnamed_figures"))
    out = answers.select(key, checks.bad_markers(F.col("text"), F.col("sources")).alias("bad_markers"))
    return out.join(missing, key, "left").join(odd, key, "left")
