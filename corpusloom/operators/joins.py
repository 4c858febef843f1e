"""Joins that need more than an equal key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_held(rows: DataFrame, held: DataFrame, key: Column, held_key: Column) -> DataFrame:
    """Rows whose derived key the other table doesn't have."""
    return rows.withColumn("__k", key).join(held.select(held_key.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def filled(hits: DataFrame, meta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Missing metadata of hits taken from a table of metadata; what a hit has stays."""
    other = meta.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = hits.join(other, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def nearest_owner(numbers: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """For each number (start, stop) of a text the owner span right after it, else right before it, else the nearest one."""
    both = numbers.join(owners.withColumnsRenamed({"start": "o_start", "stop": "o_stop"}), key)
    after, before = F.col("o_start") - F.col("stop"), F.col("start") - F.col("o_stop")
    gap = F.least(F.abs(after), F.abs(before))
    prio = F.when(after.between(0, 5), 0).when(before.between(0, 5), 1).otherwise(2)
    w = Window.partitionBy(key, "start").orderBy(prio, gap, "o_start")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Shingles of chunks (8 bytes each) up to which they are broadcast to the sections' scan; beyond that the join shuffles.
BROADCAST_SHINGLES = 2_000_000


def shingles(rows: DataFrame, size: int, step: int) -> DataFrame:
    """``rows`` with text replaced by h, a row for each hash of ``size`` characters at every ``step``-th place (shorter texts have one).

    A substring is found by counting characters from the front, so long texts are cut into overlapping blocks first, and
    those into smaller ones.
    """
    for width in (16_384 // step * step, 256 // step * step):
        n = F.greatest(F.ceil((F.length("text") - size + 1) / width), F.lit(1))
        rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))).withColumn("text", F.substring("text", F.col("__i") * width + 1, F.lit(width + size - 1))).drop("__i")
    last = F.greatest(F.lit(1), F.length("text") - size + 1)
    each = rows.withColumn("__i", F.explode(F.sequence(F.lit(1), last, F.lit(step))))
    return each.withColumn("h", F.xxhash64(F.substring("text", F.col("__i"), F.lit(size)))).drop("__i", "text")


def shingle_containment(chunks: DataFrame, sections: DataFrame, group: str, size: int = 30, stride: int = 10, share: float = 0.3) -> DataFrame:
    """For each chunk the section of its group that holds most of its shingles, ``share`` of them at least.

    chunks: group, chunk_id, text; sections: group, section_id, text; texts squashed. Shingles of sections start at every
    place, those of chunks at every ``stride``; they meet by hash and group. Only the shingles that a chunk has leave the
    scan of the sections: the chunks' hashes are broadcast where their number allows it.
    """
    asked = shingles(chunks.select(group, "chunk_id", "text"), size, stride).distinct()
    known = asked.select("h").distinct()
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    total = Window.partitionBy(group, "chunk_id")
    held = shingles(sections.select(group, "section_id", "text"), size, 1).join(known, "h", "left_semi").distinct()
    met = asked.withColumn("of", F.count("*").over(total)).join(held, [group, "h"]).groupBy(group, "chunk_id", "section_id", "of").agg(F.count("*").alias("n"))
    best = total.orderBy(F.desc("n"), "section_id")
    return met.where(F.col("n") >= F.col("of") * share).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def bigrams(rows: DataFrame, key: str, words: Column) -> DataFrame:
    """key, place, word and the word after it."""
    return rows.select(key, F.posexplode(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.struct(w.alias("word"), F.get(words, i + 1).alias("following")))).alias("place", "p")).select(key, "place", "p.*")


#: Words of a law's title that many titles have. Fixed values.
TITLE_NOISE = "the of and act ordinance order code rules law laws for to in pakistan amendment".split()


def law_patterns(laws: DataFrame, aliases: DataFrame | None = None, least: int = 2) -> DataFrame:
    """title and pattern: the words of each title, year and "the" left out, if ``least`` of them tell it; and its aliases (title, pattern)."""
    words = F.filter(F.regexp_extract_all(F.lower(F.regexp_replace("title", r",?\s*\d{4}$", "")), F.lit("[a-z]+"), F.lit(0)), lambda w: w != "the")
    telling = F.size(F.filter(words, lambda w: ~w.isin(TITLE_NOISE)))
    own = laws.withColumn("pattern", F.array_join(words, r"\s+")).where(telling >= least).select("title", "pattern")
    return own if aliases is None else own.unionByName(aliases.join(laws.select("title").distinct(), "title", "left_semi").select("title", "pattern"))


def laws_named(questions: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """key and title of the laws that a question names (column question). A pattern's first word selects the questions that are searched."""
    words = questions.select(key, F.lower("question").alias("__q"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), F.lit(0)))).alias("__w"))
    asked = patterns.withColumn("__w", F.regexp_extract("pattern", "^([a-z]+)", 1))
    return words.join(asked, "__w").where(F.regexp_like(F.col("__q"), F.concat(F.lit(r"\b(?:"), F.col("pattern"), F.lit(r")\b")))).select(key, "title").distinct()


def exact_sections(refs: DataFrame, records: DataFrame, limit: int = 2) -> DataFrame:
    """Records for (title, number) references; the first record of a pair wins, ``limit`` for each question."""
    from corpusloom.functions.text import section_number

    first = Window.partitionBy("title", "number").orderBy("seq")
    table = records.withColumn("number", section_number(F.col("section"))).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    hits = refs.withColumn("number", section_number(F.col("number"))).join(table, ["title", "number"])
    w = Window.partitionBy("question").orderBy("place", "seq")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def reference_status(refs: DataFrame, sections: DataFrame, laws: DataFrame) -> DataFrame:
    """verified (section held), law_held, not_found, or not_checked where the reference names no law."""
    s = sections.select("law", "number", F.lit(True).alias("__s")).distinct()
    w = laws.select("law", F.lit(True).alias("__l")).distinct()
    status = F.when(F.col("law").isNull(), "not_checked").when(F.col("__s"), "verified").when(F.col("__l"), "law_held").otherwise("not_found")
    return refs.join(s, ["law", "number"], "left").join(w, "law", "left").withColumn("status", status).drop("__s", "__l")
