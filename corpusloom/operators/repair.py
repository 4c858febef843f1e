"""Words that recognition tore apart ("Coun cil") put together again, in whole texts and until nothing more can be joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import stored

# Words of one or two letters, which are no torn endings.
SHORT_WORDS = "a i an as at be by do go he if in is it me my no of on or so to up us we".split()
BROADCAST_ROWS = 1_000_000  # pairs to join, some 40 bytes each; beyond that the join shuffles
#: Where a run of letters begins or ends.
_EDGE = r"(?<=[A-Za-z])(?![A-Za-z])|(?<![A-Za-z])(?=[A-Za-z])"


def vocabulary(rows: DataFrame, text: str = "text") -> DataFrame:
    """word (lower case) and n, how often it stands in all texts."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _is_word(piece: Column) -> Column:
    return piece.rlike("^[A-Za-z]+$")


def _pair(pieces: Column, i: Column) -> Column:
    """The pair around the i-th piece where that is one space between words, as "a b"; behind a lone s a stop is kept ("see s. 5")."""
    a, b, behind = F.get(pieces, i - 1), F.get(pieces, i + 1), F.get(pieces, i + 2)
    stop = F.when((F.lower(b) == "s") & F.coalesce(behind, F.lit("")).startswith("."), ".").otherwise("")
    return F.when((F.get(pieces, i) == " ") & (i > 0) & _is_word(a) & _is_word(b), F.lower(F.concat(a, F.lit(" "), b, stop)))


def joinable(pairs: DataFrame, words: DataFrame, least: int = 10) -> DataFrame:
    """The pairs (column pair) whose joined word is common (``least`` times) and commoner than both pieces.

    An ending of one or two letters that is no word is judged by the first piece alone; a lone s before a stop is a word.
    """
    cut = pairs.select("pair", F.substring_index("pair", " ", 1).alias("a"), F.rtrim(F.substring_index("pair", " ", -1), F.lit(".")).alias("b"))
    count = lambda name, by: words.select(F.col("word").alias(by), F.col("n").alias(name))
    both = cut.withColumn("ab", F.concat("a", "b")).join(count("n_ab", "ab").where(F.col("n_ab") >= least), "ab").join(count("n_a", "a"), "a", "left").join(count("n_b", "b"), "b", "left")
    ending = (F.length("b") <= 2) & ~F.col("b").isin(SHORT_WORDS) & ~F.col("pair").endswith(".")
    return both.where((F.coalesce("n_a", F.lit(0)) < F.col("n_ab")) & (ending | (F.coalesce("n_b", F.lit(0)) < F.col("n_ab")))).select("pair")


def repaired(rows: DataFrame, key: str, words: DataFrame, text: str = "text", least: int = 10) -> DataFrame:
    """``rows`` with ``text`` repaired. key names a row; words: as ``vocabulary`` gives them; null texts stay null.

    In a pass all spaces of a text are judged by the words as they stand then, and those to go go at once; passes end when none goes,
    and only texts that changed take part in the next. What is judged is each different pair once, not each place.
    """
    done, words = None, stored(words, "words")
    left = stored(rows.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t")), "torn")
    while True:
        cut = left.select(key, F.split("t", _EDGE).alias("p"))
        told = F.transform("p", lambda x, i: _pair(F.col("p"), i))
        told = stored(cut.select(key, F.array_distinct(F.array_compact(told)).alias("q")), "pairs-of-texts")  # read twice, made once
        pairs = told.select(key, F.explode("q").alias("pair"))
        good = stored(joinable(pairs.select("pair").distinct(), words, least), "pairs")
        good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
        own = stored(pairs.join(good, "pair").groupBy(key).agg(F.collect_set("pair").alias("go")), "own-pairs")
        unchanged = left.join(own.select(key), key, "left_anti")
        done = unchanged if done is None else done.unionByName(unchanged)
        if own.isEmpty():
            whole = done.select(key, F.col("t").alias("__t"))
            return rows.join(whole, key, "left").withColumn(text, F.coalesce("__t", text)).drop("__t")
        both = cut.join(own, key)
        drop = lambda x, i: F.when(F.coalesce(F.array_contains("go", _pair(F.col("p"), i)), F.lit(False)), "").otherwise(x)
        left = stored(both.select(key, F.array_join(F.transform("p", drop), "").alias("t")), "torn")
