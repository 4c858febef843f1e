"""Facets, coverage, inventory and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet(rows: DataFrame, column: str, missing: str = "None") -> DataFrame:
    """Rows of each value, null as a value of its own; sort by n desc, value to show."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def facets(rows: DataFrame, columns: list[str], missing: str = "None") -> DataFrame:
    """All facets in one pass: facet, value, n."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def fill_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, filled and share of rows where it isn't null, in one pass."""
    wide = rows.agg(F.count("*").alias("rows"), *(F.count(c).alias(f"n_{c}") for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("filled")) for c in columns))
    return wide.select("rows", F.explode(each).alias("e")).select("e.field", "e.filled", F.round(F.col("e.filled") / F.nullif("rows", F.lit(0)), 6).alias("share"))


def duplicate_surplus(rows: DataFrame, key: Column) -> DataFrame:
    """Groups with more than one row, and the rows they have too many."""
    per = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    return per.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def outcome_summary(rows: DataFrame, source: str, outcome: str, outcomes: list[str], at: str) -> DataFrame:
    """One row for each source with a count of each outcome, and its last time."""
    counts = [F.count_if(F.col(outcome) == o).alias(o) for o in outcomes]
    return rows.groupBy(source).agg(*counts, F.max(at).alias("last_at"))


def best_copy(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The best row of each key; adds copies, the rows of the key."""
    w = Window.partitionBy(*key)
    return rows.withColumns({"copies": F.count("*").over(w), "__n": F.row_number().over(w.orderBy(*order))}).where("__n = 1").drop("__n")


def coverage(listed: DataFrame, held: DataFrame, key: str, group: str) -> DataFrame:
    """Listed, held and missing keys of each group."""
    flags = listed.select(group, key).distinct().join(held.select(key, F.lit(True).alias("__held")).distinct(), key, "left")
    return flags.groupBy(group).agg(F.count("*").alias("listed"), F.count("__held").alias("held")).withColumn("missing", F.col("listed") - F.col("held"))


def precedence(rows: DataFrame, sources: list[tuple[str, Column]]) -> DataFrame:
    """Adds value and value_source: the first source (name, column) that has one."""
    value = F.coalesce(*(c for _, c in sources))
    name = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in sources))
    return rows.withColumns({"value": value, "value_source": name})


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Latest state by key: an update replaces what is held. Columns must agree."""
    return current.join(updates.select(key), key, "left_anti").unionByName(updates)


def assembled_text(rows: DataFrame, key: str, order: str, text: Column, separator: str = "\n\n") -> DataFrame:
    """One text for each key from its rows in order (a key is one document, bounded as such)."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), text.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["t"]), separator).alias("text"))
