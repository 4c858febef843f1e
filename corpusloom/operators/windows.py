"""Order-sensitive operators: versions, budgets, streaks, sessions, as-of joins, numbering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_occurrence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def versions(rows: DataFrame, key: str, at: list[str]) -> DataFrame:
    """Adds version (from 1), valid_to (start of the next version) and is_latest."""
    w = Window.partitionBy(key).orderBy(*at)
    following = F.lead(at[0]).over(w)
    return rows.withColumns({"version": F.row_number().over(w), "valid_to": following, "is_latest": F.lead(F.lit(1)).over(w).isNull()})


def changes(rows: DataFrame, key: str, at: list[str], digest: str) -> DataFrame:
    """Adds change: baseline for a key's first row, then unchanged or changed against the row before."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(*at))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*at)) == 1
    return rows.withColumn("change", F.when(first, "baseline").when(before.eqNullSafe(F.col(digest)), "unchanged").otherwise("changed"))


def newest_within_budget(rows: DataFrame, key: str, at: str, cost: Column, budget: int) -> DataFrame:
    """Newest rows of each key while their summed cost keeps to the budget; the first overflow ends it."""
    w = Window.partitionBy(key).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def last_n(rows: DataFrame, key: str, at: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*at)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def failure_streak(rows: DataFrame, key: str, at: list[str], failed: Column, limit: int = 5) -> DataFrame:
    """Adds streak (failures in a row up to each row, zero after a success) and locked."""
    w = Window.partitionBy(key).orderBy(*at)
    marked = rows.withColumn("__group", F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "__group").orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum(failed.cast("int")).over(inside)
    return marked.withColumn("streak", streak).withColumn("locked", F.col("streak") >= limit).drop("__group")


def rolling_sum(rows: DataFrame, key: str, seconds: Column, value: Column, width: int = 60) -> Column:
    """Sum of values in the last ``width`` seconds, the row's own included (a Column to add)."""
    return F.sum(value).over(Window.partitionBy(key).orderBy(seconds).rangeBetween(-(width - 1), 0))


def sessions(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Sessions of each key: start, end of the last event, and events."""
    return rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).drop("w")


def next_as_of(left: DataFrame, right: DataFrame, left_at: str, right_at: str, bucket: int) -> DataFrame:
    """For each left row the first right row at or after it, however late; unmatched rows stay.

    Both sides are put in one order of time, bucket by bucket (``bucket`` seconds each), and a right row is carried back to
    the left rows before it; no row meets another. What a bucket doesn't answer comes from the first row of the next
    bucket that has any: a table of one row for each bucket, whose number follows the span of time and not the rows.
    right has the columns right_at and payload (a struct); of right rows of one time the smallest payload counts.
    """
    slot = lambda c: F.floor(F.col(c).cast("timestamp").cast("long") / bucket)
    row = F.struct(F.col(right_at), F.col("payload"))
    behind = right.where(F.col(right_at).isNotNull()).select(slot(right_at).alias("__slot"), F.col(right_at).alias("__at"), row.alias("__right"))
    ahead = left.select(slot(left_at).alias("__slot"), F.col(left_at).alias("__at"), F.struct(*left.columns).alias("__left"))
    both = ahead.unionByName(behind, allowMissingColumns=True)
    # Backwards in time; a right row comes before the left rows of its own time.
    backwards = Window.partitionBy("__slot").orderBy(F.desc("__at"), F.desc(F.col("__right").isNotNull()), F.desc("__right")).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__own", F.last("__right", ignorenulls=True).over(backwards)).where("__left is not null")
    firsts = both.where("__slot is not null").groupBy("__slot").agg(F.min("__right").alias("__first"))
    after = Window.orderBy(F.desc("__slot")).rowsBetween(Window.unboundedPreceding, -1)
    later = firsts.select("__slot", F.last("__first", ignorenulls=True).over(after).alias("__later"))
    return carried.join(later, "__slot", "left").select("__left.*", F.when(F.col("__at").isNotNull(), F.coalesce("__own", "__later")).alias("next"))


def neighbours(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds previous and following: the value of the rows next to each one."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"previous": F.lag(value).over(w), "following": F.lead(value).over(w)})


def repeated_suffix(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Adds unique_name: the second row of a name gets "-2", the third "-3"."""
    n = F.row_number().over(Window.partitionBy(*key, name).orderBy(*order))
    return rows.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))


def sequence_numbers(numbers: Column) -> Column:
    """Greedy 1, 2, 3, ... within an array of numbers: only the next expected number is kept."""
    start = F.struct(F.lit(1).alias("want"), F.array().cast("array<int>").alias("kept"))
    step = lambda s, x: F.when(x == s["want"], F.struct((s["want"] + 1).alias("want"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    return F.aggregate(numbers, start, step, lambda s: s["kept"])


def capped(rows: DataFrame, key: str, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows of each source, in order (a quota of a run)."""
    return last_n(rows, key, [F.asc(c) for c in order], cap)


def illegal_transitions(rows: DataFrame, key: str, at: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Moves between states (columns from_state, to_state) that the table of allowed moves doesn't have."""
    moved = rows.withColumn("from_state", F.lag(state).over(Window.partitionBy(key).orderBy(*at))).withColumn("to_state", F.col(state)).where("from_state is not null")
    return moved.join(F.broadcast(allowed.select("from_state", "to_state")), ["from_state", "to_state"], "left_anti")


def round_robin(rows: DataFrame, group: str, order: list[str], per_round: int = 1) -> DataFrame:
    """Adds round: the n-th row of each group is of round n, so a cut by (round, group) takes from all groups alike."""
    return rows.withColumn("round", F.ceil(F.row_number().over(Window.partitionBy(group).orderBy(*order)) / per_round))


def pilot(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows: favoured ones first (column weight, most first), then a round of the groups at a time, those with unseen names first.

    rows: key, weight, group and names (array). In its turn a group gives its first row (by key) with a name that no row
    taken so far has, else its first one. That can only be one of its first n rows or the first one of some name, so just
    those are gathered, and their number doesn't follow the rows.
    """
    favoured = last_n(rows.where("weight > 0").withColumn("__all", F.lit(1)), "__all", [F.desc("weight"), F.asc(key)], n).drop("__all")
    rest = rows.where("weight = 0 or weight is null")
    firsts = rest.select("group", key, F.explode("names").alias("name")).groupBy("group", "name").agg(F.min(key).alias(key)).select("group", key)
    early = last_n(rest.select("group", key), "group", [F.asc(key)], n)
    pool = rest.join(firsts.unionByName(early).distinct(), ["group", key], "left_semi")
    both = favoured.select(key, F.lit(True).alias("first"), "weight", "group", "names").unionByName(pool.select(key, F.lit(False).alias("first"), "weight", "group", "names"))

    def choose(found: pd.DataFrame) -> pd.DataFrame:
        head = found[found["first"]].sort_values(["weight", key], ascending=[False, True])
        picked, seen = list(head[key]), {x for names in head["names"] for x in names}
        by_group = {g: list(zip(p[key], p["names"])) for g, p in found[~found["first"]].sort_values(key).groupby("group")}
        while len(picked) < n and any(by_group.values()):
            for g in sorted(by_group):
                if by_group[g] and len(picked) < n:
                    at = next((i for i, (_, names) in enumerate(by_group[g]) if not set(names) <= seen), 0)
                    chosen, names = by_group[g].pop(at)
                    picked.append(chosen)
                    seen |= set(names)
        return pd.DataFrame({key: picked, "place": range(1, len(picked) + 1)})

    return both.groupBy(F.lit(1).alias("__all")).applyInPandas(choose, f"{key} long, place int")


def seeded_sample(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group by the hash of their key and a seed: the same rows in every run."""
    return last_n(rows, group, [F.asc(F.xxhash64(F.col(key), F.lit(seed))), F.asc(key)], n)
