"""Filter interaction audit: what each filter removes at each place of each order of the filters, from one pass over the texts.

A document is known by its mask, the set of filters it fails. In the lexicographic list of all orders (Lehmer ranks), those in
which a mask falls to a given filter at a given step share a prefix (filters it passes, then that one), and so are intervals of
ranks. Each interval adds a mask's count at its first rank and takes it away after its last one; a running sum over the ranks
gives all orders at once. Work on rows ends with one count for each part and mask.

Defined results: null text is empty; null source is the part ''. A null doc_id has no label, never fails E and makes no other
row fail it. Rows that repeat the smallest doc_id of a text all pass E (none of them is smaller). Several label rows of a document:
one with quality or toxic 1 is enough. Identical texts are those of equal SHA-256. No documents give no rows. Other columns are
left alone, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, table

FILTERS = "ABCDE"
MEASURES = ("removed", "good_lost", "toxic_lost")


def lehmer_rank(prefix: Sequence[int], n: int) -> int:
    """Rank of the first order of n filters that begins with ``prefix``, in lexicographic order."""
    left, rank = list(range(n)), 0
    for place, f in enumerate(prefix):
        rank += left.index(f) * factorial(n - 1 - place)
        left.remove(f)
    return rank


def interval_ends(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, 1 or -1): where the intervals of ranks begin and end in which a mask is removed at a step.

    Ends where one interval touches the next cancel out. A table fixed by n: 32 masks of five filters have some thousand ends.
    """
    out = []
    for mask in range(1, 2**n):
        fails = [f for f in range(n) if mask >> f & 1]
        passes = [f for f in range(n) if not mask >> f & 1]
        for step in range(1, len(passes) + 2):
            change: Counter[int] = Counter()
            for before in permutations(passes, step - 1):
                for f in fails:
                    first = lehmer_rank((*before, f), n)
                    change[first] += 1
                    change[first + factorial(n - step)] -= 1
            out += [(mask, step, rank, delta) for rank, delta in sorted(change.items()) if delta]
    return out


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step. cells: part, mask, n, good, toxic (counts of documents of each part and mask)."""
    n, orders = len(filters), factorial(len(filters))
    ends = cells.sparkSession.createDataFrame(pa.table({c: pa.array(v, pa.int32()) for c, v in zip(("mask", "step", "rank", "delta"), zip(*interval_ends(n)))}))
    totals = cells.groupBy("part").agg(
        F.sum("n").alias("__all"),
        F.array(*(F.sum(F.when(_fails(f), F.col("n")).otherwise(0)) for f in range(n))).alias("__fails"),
        F.array(*(F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)) for f in range(n))).alias("__only"),
        # among its filters each is first in an equal share of the orders
        F.array(*(F.sum(F.when(_fails(f), (F.col("n") * orders / F.bit_count("mask")).cast("long")).otherwise(0)) for f in range(n))).alias("__shapley"),
    )
    grid = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"))
    zeros = grid.select("part", "step", "rank", *(F.lit(0).cast("long").alias(m) for m in MEASURES))
    changes = cells.join(F.broadcast(ends), "mask").select("part", "step", "rank", *((F.col("delta") * F.col(c)).alias(m) for m, c in zip(MEASURES, ("n", "good", "toxic"))))
    changes = changes.where(F.col("rank") < orders)
    arrays = zeros.unionByName(changes).groupBy("part", "step", "rank").agg(*(F.sum(m).alias(m) for m in MEASURES))
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = arrays.select("part", "step", "rank", *(F.sum(m).over(along).alias(m) for m in MEASURES))
    names = F.array(*(F.lit("".join(filters[f] for f in p)) for p in permutations(range(n))))
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    gone = summed.withColumn("__gone", F.sum("removed").over(steps)).withColumn("filter_order", F.element_at(names, F.col("rank") + 1))
    which = F.expr(f"instr('{filters}', substring(filter_order, step, 1))")
    return gone.join(totals, "part").select(
        "part", "filter_order", "step",
        (F.col("__all") - F.col("__gone")).alias("kept"), "removed",
        (F.element_at("__fails", which) - F.col("removed")).alias("redundant"), F.element_at("__only", which).alias("unique_fails"),
        "good_lost", "toxic_lost", F.element_at("__shapley", which).alias("shapley"),
    )


def _fails(f: int) -> Column:
    return F.col("mask").bitwiseAND(1 << f) != 0


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    count = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [count < 50, 100 * F.size(F.array_distinct(words)) < 65 * count, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(bad, 1 << f).otherwise(0) for f, bad in enumerate(fails)), F.lit(0))


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: the counts that ``audit`` needs.

    The texts are read once; from then on a row is an id, a part, a mask and a digest. Copies meet in a minimum (combined before
    the shuffle) and only texts with more than one id are joined back.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("bits"))
    rows, _ = materialise(rows, "masks")
    known, unknown = rows.where("doc_id is not null"), rows.where("doc_id is null")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copied = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    late = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    marked = known.join(marks, "doc_id", "left").join(copied, "digest", "left").select("part", F.col("bits").bitwiseOR(late).alias("mask"), "good", "toxic")
    all_rows = marked.unionByName(unknown.select("part", F.col("bits").alias("mask"), F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic")))
    return all_rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = materialise(failure_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "cells")
    return audit(cells)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY part, a, b, c, d, e),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS k FROM o, range(1, 6) r(step)),
m AS (
  SELECT part, filter_order, step, k, n, good, toxic, bad[k] AS fails, len(list_filter(map_values(bad), lambda v: v)) = 1 AS alone,
    len(list_filter(range(1, step), lambda j: bad[filter_order[j]])) > 0 AS gone
  FROM cells, s),
r AS (
  SELECT part, filter_order, step, k, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed,
    sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (fails AND alone) AS unique_fails, sum(good) FILTER (fails AND NOT gone) AS good_lost,
    sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost
  FROM m GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM r
"""
