"""Connected components of a link table, as repeated contraction with DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``links`` (columns a and b of one type).

    In each round every node moves to the smallest node next to it (itself included), the moves are followed to their
    end, and the links are contracted; links inside a component vanish. Rounds grow with the logarithm of the longest
    chain. Only counts come to the driver; all sums and minima are combined before the shuffle, so a node with very
    many links is no hot spot. Null ends and loops are left out; no links give no rows.
    """
    spark = links.sparkSession
    clean = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, edge_path = materialise(clean, "edges")
    roots, root_path = None, None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent, path = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        moved = True
        while moved:  # follow the moves: up becomes the up of up
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            step, step_path = materialise(parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("top"), "up"), "parents")
            moved = not step.where("top <> up").isEmpty()
            release(spark, path)
            parent, path = step.select("node", F.col("top").alias("up")), step_path
        if roots is None:
            new = parent.select("node", F.col("up").alias("root"))
        else:
            new = roots.join(parent.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        next_roots, next_root_path = materialise(new, "roots")
        one = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        two = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        pairs = edges.join(one, "a").join(two, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        next_edges, next_edge_path = materialise(pairs, "edges")
        release(spark, edge_path, path, *([root_path] if root_path else []))
        edges, edge_path, roots, root_path = next_edges, next_edge_path, next_roots, next_root_path
    release(spark, edge_path)
    if roots is None:
        return clean.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return roots
