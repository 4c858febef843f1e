"""Nearest neighbours by inner product: inverted lists scanned with adaptive dimension pruning.

Vectors are scaled by the largest norm and get one more component that makes all norms equal, so that the largest inner
product is the smallest distance; then they are rotated by a fixed random orthogonal matrix. Coarse centroids are fitted
on a bounded sample (``SAMPLE`` different vectors of the smallest hash of their id); every vector is put into the list of
its nearest centroid. A query probes its nearest lists: as many as hold TARGET of the neighbours within the sample, and
more until they hold k other vectors. In a list the rotated vectors lie in column blocks. Over random directions the share
of a squared distance that lies in the first d of D columns follows a beta distribution; after each block a candidate is
abandoned when the hypothesis that it is within the query's bound is rejected at level ALPHA:
partial > bound * quantile(1 - ALPHA; beta(d / 2, (D - d) / 2)).
Of what is left after the last block, all whose distance is within rounding of the k-th smallest have their exact inner
product computed from the original vectors in double precision, so that ties go to the smaller id however many they are.
The first round scans the lists nearest to a query, until they hold START * (k + 1) vectors, and sets its bound; the
second scans as many as make an eighth of its lists against that bound, the third the others against the better one.

Lists that lie close together form a unit of about UNIT vectors, which is one task's work, so a query travels once for
many lists. A unit that holds more is cut by a hash of the id, and its queries into groups of QUERIES. Of equal vectors
only the k + 1 of the smallest ids can be among any query's k nearest, so only those are listed; equal queries are
searched once. Neither copies nor a hot list make a task grow.

Defined results: null ids, null or zero vectors, and vectors with null or non-finite components take no part; vectors of
different lengths have no inner product, so those of each length are searched among themselves; of rows that repeat an
id the smallest vector counts; fewer candidates than k are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, release, table

K = 20
SAMPLE, SEED = 20_000, 7
#: Dimensions in a column block, and the share of true neighbours that one test may reject.
COLUMNS, ALPHA = 16, 0.002
#: Share of true neighbours that the probed lists must hold, by which the number of probes is set on the sample.
TARGET, CALIBRATED = 0.96, 256
#: Vectors in a unit of lists, queries that meet it in one task, and queries computed at a time.
UNIT, QUERIES, TILE = 2_048, 4_096, 256
#: How many times k + 1 vectors the first round scans for each query.
START = 8
#: Share of pairs still alive below which partial distances are summed pair by pair rather than by whole matrices.
SPARSE = 0.1
#: More than rounding changes a whole squared distance (these are 4 at most).
TIE = 1e-9
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """id and v (array<double>) of the vectors that take part."""
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(value).isNotNull() & finite & F.exists(value, lambda x: x != 0))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(value).cast("array<double>").alias("v")).groupBy("id").agg(F.min("v").alias("v"))


class Coarse(NamedTuple):
    """The rotation, the largest norm, the centroids of the lists in rotated space, and how many lists a query probes."""

    rotation: np.ndarray
    norm: float
    centroids: np.ndarray
    probes: int = 1

    def vectors(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        return np.column_stack([x, rest]) @ self.rotation

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation

    def distances(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row, computed a few rows at a time."""
        return np.concatenate([self.distances(x[i : i + TILE]).argmin(axis=1) for i in range(0, len(x), TILE)] or [[]]).astype(np.int32)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of k clusters or fewer; those that nothing is nearest to are dropped."""
    centroids = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        nearest = ((centroids * centroids).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)
        sizes = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids = np.unique(sums[sizes > 0] / sizes[sizes > 0, None], axis=0)
    return centroids


def fit(rows: DataFrame, total: int, norm: float) -> Coarse:
    """Centroids from a bounded sample of different vectors, by a few rounds of k-means; about sqrt(total) lists."""
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    original = np.stack(drawn.to_numpy()).astype(float)
    d, rng = original.shape[1] + 1, np.random.default_rng(SEED)
    coarse = Coarse(np.linalg.qr(rng.standard_normal((d, d)))[0], norm, np.zeros((1, d)))
    x = coarse.vectors(original)
    coarse = coarse._replace(centroids=kmeans(x, int(max(1, min(len(x) // 8, round(np.sqrt(total))))), 8, rng))
    # As many probes as find the share of the sample's own neighbours that is asked for.
    asked = original[: min(CALIBRATED, len(x))]
    order = coarse.distances(coarse.queries(asked)).argsort(axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    near = (-asked @ original.T).argsort(axis=1)[:, : K + 1]
    needed = np.take_along_axis(place, coarse.nearest(x)[near], axis=1)
    return coarse._replace(probes=int(min(order.shape[1], 1 + np.quantile(needed, TARGET, method="higher"))))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


@lru_cache
def cuts_and_quantiles(d: int) -> list[tuple[int, int, float]]:
    """Column blocks of d columns, and the share of a whole squared distance that the columns so far may hold."""
    rng, ends = np.random.default_rng(SEED), [*range(COLUMNS, d, COLUMNS), d]
    share = lambda b: float(np.quantile(rng.beta(b / 2, (d - b) / 2, 200_000), 1 - ALPHA)) if b < d else 1.0
    return [(a, b, share(b)) for a, b in zip([0, *ends], ends)]


def distances_within(q: np.ndarray, x: np.ndarray, limit: np.ndarray, blocks: list[tuple[int, int, float]]) -> np.ndarray:
    """Squared distances (rows of q, rows of x); infinite where a test rejects that they are within ``limit`` (one of each row of q)."""
    partial, alive = np.zeros((len(q), len(x))), np.ones((len(q), len(x)), bool)
    for n, (a, b, share) in enumerate(blocks):
        if alive.mean() < SPARSE:
            i, j = np.nonzero(alive)
            rest = partial[i, j]
            for a, b, share in blocks[n:]:
                diff = q[i, a:b] - x[j, a:b]
                rest = rest + (diff * diff).sum(axis=1)
                keep = rest <= limit[i] * share
                i, j, rest = i[keep], j[keep], rest[keep]
            out = np.full(partial.shape, np.inf)
            out[i, j] = rest
            return out
        qc, xc = q[:, a:b], x[:, a:b]
        partial += (qc * qc).sum(axis=1)[:, None] + (xc * xc).sum(axis=1) - 2 * qc @ xc.T
        alive &= partial <= (limit * share)[:, None]
    partial[~alive] = np.inf
    return partial


def scan(queries: pd.DataFrame, block: pd.DataFrame, coarse: Coarse, k: int) -> pd.DataFrame:
    """The k best vectors of a unit for each query, by adaptive scanning.

    queries: id, v, bound (an inner product; null: none yet) and lists (absent: all); block: id, v and list (absent: one).
    """
    ids, original = block["id"].to_numpy(), _matrix(block["v"])
    x, asked, bound = coarse.vectors(original), _matrix(queries["v"]), queries["bound"].astype(float).to_numpy()
    rotated, blocks = coarse.queries(asked), cuts_and_quantiles(x.shape[1])
    # a bound is an inner product; in scaled space |x - q|^2 = 2 - 2 <x, q>
    limit = np.where(np.isnan(bound), np.inf, 2 - 2 * bound / (coarse.norm * np.linalg.norm(asked, axis=1)) + TIE)
    of = block["list"].to_numpy() if "list" in block else np.zeros(len(block), int)
    members = {n: np.flatnonzero(of == n) for n in np.unique(of)}
    probed = [set(np.asarray(p).tolist()) for p in queries["lists"]] if "lists" in queries else [set(members)] * len(queries)
    out = []
    for start in range(0, len(queries), TILE):
        tile = np.arange(start, min(start + TILE, len(queries)))
        found = np.full((len(tile), len(x)), np.inf)
        for n, rows in members.items():
            who = np.array([i for i, q in enumerate(tile) if n in probed[q]], int)
            if len(who):
                found[np.ix_(who, rows)] = distances_within(rotated[tile[who]], x[rows], limit[tile[who]], blocks)
        if len(x) > k:  # all that may be among the k best, ties of the last one included
            found[found > np.partition(found, k - 1, axis=1)[:, k - 1 : k] + TIE] = np.inf
        i, j = np.nonzero(np.isfinite(found))
        score = (original[j] * asked[tile[i]]).sum(axis=1)  # row by row, so that equal vectors tie exactly
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        out.append(pd.DataFrame({"query_id": queries["id"].to_numpy()[tile[i[keep]]], "id": ids[j[keep]], "score": score[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})


def search_one_length(rows: DataFrame, is_query: Column, k: int, kept: list[str]) -> DataFrame:
    """``search`` over rows (id, v) of one length. Paths of tables that can be released later are added to ``kept``."""

    def stored(df: DataFrame, name: str) -> DataFrame:
        out, path = materialise(df, name)
        kept.append(path)
        return out

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = stored(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1), "vectors")
    seen = few.where("copy = 1").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    coarse = fit(few.where("copy = 1"), seen["n"], seen["norm"])

    @F.pandas_udf("int")
    def nearest_list(v: pd.Series) -> pd.Series:
        return pd.Series(coarse.nearest(coarse.vectors(_matrix(v))))

    listed = stored(few.select("id", "v", nearest_list("v").alias("list")), "lists")
    # One number for each list: how many vectors it holds, by which lists are put together to units.
    n_lists, rng = len(coarse.centroids), np.random.default_rng(SEED)
    size = np.zeros(n_lists, np.int64)
    for r in listed.groupBy("list").count().collect():
        size[r["list"]] = r["count"]
    heads = kmeans(coarse.centroids, int(max(1, size.sum() // UNIT)), 5, rng)
    unit_of = coarse._replace(centroids=heads).nearest(coarse.centroids)
    parts = np.maximum(1, -(-np.bincount(unit_of, weights=size, minlength=len(heads)).astype(np.int64) // UNIT))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each query, round and unit, with the lists of that unit that the query probes."""
        for b in batches:
            for at in range(0, len(b), TILE):
                tile = b.iloc[at : at + TILE]
                order = np.argsort(coarse.distances(coarse.queries(_matrix(tile["v"]))), axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1)
                until = lambda n: np.minimum((held < n).sum(axis=1) + 1, n_lists)
                last = np.maximum(until(k + 1), min(coarse.probes, n_lists))
                one = np.minimum(until(START * (k + 1)), last)
                two = np.clip(last // 8, one, last)
                place = np.arange(n_lists)[None, :]
                turn = 1 + (place >= one[:, None]).astype(int) + (place >= two[:, None])
                q, p = np.nonzero(place < last[:, None])
                lists, turns = order[q, p], turn[q, p]
                units = unit_of[lists]
                by = np.lexsort((lists, units, turns, q))
                q, lists, turns, units = q[by], lists[by], turns[by], units[by]
                new = np.flatnonzero(np.r_[True, (np.diff(q) != 0) | (np.diff(turns) != 0) | (np.diff(units) != 0)])
                yield pd.DataFrame({"id": tile["id"].to_numpy()[q[new]], "v": tile["v"].to_numpy()[q[new]], "turn": turns[new], "unit": units[new], "lists": np.split(lists.astype(np.int32), new[1:])})

    asked = rows.where(is_query)
    heads_asked = stored(asked.groupBy("v").agg(F.min("id").alias("id")), "queries")
    routes = stored(heads_asked.select("id", "v").mapInPandas(routed, "id long, v array<double>, turn int, unit int, lists array<int>"), "routes")
    spark = rows.sparkSession
    unit_table = spark.createDataFrame([(int(u), int(p)) for u, p in enumerate(parts)], "unit int, parts int")
    list_table = spark.createDataFrame([(n, int(u), int(parts[u])) for n, u in enumerate(unit_of)], "list int, unit int, parts int")
    groups = routes.groupBy("turn", "unit").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    placed = listed.join(F.broadcast(list_table), "list").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))

    def one_round(turn: int, queries: DataFrame) -> DataFrame:
        crowd = F.broadcast(groups.where(F.col("turn") == turn).select("unit", "groups"))  # a row for each unit
        left = queries.join(F.broadcast(unit_table), "unit").join(crowd, "unit")
        left = left.withColumn("g", F.pmod(F.xxhash64("id"), "groups").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = placed.join(crowd, "unit").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

        def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return scan(a, b, coarse, k + 1) if len(a) and len(b) else pd.DataFrame({"query_id": [], "id": [], "score": []})

        key = ("unit", "part", "g")
        cogrouped = left.select(*key, "id", "v", "bound", "lists").groupBy(*key).cogroup(right.select(*key, "id", "v", "list").groupBy(*key))
        return cogrouped.applyInPandas(both, "query_id long, id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    sofar = None
    for turn in (1, 2, 3):
        queries = routes.where(F.col("turn") == turn)
        if sofar is None:
            found = one_round(turn, queries.withColumn("bound", F.lit(None).cast("double")))
        else:
            bounds = sofar.groupBy("query_id").agg(F.when(F.count("*") > k, F.min("score")).alias("bound"))
            found = sofar.unionByName(one_round(turn, queries.join(bounds, F.col("id") == F.col("query_id"), "left").drop("query_id")))
        sofar = stored(top(found).select("query_id", "id", "score", "rank"), "round").drop("rank") if turn < 3 else top(found)
    all_rounds = sofar.select("query_id", F.struct("rank", "id", "score").alias("hit"))
    hits = all_rounds.groupBy("query_id").agg(F.array_sort(F.collect_list("hit")).alias("hits"))  # k + 1 at most
    each = asked.join(heads_asked.select("v", F.col("id").alias("head")), "v").select("id", "head").join(hits, F.col("head") == F.col("query_id"))
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k)
    return each.select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "hit")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), "hit.score")


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest that each query finds (``is_query`` is over the column id)."""
    spark, kept = vectors.sparkSession, []
    rows, path = materialise(usable(vectors), "usable-vectors")
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    found = [search_one_length(rows.where(F.size("v") == n), is_query, k, kept) for n in lengths]
    if not found:
        return spark.createDataFrame([], RESULT)
    out, _ = materialise(reduce(DataFrame.unionByName, found), "neighbours")
    release(spark, path, *kept)
    return out


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
