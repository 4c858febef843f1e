"""Retrieval: BM25, exact vector search, rank fusion, merges and gates, as lazy DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


@dataclass(frozen=True)
class SearchOptions:
    """Switches and limits of a search; the defaults are the full behaviour."""

    k: int = 5
    fetch_factor: int = 30
    lexical: int = 20
    threshold: float = 0.65
    word_floor: float = 0.40
    rrf_k: int = 60
    keep_top: int = 3
    priority: float = 0.05
    hybrid: bool = True
    hints: bool = True
    priority_ids: tuple[int, ...] = field(default=())


def bm25(docs: DataFrame, key: str, fields: dict[str, float], terms: Sequence[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """key and score of the documents that have one of a question's terms. fields: columns of token arrays, and their weights.

    The few terms of a question are counted in each document's own arrays, so no posting is made or shuffled; numbers of
    documents and their mean length are one aggregate, which is one row.
    """
    asked = sorted(set(terms))
    wanted = [F.filter(c, lambda w: w.isin(asked)).alias(f"__hits{n}") for n, c in enumerate(fields)]
    length = reduce(lambda x, y: x + y, (F.greatest(F.size(c), F.lit(0)) * float(w) for c, w in fields.items()))
    found = docs.select(key, length.alias("__len"), *wanted)

    def frequency(term: str) -> Column:
        each = (F.coalesce(F.size(F.filter(f"__hits{n}", lambda w: w == term)), F.lit(0)) * float(w) for n, w in enumerate(fields.values()))
        return reduce(lambda x, y: x + y, each)

    counted = found.select(key, "__len", *(frequency(t).alias(f"__f{i}") for i, t in enumerate(asked)))
    some = F.col("__len") > 0
    stats = counted.agg(F.count_if(some).alias("__n"), F.avg(F.when(some, F.col("__len"))).alias("__mean"), *(F.count_if(F.col(f"__f{i}") > 0).alias(f"__df{i}") for i in range(len(asked))))

    def weight(i: int) -> Column:
        f, df, n = F.col(f"__f{i}"), F.col(f"__df{i}"), F.col("__n")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        return F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("__len") / F.col("__mean")))).otherwise(0.0)

    hit = reduce(lambda x, y: x | y, (F.col(f"__f{i}") > 0 for i in range(len(asked))), F.lit(False))
    total = reduce(lambda x, y: x + y, map(weight, range(len(asked))), F.lit(0.0))
    scored = counted.where(hit).crossJoin(F.broadcast(stats))  # stats is one row
    return scored.select(key, F.round(total, 9).alias("score"))  # equal scores tie, whatever the order of addition


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_scores(vectors: DataFrame, question: list[float], value: str = "embedding") -> DataFrame:
    """``vectors`` with score, the inner product with one question vector."""
    return vectors.withColumn("score", dot(F.col(value), F.array(*(F.lit(float(x)) for x in question))))


def top(rows: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    return rows.orderBy(F.desc(score), F.asc(tie)).limit(k)


def best_per(rows: DataFrame, key: str | list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def ranked(rows: DataFrame, key: str, score: str = "score") -> DataFrame:
    """key and rank from 1 of a bounded ranking (limit it first: the rank of a whole is one task's work)."""
    return rows.select(key, F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))).alias("rank"))


def fuse(rankings: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of tables with key and rank: sum of 1 / (k + rank)."""
    out = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        out = out.unionByName(r.select(key, "rank"))
    return out.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"))


def pinned_merge(base: DataFrame, extra: DataFrame, key: str, keep: int, bonus: float, favoured: Column, k: int) -> DataFrame:
    """The first ``keep`` of base stay in place; the rest and extra follow by score, favoured rows with a bonus; no key twice."""
    head = base.select(key, "score", F.col("rank").alias("base_rank"))
    new = extra.join(base.select(key), key, "left_anti").select(key, "score", F.lit(None).cast("int").alias("base_rank"))
    pinned = F.when(F.col("base_rank") <= keep, F.col("base_rank"))
    boosted = F.col("score") + F.when(favoured, bonus).otherwise(0.0)
    return head.unionByName(new).withColumns({"pinned": pinned, "boosted": boosted}).orderBy(F.asc_nulls_last("pinned"), F.desc("boosted"), F.asc(key)).limit(k)


def exact_then_semantic(exact: DataFrame, semantic: DataFrame, key: str, k: int) -> DataFrame:
    """Exact hits in their order, then the semantic ones that aren't among them, k in all (columns key, rank)."""
    rest = semantic.join(exact.select(key), key, "left_anti")
    both = exact.select(key, F.lit(0).alias("part"), "rank").unionByName(rest.select(key, F.lit(1).alias("part"), "rank"))
    return both.orderBy("part", "rank", key).limit(k)


def hybrid(vector_hits: DataFrame, word_hits: DataFrame, cosine: DataFrame, key: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Fused ranking of bounded vector and word hits; a hit by words alone needs a cosine of ``word_floor``.

    vector_hits and word_hits: key and score, already limited. cosine: key and cosine, for the word hits.
    """
    v = ranked(vector_hits, key)
    only_words = word_hits.join(vector_hits.select(key), key, "left_anti").join(cosine, key).where(F.col("cosine") >= options.word_floor).select(key)
    kept = word_hits.join(vector_hits.select(key).unionByName(only_words), key, "left_semi")
    relevance = vector_hits.select(key, F.col("score").alias("relevance")).unionByName(only_words.join(cosine, key).select(key, F.col("cosine").alias("relevance")))
    return fuse([v, ranked(kept, key)], key, options.rrf_k).join(relevance, key).orderBy(F.desc("fused"), F.desc("relevance"), F.asc(key)).limit(options.k)


def hint_terms(words: Column, hints: DataFrame) -> DataFrame:
    """Hints whose triggers all occur in one of their sets, none of whose "unless" words does (columns id, triggers, unless, terms)."""
    fires = F.exists("triggers", lambda t: F.forall(t, lambda w: F.array_contains(words, w)))
    return hints.where(fires & ~F.exists("unless", lambda w: F.array_contains(words, w)))


def confidence(scores: Column, level: float = 0.70) -> Column:
    """Whether the best of a list of relevances reaches a level (null list: false)."""
    return F.coalesce(F.array_max(scores) >= level, F.lit(False))


def passage_window(text: Column, at: Column, size: int = 1200) -> Column:
    """The whole text where it is short; else ``size`` characters around a place, cut at spaces."""
    low = F.greatest(F.lit(0), at - size // 2)
    piece = F.substring(text, low + 1, F.lit(size))
    cut_front = F.when(low > 0, F.regexp_replace(piece, r"^\S*\s+", "")).otherwise(piece)
    cut_back = F.when(low + size < F.length(text), F.regexp_replace(cut_front, r"\s+\S*\z", "")).otherwise(cut_front)
    return F.when(F.length(text) <= size, text).otherwise(cut_back)


def numbered_sources(hits: DataFrame, group: str, rank: str, name: Column, body: Column) -> DataFrame:
    """One text for each group: "[i] Source: name" blocks in rank order (groups are the few hits of one answer)."""
    block = F.struct(F.col(rank).alias("i"), F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] Source: "), name, F.lit("\n"), body).alias("b"))
    return hits.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("context"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word sets."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def greedy_distinct(items: Column, same: float = 0.85) -> Column:
    """Of an array of structs with ``words``, in order, those not like an earlier kept one."""
    return F.aggregate(items, F.filter(items, lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda y: F.coalesce(jaccard(y["words"], x["words"]), F.lit(0.0)) >= same), kept).otherwise(F.concat(kept, F.array(x))))
