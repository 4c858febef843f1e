"""Queries over retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import filters, lexical, questions as Q, retrieval as R
from corpusloom.plans.registry import Tables, query
from corpusloom.sources.scratch import scratch_path, signature, stored_once

TERMS = ("the", "and", "than", "heed", "tion")
ONE = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
TOK = "SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|[0-9]+[a-z]?')) AS t FROM documents"
BM25_CTE = f"""tok AS ({TOK}), tf AS (SELECT doc_id, t, count(*) AS f FROM tok GROUP BY ALL), dl AS (SELECT doc_id, sum(f) AS len FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS av FROM dl),
 dfq AS (SELECT t, count(*) AS df FROM tf WHERE t IN {TERMS} GROUP BY 1),
 bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / av))), 9) AS s FROM tf JOIN dfq USING (t) JOIN dl USING (doc_id), st GROUP BY 1)"""
VEC_CTE = f"vs AS (SELECT vec_id, label, list_inner_product(embedding::DOUBLE[], {ONE}::DOUBLE[]) AS s FROM embeddings)"


def _words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+|[0-9]+[a-z]?"), F.lit(0)).alias("words"))


def _bm25(t: Tables) -> DataFrame:
    return R.bm25(_words(t), "doc_id", {"words": 1.0}, TERMS)


def _index(t: Tables) -> DataFrame:
    """The stored index over documents: built once for the files as they are, and read from then on."""
    mark = signature(t.spark, f"{t.folder}/documents.parquet")
    path = stored_once(t.spark, "lexical", mark, lambda at: lexical.add_documents(_words(t), "doc_id", {"words": 1.0}, at))
    return lexical.open_index(t.spark, path)


def _indexed(t: Tables, k: int, blocks: DataFrame | None = None) -> DataFrame:
    """doc_id, score and rank of the k best documents for the fixed question, from the index."""
    asked = t.spark.range(1).select(F.col("id").alias("qid"), F.array(*map(F.lit, TERMS)).alias("terms"))
    return lexical.search(_index(t) if blocks is None else blocks, asked, k).select(F.col("key").alias("doc_id"), "score", "rank")


def _question(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 0").select("embedding").first()[0]]


@query("bm25_all", f"WITH {BM25_CTE} SELECT doc_id, round(s, 6) AS score FROM bm")
def bm25_all(t: Tables) -> DataFrame:
    return _bm25(t).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_topk", f"WITH {BM25_CTE} SELECT doc_id, round(s, 6) AS score FROM bm ORDER BY s DESC, doc_id LIMIT 30")
def bm25_topk(t: Tables) -> DataFrame:
    return _indexed(t, 30).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_segments", f"WITH {BM25_CTE} SELECT doc_id, round(s, 6) AS score FROM bm ORDER BY s DESC, doc_id LIMIT 30")
def bm25_segments(t: Tables) -> DataFrame:
    """An index of half the documents to which the other half was added: nothing of the first segment is written again."""
    path = scratch_path(t.spark, "lexical")
    for part in (0, 1):
        lexical.add_documents(_words(t).where(F.pmod(F.col("doc_id"), F.lit(2)) == part), "doc_id", {"words": 1.0}, path)
    return _indexed(t, 30, lexical.open_index(t.spark, path)).select("doc_id", F.round("score", 6).alias("score"))


ASKED = f"""tok AS ({TOK}), tf AS (SELECT doc_id, t, count(*) AS f FROM tok GROUP BY ALL), dl AS (SELECT doc_id, sum(f) AS len FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS av FROM dl),
 dfq AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), ask AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|[0-9]+[a-z]?')) AS t FROM benchmark),
 bq AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / av))), 9) AS s FROM ask JOIN tf USING (t) JOIN dfq USING (t) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def _asked(t: Tables) -> DataFrame:
    """Each item of benchmark as a question; its vector is that of the same id."""
    terms = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+|[0-9]+[a-z]?"), F.lit(0))
    return t.benchmark.select(F.col("item_id").alias("qid"), terms.alias("terms"))


@query("bm25_questions", f"WITH {ASKED} SELECT qid, doc_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rank FROM bq) WHERE rank <= 10")
def bm25_questions(t: Tables) -> DataFrame:
    """Ten documents for every item of benchmark, all items in one plan."""
    return lexical.search(_index(t), _asked(t), 10).select("qid", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("vec_topk_questions", """WITH s AS (SELECT q.vec_id AS qid, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
 SELECT qid, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def vec_topk_questions(t: Tables) -> DataFrame:
    """Stated queries: vectors whose id is divisible by 100, against all vectors, in blocks."""
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    found = Q.vector_topk(asked, t.embeddings.select(F.col("vec_id").alias("key"), "embedding"), 10)
    return found.select("qid", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("routed_search", f"""WITH {ASKED}, q AS (SELECT item_id AS qid, embedding AS qv, item_id % 3 > 0 AS merged FROM benchmark JOIN embeddings ON vec_id = item_id),
 cs AS (SELECT qid, merged, vec_id AS key, label, round(list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]), 9) AS s FROM q, embeddings),
 v AS (SELECT qid, key, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, key) AS r FROM cs WHERE label < 6 QUALIFY r <= 40),
 w AS (SELECT qid, doc_id AS key, s AS weight FROM bq WHERE qid IN (SELECT qid FROM q) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) <= 20),
 h AS (SELECT qid, (qid * 7 + i) % 50 AS key, -i::DOUBLE AS weight FROM q, range(0, 2) t(i)),
 wk AS (SELECT w.qid, w.key, weight, cs.s FROM w JOIN cs ON cs.qid = w.qid AND cs.key = w.key AND label < 6 LEFT JOIN v ON v.qid = w.qid AND v.key = w.key WHERE v.key IS NOT NULL OR cs.s >= 0.1),
 kn AS (SELECT qid, key, s FROM v UNION SELECT qid, key, s FROM wk),
 hk AS (SELECT h.qid, h.key, weight, cs.s FROM h JOIN cs ON cs.qid = h.qid AND cs.key = h.key AND label < 6 LEFT JOIN kn ON kn.qid = h.qid AND kn.key = h.key WHERE kn.key IS NOT NULL OR cs.s >= 0.1),
 lists AS (SELECT qid, key, r FROM v UNION ALL SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, key) FROM wk UNION ALL SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, key) FROM hk),
 f AS (SELECT qid, key, round(sum(1.0::DOUBLE / (60 + r)), 12) AS f FROM lists GROUP BY ALL),
 b AS (SELECT f.qid, f.key, cs.s, merged, row_number() OVER (PARTITION BY f.qid ORDER BY f DESC, cs.s DESC, f.key) AS base FROM f JOIN cs USING (qid, key) QUALIFY base <= 16),
 x AS (SELECT qid, key, s, merged, NULL AS base FROM cs WHERE merged AND label >= 6 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, key) <= 8),
 u AS (SELECT *, CASE WHEN base IS NOT NULL AND (NOT merged OR base <= 2) THEN base END AS p, s + CASE WHEN key IN (3, 8, 21) THEN 0.05 ELSE 0 END AS l FROM (SELECT * FROM b UNION ALL SELECT * FROM x))
 SELECT qid, key, CASE WHEN base IS NULL THEN 'more' ELSE 'core' END AS part, round(s, 6) AS relevance, s >= 0.3 AS passes, row_number() OVER (PARTITION BY qid ORDER BY p NULLS LAST, l DESC, key) AS rank FROM u QUALIFY rank <= 8""")
def routed_search(t: Tables) -> DataFrame:
    """Every item of benchmark that has a vector: words, vectors and hints fused, two thirds of the questions over both parts."""
    vectors = t.embeddings.select(F.col("vec_id").alias("key"), "embedding", F.when(F.col("label") < 6, "core").when(F.col("label") >= 6, "more").alias("part"))
    asked = _asked(t).join(vectors.select(F.col("key").alias("qid"), F.col("embedding").alias("vector")), "qid")
    asked = asked.withColumns({"branch": F.when(F.col("qid") % 3 > 0, "merged").otherwise("core"), "hint_ids": F.transform(F.array(F.lit(0), F.lit(1)), lambda i: (F.col("qid") * 7 + i) % 50)})
    options = R.SearchOptions(k=8, fetch_factor=5, lexical=20, threshold=0.3, word_floor=0.1, keep_top=2, priority_ids=(3, 8, 21))
    return Q.routed(asked, vectors, _index(t), options).select("qid", "key", "part", F.round("relevance", 6).alias("relevance"), "passes", "rank")


@query("bm25_weighted", f"""WITH words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|[0-9]+[a-z]?') AS w FROM documents),
 tok AS (SELECT doc_id, unnest(w) AS t, 1.0 AS x FROM words UNION ALL SELECT doc_id, unnest(w[1:8]), 3.0 FROM words), tf AS (SELECT doc_id, t, sum(x) AS f FROM tok GROUP BY ALL),
 dl AS (SELECT doc_id, sum(f) AS len FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS av FROM dl), dfq AS (SELECT t, count(*) AS df FROM tf WHERE t IN {TERMS} GROUP BY 1)
 SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / av)))::DOUBLE, 6) AS score FROM tf JOIN dfq USING (t) JOIN dl USING (doc_id), st GROUP BY 1""")
def bm25_weighted(t: Tables) -> DataFrame:
    words = _words(t).withColumn("head", F.slice("words", 1, 8))
    scored = R.bm25(words, "doc_id", {"words": 1.0, "head": 3.0}, TERMS)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@query("question_expansion", r"""SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(?:^|[^a-z0-9_])(?:section|sections|sec|sec\.|secs|secs\.|s\.|u/s|article|articles|art|art\.|arts|arts\.)\s*([0-9]+(?:-?[a-z]+)?)', 1), lambda x: regexp_full_match(x, '[0-9]{1,4}')), lambda x: 'sec' || x), ' ') AS refs FROM conversations""")
def question_expansion(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(F.filter(T.question_tokens(F.col("text")), lambda w: w.rlike("^sec[0-9]+$")), " ").alias("refs"))


@query("vec_topk", f"WITH {VEC_CTE} SELECT vec_id, round(s, 6) AS score FROM vs ORDER BY s DESC, vec_id LIMIT 30")
def vec_topk(t: Tables) -> DataFrame:
    return R.top(R.vector_scores(t.embeddings, _question(t)), 30, tie="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("vec_best_per_label", f"WITH {VEC_CTE} SELECT label, vec_id, round(s, 6) AS score FROM vs QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1")
def vec_best_per_label(t: Tables) -> DataFrame:
    return R.best_per(R.vector_scores(t.embeddings, _question(t)), "label", [F.desc("score"), F.asc("vec_id")]).select("label", "vec_id", F.round("score", 6).alias("score"))


@query("vec_floor", f"WITH {VEC_CTE} SELECT vec_id, round(s, 6) AS score FROM vs WHERE s >= 0.40")
def vec_floor(t: Tables) -> DataFrame:
    return R.vector_scores(t.embeddings, _question(t)).where("score >= 0.40").select("vec_id", F.round("score", 6).alias("score"))


@query("overfetch_filter", f"WITH {VEC_CTE} SELECT vec_id, round(s, 6) AS score FROM (SELECT * FROM vs ORDER BY s DESC, vec_id LIMIT 60) WHERE label <> 3 ORDER BY s DESC, vec_id LIMIT 20")
def overfetch_filter(t: Tables) -> DataFrame:
    scored = R.vector_scores(t.embeddings, _question(t))
    return filters.filter_after_limit(scored, F.col("label") != 3, 60, 20, [F.desc("score"), F.asc("vec_id")]).select("vec_id", F.round("score", 6).alias("score"))


RANKS = f"WITH {BM25_CTE}, {VEC_CTE}, w AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM bm ORDER BY r LIMIT 20), v AS (SELECT vec_id AS doc_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM vs ORDER BY r LIMIT 20)"


@query("rrf_fuse", f"{RANKS} SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS fused FROM (SELECT doc_id, r FROM w UNION ALL SELECT doc_id, r FROM v) GROUP BY 1")
def rrf_fuse(t: Tables) -> DataFrame:
    words = _indexed(t, 20).select("doc_id", "rank")
    vectors = R.ranked(R.top(R.vector_scores(t.embeddings, _question(t)), 20, tie="vec_id").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return R.fuse([words, vectors], "doc_id").select("doc_id", F.round("fused", 6).alias("fused"))


@query("hybrid_search", f"""{RANKS}, cos AS (SELECT vec_id AS doc_id, s AS cosine FROM vs), solo AS (SELECT w.doc_id, cosine FROM w JOIN cos USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM v) AND cosine >= 0.40),
 keep AS (SELECT doc_id, row_number() OVER (ORDER BY bm.s DESC, doc_id) AS r FROM w JOIN bm USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM v) OR doc_id IN (SELECT doc_id FROM solo)),
 fused AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS f FROM (SELECT doc_id, r FROM v UNION ALL SELECT doc_id, r FROM keep) GROUP BY 1), rel AS (SELECT doc_id, s AS rel FROM v UNION ALL SELECT doc_id, cosine FROM solo)
 SELECT doc_id, round(f, 6) AS fused, round(rel, 6) AS relevance FROM fused JOIN rel USING (doc_id) ORDER BY f DESC, rel DESC, doc_id LIMIT 5""")
def hybrid_search(t: Tables) -> DataFrame:
    """Vectors are linked to documents by equal ids, as the tables hold no other link."""
    scored = R.vector_scores(t.embeddings, _question(t)).select(F.col("vec_id").alias("doc_id"), "score")
    found = R.hybrid(R.top(scored, 20), _indexed(t, 20).select("doc_id", "score"), scored.withColumnRenamed("score", "cosine"), "doc_id")
    return found.select("doc_id", F.round("fused", 6).alias("fused"), F.round("relevance", 6).alias("relevance"))


@query("core_keep_merge", f"""WITH {VEC_CTE}, b AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM vs WHERE label < 5 ORDER BY r LIMIT 15), x AS (SELECT vec_id, s FROM vs WHERE label >= 3 ORDER BY s DESC, vec_id LIMIT 15),
 u AS (SELECT vec_id, s, r FROM b UNION ALL SELECT vec_id, s, NULL FROM x WHERE vec_id NOT IN (SELECT vec_id FROM b))
 SELECT vec_id, round(s, 6) AS score FROM (SELECT *, CASE WHEN r <= 3 THEN r END AS p, s + CASE WHEN vec_id % 2 = 0 THEN 0.05 ELSE 0 END AS boosted FROM u) ORDER BY p NULLS LAST, boosted DESC, vec_id LIMIT 10""")
def core_keep_merge(t: Tables) -> DataFrame:
    scored = R.vector_scores(t.embeddings, _question(t))
    base = R.top(scored.where("label < 5"), 15, tie="vec_id")
    base = base.join(R.ranked(base, "vec_id"), "vec_id").select("vec_id", "score", "rank")
    extra = R.top(scored.where("label >= 3"), 15, tie="vec_id").select("vec_id", "score")
    return R.pinned_merge(base, extra, "vec_id", 3, 0.05, F.col("vec_id") % 2 == 0, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("exact_then_semantic", f"{RANKS} SELECT doc_id, part FROM (SELECT doc_id, 0 AS part, r FROM w WHERE r <= 2 UNION ALL SELECT doc_id, 1, r FROM v WHERE doc_id NOT IN (SELECT doc_id FROM w WHERE r <= 2)) ORDER BY part, r LIMIT 6")
def exact_then_semantic(t: Tables) -> DataFrame:
    exact = _indexed(t, 2).select("doc_id", "rank")
    semantic = R.ranked(R.top(R.vector_scores(t.embeddings, _question(t)), 20, tie="vec_id").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return R.exact_then_semantic(exact, semantic, "doc_id", 6).select("doc_id", "part")


@query("vector_cosine_pairs", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_cosine_pairs(t: Tables) -> DataFrame:
    a, b = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), t.embeddings.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(R.dot(F.col("x"), F.col("y")), 5).alias("cosine"))


@query("filter_permissive", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality = 1, true) AND coalesce(contains(lower(d.source), 'src1'), true)")
def filter_permissive(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.where(filters.permissive(F.col("quality") == 1) & filters.permissive(F.contains(F.lower("source"), F.lit("src1")))).select("doc_id", "quality")


@query("filter_strict", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality = 1, false) AND coalesce(lower(d.lang) = 'en', false)")
def filter_strict(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.where(filters.strict(F.col("quality") == 1) & filters.strict(F.lower("lang") == "en")).select("doc_id", "quality")


@query("strict_pool", f"WITH {VEC_CTE} SELECT vec_id, label FROM (SELECT * FROM vs ORDER BY s DESC, vec_id LIMIT 50) WHERE label = 1 ORDER BY s DESC, vec_id LIMIT 5")
def strict_pool(t: Tables) -> DataFrame:
    scored = R.vector_scores(t.embeddings, _question(t))
    return filters.filter_after_limit(scored, filters.strict(F.col("label") == 1), min(50, 10 * 5), 5, [F.desc("score"), F.asc("vec_id")]).select("vec_id", "label")


@query("catalog_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 'e') AND lower(p_brand) = lower('Brand#13') AND p_size BETWEEN 5 AND 40")
def catalog_filter(t: Tables) -> DataFrame:
    return t.part.where(filters.all_words_in(F.col("p_name"), ["a", "E"]) & (F.lower("p_brand") == "brand#13") & filters.year_between(F.col("p_size"), 5, 40)).select("p_partkey", "p_name")


@query("passage_window", r"""SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text ELSE CASE WHEN 100 + 1200 < length(text) THEN regexp_replace(regexp_replace(substr(text, 101, 1200), '^[^ \t\n\r]*[ \t\n\r]+', ''), '[ \t\n\r]+[^ \t\n\r]*\z', '')
 ELSE regexp_replace(substr(text, 101, 1200), '^[^ \t\n\r]*[ \t\n\r]+', '') END END AS passage FROM documents""")
def passage_window(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", R.passage_window(F.col("text"), F.lit(700)).alias("passage"))


@query("confidence_flags", "SELECT label, max(s) >= 0.70 AS confident FROM (SELECT label, list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS s FROM embeddings) GROUP BY 1")
def confidence_flags(t: Tables) -> DataFrame:
    return R.vector_scores(t.embeddings, _question(t)).groupBy("label").agg(F.coalesce(F.max("score") >= 0.70, F.lit(False)).alias("confident"))


@query("numbered_sources", """SELECT conv_id, string_agg('[' || (turn + 1) || '] Source: ' || role || chr(10) || left(text, 40), chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1""")
def numbered_sources(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("rank", F.col("turn") + 1)
    return R.numbered_sources(rows, "conv_id", "rank", F.col("role"), F.left("text", F.lit(40)))


@query("judgment_search", f"""WITH {VEC_CTE}, a AS (SELECT label, vec_id, s, 0 AS ix FROM vs WHERE vec_id % 2 = 0 ORDER BY s DESC, vec_id LIMIT 100), b AS (SELECT label, vec_id, s, 1 AS ix FROM vs WHERE vec_id % 2 = 1 ORDER BY s DESC, vec_id LIMIT 100),
 best AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY label ORDER BY ix, s DESC, vec_id) = 1) SELECT label, vec_id, round(s, 6) AS score FROM best ORDER BY s DESC, label LIMIT 5""")
def judgment_search(t: Tables) -> DataFrame:
    """Best paragraph (vector) of each judgment (label); one that the first index holds isn't replaced by the second."""
    scored = R.vector_scores(t.embeddings, _question(t))
    both = R.top(scored.where("vec_id % 2 = 0"), 100, tie="vec_id").withColumn("ix", F.lit(0)).unionByName(R.top(scored.where("vec_id % 2 = 1"), 100, tie="vec_id").withColumn("ix", F.lit(1)))
    best = R.best_per(both, "label", [F.asc("ix"), F.desc("score"), F.asc("vec_id")])
    return best.orderBy(F.desc("score"), F.asc("label")).limit(5).select("label", "vec_id", F.round("score", 6).alias("score"))
