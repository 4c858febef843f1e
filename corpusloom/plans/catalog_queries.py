"""Queries over joins, aggregations, facets, sets and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import catalog as C, evaluate as E, filters, joins as J
from corpusloom.plans.registry import Tables, query


@query("facet_counts", "SELECT 'lang' AS facet, coalesce(lang, 'None') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'None'), count(*) FROM documents GROUP BY 2")
def facet_counts(t: Tables) -> DataFrame:
    return C.facets(t.documents, ["lang", "source"])


@query("facet_null_bucket", "SELECT coalesce(CAST(l.toxic AS VARCHAR), 'None') AS value, count(*) AS n FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def facet_null_bucket(t: Tables) -> DataFrame:
    return C.facet(t.documents.join(t.labels, "doc_id", "left"), "toxic")


@query("facet_cube", "SELECT p_brand, p_size, grouping(p_brand)::INT AS g1, grouping(p_size)::INT AS g2, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size) HAVING count(*) > 1")
def facet_cube(t: Tables) -> DataFrame:
    return t.part.cube("p_brand", "p_size").agg(F.grouping("p_brand").cast("int").alias("g1"), F.grouping("p_size").cast("int").alias("g2"), F.count("*").alias("n")).where("n > 1")


@query("facet_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def facet_rollup(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("facet_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def facet_grouping_sets(t: Tables) -> DataFrame:
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("court_statistics", "SELECT c_mktsegment, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def court_statistics(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.countDistinct("o_custkey").alias("customers"))


@query("coverage", "SELECT n_name, count(*) AS listed, count(o.k) AS held, count(*) - count(o.k) AS missing FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey GROUP BY 1")
def coverage(t: Tables) -> DataFrame:
    listed = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "c_custkey")
    return C.coverage(listed, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n_name")


@query("inventory", "SELECT field, filled, round(filled / total, 6) AS share FROM (SELECT unnest(['text', 'quality', 'toxic']) AS field, unnest([count(text), count(quality), count(toxic)]) AS filled, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id))")
def inventory(t: Tables) -> DataFrame:
    return C.fill_rates(t.documents.join(t.labels, "doc_id", "left"), ["text", "quality", "toxic"])


@query("duplicate_surplus", r"SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM documents GROUP BY trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) HAVING count(*) > 1)")
def duplicate_surplus(t: Tables) -> DataFrame:
    return C.duplicate_surplus(t.documents, T.content_hash(F.col("text")))


@query("run_summary", "SELECT user_id % 7 AS source, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS click, max(ts) AS last_at FROM events GROUP BY 1")
def run_summary(t: Tables) -> DataFrame:
    return C.outcome_summary(t.events.withColumn("source", F.col("user_id") % 7), "source", "event_type", ["view", "error", "click"], "ts")


@query("run_pivot", "SELECT source, view, error FROM (PIVOT (SELECT user_id % 7 AS source, event_type FROM events WHERE event_type IN ('view', 'error')) ON event_type IN ('view', 'error') USING count(*) GROUP BY source)")
def run_pivot(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 7).alias("source")).pivot("event_type", ["view", "error"]).agg(F.count(F.lit(1))).select("source", F.coalesce("view", F.lit(0)).alias("view"), F.coalesce("error", F.lit(0)).alias("error"))


@query("reason_counts", "SELECT split_part(p_type, ' ', 1) AS reason, count(*) AS n FROM part GROUP BY 1")
def reason_counts(t: Tables) -> DataFrame:
    return t.part.groupBy(F.substring_index("p_type", " ", 1).alias("reason")).agg(F.count("*").alias("n"))


@query("distinct_prefixes", "SELECT p_brand, count(DISTINCT regexp_replace(p_name, ' [^ ]*$', '')) AS laws FROM part GROUP BY 1")
def distinct_prefixes(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.countDistinct(F.regexp_replace("p_name", " [^ ]*$", "")).alias("laws"))


@query("dashboard", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'F') AS closed, array_to_string((array_agg(o_orderkey ORDER BY o_orderdate, o_orderkey) FILTER (o_orderdate >= TIMESTAMP '1997-01-01'))[1:5], ',') AS next_five FROM orders")
def dashboard(t: Tables) -> DataFrame:
    upcoming = t.orders.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).orderBy("o_orderdate", "o_orderkey").limit(5)
    five = upcoming.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("next_five"))
    return t.orders.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("active"), F.count_if(F.col("o_orderstatus") == "F").alias("closed")).crossJoin(F.broadcast(five))


@query("vocabulary", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1 HAVING count(*) >= 10")
def vocabulary(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 10")


@query("assembled_text", "SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS text_sha FROM conversations GROUP BY 1")
def assembled_text(t: Tables) -> DataFrame:
    return C.assembled_text(t.conversations, "conv_id", "turn", F.concat(F.col("role"), F.lit(": "), F.col("text"))).select("conv_id", F.sha2("text", 256).alias("text_sha"))


@query("entity_merge", "SELECT user_id, event_type, count(*) AS n, max(value) AS best, min(event_id) AS first_id, min_by(props, event_id) AS surface FROM events GROUP BY ALL")
def entity_merge(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("best"), F.min("event_id").alias("first_id"), F.min_by("props", "event_id").alias("surface"))


@query("best_copy", "SELECT doc_id, source, copies FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY md5(text)) AS copies, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, lang, doc_id) AS r FROM documents) WHERE r = 1")
def best_copy(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("k", F.md5("text"))
    return C.best_copy(rows, ["k"], [F.desc("n_chars"), F.asc("lang"), F.asc("doc_id")]).select("doc_id", "source", "copies")


@query("first_letters", "SELECT coalesce(nullif(left(regexp_replace(upper(trim(p_name)), '^THE ', ''), 1), ''), '?') AS letter, count(*) AS n FROM part GROUP BY 1")
def first_letters(t: Tables) -> DataFrame:
    letter = F.left(F.regexp_replace(F.upper(F.trim("p_name")), "^THE ", ""), F.lit(1))
    return t.part.groupBy(F.coalesce(F.nullif(letter, F.lit("")), F.lit("?")).alias("letter")).agg(F.count("*").alias("n"))


@query("duplicate_titles", "SELECT p_partkey, same FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_size) AS same FROM part) WHERE same > 1")
def duplicate_titles(t: Tables) -> DataFrame:
    return t.part.withColumn("same", F.count("*").over(Window.partitionBy("p_brand", "p_size"))).where("same > 1").select("p_partkey", "same")


@query("index_health", "SELECT label, count(*) AS chunks, count(DISTINCT vec_id) AS documents FROM embeddings GROUP BY 1")
def index_health(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.count("*").alias("chunks"), F.countDistinct("vec_id").alias("documents"))


@query("metadata_fill", "SELECT d.doc_id, coalesce(CASE WHEN d.lang = 'en' THEN 1 END, l.quality) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_fill(t: Tables) -> DataFrame:
    hits = t.documents.select("doc_id", F.when(F.col("lang") == "en", 1).alias("quality"))
    return J.filled(hits, t.labels, "doc_id", ["quality"])


@query("precedence", "SELECT doc_id, coalesce(quality, CASE WHEN lang = 'de' THEN 7 END) AS value, CASE WHEN quality IS NOT NULL THEN 'listing' WHEN lang = 'de' THEN 'override' END AS value_source FROM documents LEFT JOIN labels USING (doc_id)")
def precedence(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    return C.precedence(rows, [("listing", F.col("quality")), ("override", F.when(F.col("lang") == "de", 7))]).select("doc_id", "value", "value_source")


@query("name_lookup", "SELECT o_orderkey, coalesce(c_name, 'Unknown') AS name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def name_lookup(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_name", F.lit("Unknown")).alias("name"), "n_name")


@query("inner_join_sorted", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7")
def inner_join_sorted(t: Tables) -> DataFrame:
    mine = t.orders.where("o_custkey = 7")
    return t.lineitem.join(mine, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("visible_rows", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def visible_rows(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("assignee_id"), F.lit(None).cast("bigint").alias("owner_id"))
    shared = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("user_id"))
    return filters.visible_rows(rows, "lawyer", 7, shared).select(F.col("id").alias("o_orderkey"))


@query("held_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def held_anti_join(t: Tables) -> DataFrame:
    return J.without_held(t.customer, t.orders, F.col("c_custkey"), F.col("o_custkey")).select("c_custkey")


@query("title_key_anti_join", "SELECT doc_id FROM documents WHERE regexp_replace(lower(coalesce(text, '')), '[^0-9a-z]', '', 'g') NOT IN (SELECT regexp_replace(lower(text), '[^0-9a-z]', '', 'g') FROM benchmark)")
def title_key_anti_join(t: Tables) -> DataFrame:
    return J.without_held(t.documents, t.benchmark, T.squash(F.col("text")), T.squash(F.col("text"))).select("doc_id")


@query("missing_vectors", "SELECT count(*) AS missing FROM (SELECT DISTINCT sha256('m' || chr(10) || text) AS k FROM documents WHERE text IS NOT NULL EXCEPT SELECT sha256('m' || chr(10) || text) FROM documents WHERE doc_id % 3 = 0)")
def missing_vectors(t: Tables) -> DataFrame:
    key = F.sha2(F.concat(F.lit("m\n"), F.col("text")), 256)
    cached = t.documents.where("doc_id % 3 = 0").select(key.alias("k"))
    return t.documents.where("text is not null").select(key.alias("k")).distinct().join(cached, "k", "left_anti").agg(F.count("*").alias("missing"))


@query("word_pairs", "SELECT conv_id, count(*) AS pairs, count(DISTINCT a || ' ' || b) AS kinds FROM (SELECT conv_id, turn, unnest(w[1:len(w)-1]) AS a, unnest(w[2:]) AS b FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations) WHERE len(w) > 1) GROUP BY 1")
def word_pairs(t: Tables) -> DataFrame:
    words = t.conversations.select("conv_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    return J.bigrams(words, "conv_id", F.col("w")).groupBy("conv_id").agg(F.count("*").alias("pairs"), F.countDistinct(F.concat_ws(" ", "word", "following")).alias("kinds"))


@query("statute_status", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.o_custkey IS NULL THEN 'not_checked' WHEN s.k IS NOT NULL THEN 'verified' WHEN c.c_custkey IS NOT NULL THEN 'law_held' ELSE 'not_found' END AS status FROM (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS o_custkey, o_orderstatus FROM orders) o LEFT JOIN (SELECT DISTINCT o_custkey AS k, o_orderstatus AS st FROM orders WHERE o_orderkey % 5 > 0 AND o_totalprice > 200000) s ON s.k = o.o_custkey AND s.st = o.o_orderstatus LEFT JOIN customer c ON c.c_custkey = o.o_custkey) GROUP BY 1")
def statute_status(t: Tables) -> DataFrame:
    named = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("law")
    refs = t.orders.select(named, F.col("o_orderstatus").alias("number"))
    sections = t.orders.where("o_orderkey % 5 > 0 and o_totalprice > 200000").select(F.col("o_custkey").alias("law"), F.col("o_orderstatus").alias("number"))
    return J.reference_status(refs, sections, t.customer.select(F.col("c_custkey").alias("law"))).groupBy("status").agg(F.count("*").alias("n"))


@query("shingle_containment", """WITH s AS (SELECT item_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS q FROM benchmark), c AS (SELECT item_id, q AS chunk FROM s),
 a AS (SELECT DISTINCT item_id, substr(chunk, i, 30) AS h FROM c, (SELECT unnest(range(1, 3000, 10)) AS i) WHERE i <= greatest(1, length(chunk) - 29)), n AS (SELECT item_id, count(*) AS of FROM a GROUP BY 1),
 d AS (SELECT doc_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS q FROM documents)
 SELECT item_id AS chunk_id, doc_id AS section_id, k AS n FROM (SELECT a.item_id, d.doc_id, count(*) AS k, any_value(n.of) AS of FROM a JOIN n USING (item_id) JOIN d ON contains(d.q, a.h) GROUP BY ALL) WHERE k >= of * 0.3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC, doc_id) = 1""")
def shingle_containment(t: Tables) -> DataFrame:
    chunks = t.benchmark.select(F.lit(1).alias("law"), F.col("item_id").alias("chunk_id"), T.squash(F.col("text")).alias("text"))
    sections = t.documents.select(F.lit(1).alias("law"), F.col("doc_id").alias("section_id"), T.squash(F.col("text")).alias("text"))
    return J.shingle_containment(chunks, sections, "law").select("chunk_id", "section_id", "n")


@query("union_of_sets", "SELECT 'core' AS set, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 'corpus', count(*) FROM documents WHERE lang = 'de' UNION ALL SELECT 'scraped', count(*) FROM pages")
def union_of_sets(t: Tables) -> DataFrame:
    core = t.documents.where("lang = 'en'").select(F.lit("core").alias("set"), "doc_id")
    other = t.documents.where("lang = 'de'").select(F.lit("corpus").alias("set"), "doc_id")
    return core.unionByName(other).unionByName(t.pages.select(F.lit("scraped").alias("set"), "page_id"), allowMissingColumns=True).groupBy("set").agg(F.count("*").alias("n"))


@query("union_distinct", "SELECT source AS choice FROM documents UNION SELECT event_type FROM events")
def union_distinct(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("choice")).union(t.events.select("event_type")).distinct()


@query("expected_minus_found", "SELECT o_custkey, array_to_string(list_sort(list_filter(range(1, 8), lambda x: NOT list_contains(f, x))), ',') AS missing FROM (SELECT o_custkey, array_agg(DISTINCT o_orderkey % 7 + 1) AS f FROM orders GROUP BY 1)")
def expected_minus_found(t: Tables) -> DataFrame:
    found = t.orders.groupBy("o_custkey").agg(F.collect_set((F.col("o_orderkey") % 7 + 1).cast("int")).alias("f"))
    return found.select("o_custkey", F.array_join(F.array_sort(F.array_except(F.sequence(F.lit(1), F.lit(7)), "f")), ",").alias("missing"))


@query("set_intersection", "SELECT o_custkey, len(list_intersect(a, b)) > 0 AS overlap, len(list_intersect(a, b)) AS n FROM (SELECT o_custkey, coalesce(array_agg(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O'), []) AS a, coalesce(array_agg(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F'), []) AS b FROM orders GROUP BY 1)")
def set_intersection(t: Tables) -> DataFrame:
    sets = t.orders.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("b"))
    return sets.select("o_custkey", F.arrays_overlap("a", "b").alias("overlap"), F.size(F.array_intersect("a", "b")).cast("long").alias("n"))


@query("set_operations", "(SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_operations(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select("o_custkey")).subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


RESULTS = "r AS (SELECT event_type AS q, user_id AS item, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INT) AS rank FROM events), g AS (SELECT DISTINCT event_type AS q, user_id AS item FROM events WHERE user_id % 11 = 3), h AS (SELECT q, min(rank) AS rank FROM r JOIN g USING (q, item) GROUP BY 1)"


def _ranks(t: Tables, order: str = "value", rest: int = 3) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc(order), "event_id")
    results = t.events.select(F.col("event_type").alias("q"), F.col("user_id").alias("item"), F.row_number().over(w).alias("rank"))
    gold = t.events.where(F.col("user_id") % 11 == rest).select(F.col("event_type").alias("q"), F.col("user_id").alias("item"))
    return E.first_hits(results, gold, "q", "item")


@query("hit_at_k", f"WITH {RESULTS} SELECT k, count(*) FILTER (rank <= k) AS hits, count(*) AS questions FROM (SELECT DISTINCT g.q, h.rank FROM g LEFT JOIN h USING (q)), (SELECT unnest([1, 5, 20]) AS k) GROUP BY 1")
def hit_at_k(t: Tables) -> DataFrame:
    return E.hit_rates(_ranks(t), [1, 5, 20])


@query("runs_compared", f"WITH {RESULTS}, r2 AS (SELECT event_type AS q, user_id AS item, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS INT) AS rank FROM events), h2 AS (SELECT q, min(rank) AS rank FROM r2 JOIN g USING (q, item) GROUP BY 1) SELECT q, h.rank AS rank_before, h2.rank AS rank_after, CASE WHEN coalesce(h2.rank, 99) < coalesce(h.rank, 99) THEN 'better' WHEN coalesce(h2.rank, 99) > coalesce(h.rank, 99) THEN 'worse' ELSE 'same' END AS verdict FROM h FULL JOIN h2 USING (q)")
def runs_compared(t: Tables) -> DataFrame:
    return E.compared(_ranks(t), _ranks(t, "ts"), "q")


@query("threshold_sweep", "SELECT threshold, count(*) FILTER (value >= threshold) AS answered, count(*) FILTER (value >= threshold AND event_type = 'purchase') AS correct FROM events, (SELECT unnest([10.0::DOUBLE, 50.0, 90.0]) AS threshold) GROUP BY 1")
def threshold_sweep(t: Tables) -> DataFrame:
    return E.threshold_sweep(t.events.withColumn("right", F.col("event_type") == "purchase"), [10.0, 50.0, 90.0], "value", "right")


@query("score_histogram", "SELECT b.bucket, count(e.value) AS n FROM (SELECT unnest([0, 1, 2, 3, 4]) AS bucket) b LEFT JOIN events e ON b.bucket = CASE WHEN value >= 200 THEN 4 WHEN value >= 80 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 20 THEN 1 ELSE 0 END GROUP BY 1")
def score_histogram(t: Tables) -> DataFrame:
    return E.score_histogram(t.events, "value", [20.0, 50.0, 80.0, 200.0])


@query("transition_matrix", "SELECT a.o_orderstatus AS status_a, b.o_orderstatus AS status_b, count(*) AS n FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 GROUP BY ALL")
def transition_matrix(t: Tables) -> DataFrame:
    return E.transition_matrix(t.orders.withColumn("k", F.col("o_orderkey") + 1), t.orders.withColumn("k", F.col("o_orderkey")), "k", "o_orderstatus")


@query("prompt_sizes", "SELECT role, round(avg(length(text) // 2 + 1), 4) AS mean_tokens, max(length(text) // 2 + 1) AS most_tokens FROM conversations GROUP BY 1")
def prompt_sizes(t: Tables) -> DataFrame:
    n = T.token_estimate(F.col("text"))
    return t.conversations.groupBy("role").agg(F.round(F.avg(n), 4).alias("mean_tokens"), F.max(n).alias("most_tokens"))


@query("sessions_by_recency", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1")
def sessions_by_recency(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
