"""Queries over order-sensitive operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import windows as W
from corpusloom.plans.registry import Tables, query


@query("first_occurrence", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_occurrence(t: Tables) -> DataFrame:
    return W.first_occurrence(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("scd2_versions", "SELECT event_id, user_id, row_number() OVER w AS version, lead(ts) OVER w AS valid_to, lead(1) OVER w IS NULL AS is_latest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)".replace("row_number() OVER w", "CAST(row_number() OVER w AS INT)"))
def scd2_versions(t: Tables) -> DataFrame:
    return W.versions(t.events, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "version", "valid_to", "is_latest")


@query("change_detect", """SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'baseline' WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 'unchanged' ELSE 'changed' END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def change_detect(t: Tables) -> DataFrame:
    return W.changes(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id", "change")


@query("outcome_table", """WITH c AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN before = event_type THEN 'unchanged' WHEN user_id % 10 = 0 THEN 'already_held' WHEN same > 1 THEN 'quarantined' WHEN n = 1 THEN 'new' ELSE 'changed' END AS outcome FROM c) GROUP BY 1""")
def outcome_table(t: Tables) -> DataFrame:
    """Outcome of each fetch; the order of the tests decides."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = t.events.withColumns({"before": F.lag("event_type").over(w), "n": F.row_number().over(w), "same": F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))})
    outcome = F.when(F.col("before") == F.col("event_type"), "unchanged").when(F.col("user_id") % 10 == 0, "already_held").when(F.col("same") > 1, "quarantined").when(F.col("n") == 1, "new").otherwise("changed")
    return c.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("history_budget", "SELECT conv_id, turn, used::BIGINT AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 2000")
def history_budget(t: Tables) -> DataFrame:
    return W.newest_within_budget(t.conversations, "conv_id", "turn", F.length("text"), 2000).select("conv_id", "turn", "used")


@query("last_n_messages", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_n_messages(t: Tables) -> DataFrame:
    return W.last_n(t.conversations, "conv_id", [F.desc("turn")], 3).select("conv_id", "turn", "role")


@query("failure_streak", """WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
 s AS (SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g) SELECT event_id, streak, streak >= 2 AS locked FROM s""")
def failure_streak(t: Tables) -> DataFrame:
    return W.failure_streak(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2).select("event_id", "streak", "locked")


@query("rolling_60s", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW), 4) AS used FROM (SELECT *, date_trunc('second', ts) AS s FROM events)".replace("epoch(ts)::BIGINT", "epoch(s)::BIGINT"))
def rolling_60s(t: Tables) -> DataFrame:
    seconds = F.date_trunc("second", F.col("ts").cast("timestamp")).cast("long")
    return t.events.withColumn("used", W.rolling_sum(t.events, "event_type", seconds, F.col("value"))).select("event_id", F.round("used", 4).alias("used"))


@query("session_win", """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM g GROUP BY user_id, g""")
def session_win(t: Tables) -> DataFrame:
    return W.sessions(t.events, "user_id", "ts", "30 minutes")


@query("tumbling_win", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_win(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("sliding_win", "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1")
def sliding_win(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("asof_forward", """SELECT a.event_id, b.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT ts, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.ts <= b.ts""")
def asof_forward(t: Tables) -> DataFrame:
    """The first purchase at or after each error."""
    left = t.events.where("event_type = 'error'").select("event_id", F.col("ts").alias("at"))
    right = t.events.where("event_type = 'purchase'").select(F.col("ts").alias("run_at"), F.struct("event_id").alias("payload"))
    return W.next_as_of(left, right, "at", "run_at", 3600 * 6).select("event_id", F.col("next.payload.event_id").alias("purchase_id"))


@query("latest_state", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(t: Tables) -> DataFrame:
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("s")
    return t.events.groupBy("user_id").agg(last).select("user_id", "s.*")


@query("neighbours", "SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbours(t: Tables) -> DataFrame:
    return W.neighbours(t.conversations, "conv_id", ["turn"], "role").select("conv_id", "turn", "previous", "following")


@query("repeated_suffix", "SELECT doc_id, CASE WHEN n = 1 THEN source ELSE source || '-' || n END AS unique_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id, text) AS n FROM documents)")
def repeated_suffix(t: Tables) -> DataFrame:
    return W.repeated_suffix(t.documents, ["lang"], ["doc_id", "text"], "source").select("doc_id", "unique_name")


@query("capped_by_source", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id, text) <= 4")
def capped_by_source(t: Tables) -> DataFrame:
    return W.capped(t.documents, "source", ["doc_id", "text"], 4).select("doc_id", "source")


@query("illegal_transitions", """WITH m AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
 SELECT from_state, to_state, count(*) AS n FROM m WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (('view', 'click'), ('click', 'signup'), ('signup', 'purchase'), ('view', 'view')) GROUP BY ALL""")
def illegal_transitions(t: Tables) -> DataFrame:
    moves = [("view", "click"), ("click", "signup"), ("signup", "purchase"), ("view", "view")]
    allowed = t.spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state")) for a, b in moves))).alias("m")).select("m.*")
    return W.illegal_transitions(t.events, "user_id", ["ts", "event_id"], "event_type", allowed).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


@query("round_robin", "SELECT doc_id, source, n AS round FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id, text) AS n FROM documents)")
def round_robin(t: Tables) -> DataFrame:
    return W.round_robin(t.documents, "source", ["doc_id", "text"]).select("doc_id", "source", "round")


@query("window_frames", """SELECT event_id, CAST(ntile(4) OVER w AS INT) AS quartile, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, CAST(dense_rank() OVER w AS INT) AS dr, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def window_frames(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return t.events.select("event_id", F.ntile(4).over(w).alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.dense_rank().over(w).alias("dr"), F.first("event_id").over(w).alias("first_id"))


@query("timeline", """SELECT who, when_at, kind, id FROM (SELECT user_id AS who, ts AS when_at, 'event' AS kind, event_id AS id FROM events UNION ALL SELECT o_custkey, o_orderdate, 'order', o_orderkey FROM orders)""")
def timeline(t: Tables) -> DataFrame:
    events = t.events.select(F.col("user_id").alias("who"), F.col("ts").alias("when_at"), F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    orders = t.orders.select(F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("when_at"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return events.unionByName(orders).orderBy("who", "when_at", "kind", "id")


@query("paged", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


@query("multi_key_sort", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC NULLS LAST, lower(c_name), c_custkey LIMIT 25")
def multi_key_sort(t: Tables) -> DataFrame:
    return t.customer.orderBy(F.desc_nulls_last("c_acctbal"), F.lower("c_name"), "c_custkey").limit(25).select("c_custkey", "c_name")


@query("newest_entries", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 60")
def newest_entries(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(60).select("event_id", "event_type")


@query("priority_parts", """SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn = 0 OR turn = m THEN 0 ELSE 1 END, length(text) DESC, turn) AS r FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations)) WHERE r <= 3""")
def priority_parts(t: Tables) -> DataFrame:
    """First and last part of each, then those that say most, three in all."""
    whole = t.conversations.withColumn("m", F.max("turn").over(Window.partitionBy("conv_id")))
    edge = (F.col("turn") == 0) | (F.col("turn") == F.col("m"))
    return W.last_n(whole, "conv_id", [F.desc(edge), F.desc(F.length("text")), F.asc("turn")], 3).select("conv_id", "turn")


@query("greedy_numbering", None)
def greedy_numbering(t: Tables) -> DataFrame:
    found = F.transform(F.regexp_extract_all("text", F.lit(r"\b(\d{1,3})\b"), F.lit(1)), lambda x: x.cast("int"))
    return t.documents.select("doc_id", F.size(W.sequence_numbers(found)).alias("n_kept"), F.size(found).alias("n_found"))


@query("seeded_sample", None)
def seeded_sample(t: Tables) -> DataFrame:
    return W.seeded_sample(t.documents, "source", "doc_id", 3, 42).select("doc_id", "source")
