"""Queries over sources and sinks: what they scan is written from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import catalog
from corpusloom.plans.registry import Tables, query
from corpusloom.streaming import staging
from corpusloom.sources import listings, readers, shards, sinks, versions
from corpusloom.sources.scratch import scratch_path


@query("scan_jsonl", "SELECT lang, count(*) FILTER (doc_id % 50 <> 0) AS records, CAST(sum(CASE WHEN doc_id % 50 <> 0 THEN length(text) END) AS BIGINT) AS chars FROM documents WHERE doc_id % 50 <> 0 GROUP BY 1 UNION ALL SELECT 'unreadable', count(*), NULL FROM documents WHERE doc_id % 50 = 0")
def scan_jsonl(t: Tables) -> DataFrame:
    """Records written as JSON lines, every fiftieth one cut short; unreadable lines are counted, not lost."""
    path, line = scratch_path(t.spark, "jsonl"), F.to_json(F.struct("doc_id", "text", "lang"))
    t.documents.select(F.when(F.col("doc_id") % 50 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    rows = readers.json_lines(t.spark, path, schema)
    name = F.when(F.col("bad_line").isNotNull(), "unreadable").otherwise(F.col("lang"))
    return rows.groupBy(name.alias("lang")).agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"))


@query("scan_csv", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 <> 0")
def scan_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).otherwise(" ").alias("name"), F.col("c_mktsegment").alias("segment")).write.option("header", True).csv(path)
    return readers.csv_table(t.spark, path, ["id", "name", "segment"], ["name"])


@query("scan_markdown", "SELECT p_partkey::VARCHAR AS n, p_name AS title, p_size::VARCHAR AS chunks FROM part")
def scan_markdown(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "markdown")
    row = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    head = t.region.select(F.lit("| n | title | chunks |").alias("value")).union(t.region.select(F.lit("|---|:--|--:|")))
    head.union(t.part.select(row(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string")))).write.text(path)
    return readers.markdown_rows(t.spark, path, ["n", "title", "chunks"])


@query("scan_tagged", "SELECT event_type AS token, 'B-' || left(event_type, 1) AS tag, count(*) AS n FROM events GROUP BY ALL")
def scan_tagged(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "tagged")
    line = F.concat(F.col("event_type"), F.lit(" B-"), F.left("event_type", F.lit(1)), F.lit("\nmalformed\n"))
    t.events.select(line.alias("value")).write.text(path)
    return readers.tagged_sentences(t.spark, path).groupBy("token", "tag").agg(F.count("*").alias("n"))


@query("scan_encodings", "SELECT doc_id, length(text) AS chars FROM documents")
def scan_encodings(t: Tables) -> DataFrame:
    """Texts as bytes in UTF-8 and UTF-16, read back by the fallback chain."""
    utf16 = F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE"))
    raw = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(utf16).alias("content"))
    return raw.select("doc_id", F.length(readers.decoded(F.col("content"))).cast("long").alias("chars"))


@query("html_links")
def html_links(t: Tables) -> DataFrame:
    return readers.links(t.pages).select("page_id", "at", "target", "title")


@query("union_with_set", "SELECT set, count(*) AS n, count(lang) AS with_lang FROM (SELECT 'documents' AS set, lang FROM documents UNION ALL SELECT 'benchmark', NULL FROM benchmark) GROUP BY 1")
def union_with_set(t: Tables) -> DataFrame:
    both = readers.with_set({"documents": t.documents.select("text", "lang"), "benchmark": t.benchmark.select("text")})
    return both.groupBy("set").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"))


@query("paged_walk", "WITH p AS (SELECT user_id % 26 AS letter, event_id % 40 AS page, bool_or(event_type <> 'view') AS new FROM events GROUP BY ALL), s AS (SELECT letter, min(page) FILTER (NOT new) AS stop FROM p GROUP BY 1) SELECT letter, page FROM p JOIN s USING (letter) WHERE stop IS NULL OR page < stop")
def paged_walk(t: Tables) -> DataFrame:
    pages = t.events.groupBy((F.col("user_id") % 26).alias("letter"), (F.col("event_id") % 40).alias("page")).agg(F.bool_or(F.col("event_type") != "view").alias("new"))
    return readers.pages_until_empty(pages, "letter", "page", F.col("new")).select("letter", "page")


@query("state_upsert", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END DESC, event_id DESC) = 1")
def state_upsert(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "ts")
    return sinks.upserted(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), "user_id", "ts").select("user_id", "event_type", "event_id")


@query("state_replaced", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS state FROM customer")
def state_replaced(t: Tables) -> DataFrame:
    held = t.customer.select("c_custkey", F.col("c_mktsegment").alias("state"))
    return catalog.upsert(held, held.where("c_custkey % 4 = 0").withColumn("state", F.lit("new")), "c_custkey")


@query("quarantine_split", r"SELECT sha256(doc_id::VARCHAR) AS key_hash, 'short' AS reason, length(text)::INT AS chars, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 600) AS start FROM documents WHERE length(text) < 300")
def quarantine_split(t: Tables) -> DataFrame:
    return sinks.quarantine(t.documents, F.when(F.length("text") < 300, "short"), "doc_id", "text")[1]


@query("vector_cache_misses", "SELECT DISTINCT sha256('mini' || chr(10) || text) AS key FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 4 = 0)")
def vector_cache_misses(t: Tables) -> DataFrame:
    cache = t.documents.where("doc_id % 4 = 0").select(sinks.cache_key("mini", F.col("text")).alias("key"))
    return sinks.cache_misses(t.documents, cache, "mini").select("key")


@query("published_table", "SELECT count(*) AS n, count(DISTINCT source) AS sources FROM documents")
def published_table(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "published")
    sinks.publish(t.documents.select("doc_id", "source").limit(0), path)
    sinks.publish(t.documents.select("doc_id", "source"), path)
    return sinks.published(t.spark, path).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("appended_log", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def appended_log(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "log")
    for rest in (0, 1):
        sinks.append_log(t.events.where(F.col("event_id") % 2 == rest).select("event_type"), path)
    return t.spark.read.schema("event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("staged_report", "SELECT event_id, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS local_time, left(sha256(props), 12) AS hash FROM events WHERE event_type = 'error'")
def staged_report(t: Tables) -> DataFrame:
    at = F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "+05:00"), "yyyy-MM-dd HH:mm")
    return t.events.where("event_type = 'error'").select("event_id", at.alias("local_time"), F.left(F.sha2("props", 256), F.lit(12)).alias("hash"))


@query("corpus_collection", "SELECT origin, count(*) AS n FROM (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'chat', text FROM conversations) WHERE length(trim(text, ' ')) >= 50 GROUP BY 1")
def corpus_collection(t: Tables) -> DataFrame:
    rows = t.documents.select(F.lit("documents").alias("origin"), "text").unionByName(t.benchmark.select(F.lit("benchmark").alias("origin"), "text")).unionByName(t.conversations.select(F.lit("chat").alias("origin"), "text"))
    return rows.where(F.length(F.trim("text")) >= 50).groupBy("origin").agg(F.count("*").alias("n"))


@query("embedding_resumed", "SELECT DISTINCT sha256('m' || chr(10) || text) AS key, length(text)::DOUBLE AS value, true AS complete FROM documents WHERE text IS NOT NULL")
def embedding_resumed(t: Tables) -> DataFrame:
    """Vectors of all texts by a run that stops after one step of its units and another that goes on; none is computed twice."""
    path, docs = scratch_path(t.spark, "vectors"), t.documents
    embed = lambda text: F.array(F.length(text).cast("double"))
    first = shards.embed_missing(docs, path, "m", embed, step_rows=docs.count() // 3, steps=1)
    second = shards.embed_missing(docs, path, "m", embed)
    whole = second.complete and second.reused == first.embedded and first.embedded + second.embedded == second.texts
    return shards.vectors(t.spark, path).select("key", F.get("vector", F.lit(0)).alias("value"), F.lit(whole).alias("complete"))


LISTING = "SELECT doc_id AS seq, lang AS run, source, CAST(substr(source, 4) AS INT) AS source_order, left(text, 12) AS url, doc_id % 7 = 0 AS priority, n_chars / 100.0::DOUBLE AS cost FROM documents"


def _listing(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("seq"), F.col("lang").alias("run"), "source", F.substr("source", F.lit(4)).cast("int").alias("source_order"), F.left("text", F.lit(12)).alias("url"), (F.col("doc_id") % 7 == 0).alias("priority"), (F.col("n_chars") / 100.0).alias("cost"))


@query("run_selection", f"""WITH l AS ({LISTING}), a AS (SELECT *, row_number() OVER (PARTITION BY run, source, url ORDER BY priority DESC, seq) AS c FROM l),
 b AS (SELECT *, CASE WHEN c = 1 THEN count(*) FILTER (c = 1) OVER (PARTITION BY run, source ORDER BY priority DESC, seq) END AS nth FROM a),
 d AS (SELECT *, CASE WHEN c > 1 THEN 'listed twice' WHEN nth > 3 + source_order % 4 THEN 'over the cap' ELSE 'do' END AS s FROM b),
 e AS (SELECT run, source, seq, coalesce(sum(cost) OVER (PARTITION BY run ORDER BY source_order, priority DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 900 AS over FROM d WHERE s = 'do')
 SELECT d.run, d.source, d.seq, CASE WHEN over THEN 'budget spent' ELSE s END AS status FROM d LEFT JOIN e ON e.run = d.run AND e.source = d.source AND e.seq = d.seq""")
def run_selection(t: Tables) -> DataFrame:
    """What each language's run does of its listing: priority first, a url once, a cap by source, and the seconds of all."""
    return staging.chosen(_listing(t), 3 + F.col("source_order") % 4, 900.0).select("run", "source", "seq", "status")


@query("staged_outcomes")
def staged_outcomes(t: Tables) -> DataFrame:
    """Events as fetches of a day's run: the state machine of the stream over all of them at once."""
    at = F.col("ts").cast("timestamp")
    rows = t.events.select(
        F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"), F.date_format(at, "yyyy-MM-dd").alias("run"), (F.col("user_id") % 5).cast("string").alias("source"),
        F.floor("value").cast("string").alias("hash"), at.alias("fetched_at"), (F.col("event_id") % 97 == 0).alias("core"), F.when(F.col("event_id") % 31 == 0, "near-empty").alias("problem"), F.when(F.col("event_type") == "error", "timeout").alias("error"),
    )
    return staging.staged(rows).select("run", "seq", "url", "outcome", "reason")


@query("reparsed_records", r"""WITH s AS (SELECT doc_id, lang AS url_part, source, doc_id % 3 = 0 AS was_changed, doc_id % 10 = 0 AS lost, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS record FROM documents),
 h AS (SELECT *, sha256(record) AS hash FROM s), f AS (SELECT hash, min(doc_id) AS first FROM h WHERE NOT lost GROUP BY 1)
 SELECT doc_id, CASE WHEN lost THEN 'error' WHEN first <> doc_id OR length(record) < 200 THEN 'quarantined' WHEN was_changed THEN 'changed' ELSE 'new' END AS outcome,
  CASE WHEN lost THEN 'no original' WHEN first <> doc_id THEN 'same text as ' || lpad(first::VARCHAR, 12, '0') WHEN length(record) < 200 THEN 'near-empty' END AS reason FROM h LEFT JOIN f USING (hash)""")
def reparsed_records(t: Tables) -> DataFrame:
    """All documents' records rebuilt from originals that were saved twice; every tenth original is lost."""
    name = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    state = t.documents.select("doc_id", name.alias("url"), "source", name.alias("original_url"), F.when(F.col("doc_id") % 3 == 0, "changed").otherwise("unchanged").alias("outcome"), F.lit("2024-01-01").alias("fetched_at"), F.lit("r").alias("run_id"))
    saved = t.documents.where("doc_id % 10 <> 0").select(name.alias("url"), F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("draft").alias("c")), F.struct(F.lit(2).alias("at"), F.col("text").alias("c")))).alias("o"))
    parse = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\f\x0b]+", " "))
    found = versions.reparsed(state, saved.select("url", F.col("o.at").alias("saved_at"), F.col("o.c").alias("content")), parse, lambda r: F.when(F.length(r) < 200, "near-empty"))
    return found.select(F.col("url").cast("long").alias("doc_id"), "outcome", "reason")


@query("archive_members", "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents")
def archive_members(t: Tables) -> DataFrame:
    """All documents written into zip archives by tasks, and read back member by member through the data source."""
    import pandas as pd

    from corpusloom.sources.archives import Archives

    path = scratch_path(t.spark, "archives").removeprefix("file://")

    def zipped(batches):
        import os
        import uuid
        import zipfile

        os.makedirs(path, exist_ok=True)
        made = f"{path}/{uuid.uuid4().hex}"
        n = 0
        with zipfile.ZipFile(f"{made}.part", "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for i, text in zip(b["doc_id"], b["text"]):
                    z.writestr(f"{i}.txt", text or "")
                    n += 1
        os.rename(f"{made}.part", f"{made}.zip") if n else os.remove(f"{made}.part")
        yield pd.DataFrame({"n": [n]})

    # An archive for each part of the input, so that no task takes a fixed share of a growing table.
    t.documents.select("doc_id", "text").mapInPandas(zipped, "n long").agg(F.sum("n")).collect()
    t.spark.dataSource.register(Archives)
    rows = t.spark.read.format("archives").option("pattern", "*.txt").option("partBytes", str(4 << 20)).load(path)
    return rows.select(F.regexp_extract("member", r"^(\d+)", 1).cast("long").alias("doc_id"), "size", F.md5("content").alias("digest"))


@query("accordion_laws", """SELECT p_size AS page, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS nth, p_name AS title, 'law?id=' || p_partkey AS target,
 CASE WHEN p_partkey % 3 = 0 THEN p_partkey || ' of 1950' END AS act_number, CASE p_partkey % 3 WHEN 0 THEN 'May ' || p_size || ' 1950' WHEN 1 THEN 'June 1 1951' END AS promulgated FROM part""")
def accordion_laws(t: Tables) -> DataFrame:
    """Listing pages printed from the parts by their size: titles nested differently, with all, some or none of what stands behind them."""
    kind, number = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    link = F.concat(F.lit('<a href="law?id='), number, F.lit('">'), F.col("p_name"), F.lit("</a>"))
    title = F.concat(F.lit('<div class="accordion-section-title">'), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<div><div>"), link, F.lit("</div></div>"))).otherwise(link), F.lit("</div>"))
    full = F.concat(F.lit('<div class="accordion-section-content">Laws | <b>'), number, F.lit(" of 1950</b> | Promulgation Date: May "), F.col("p_size").cast("string"), F.lit(" 1950</div>"))
    behind = F.when(kind == 0, full).when(kind == 1, '<div>x</div><div class="accordion-section-content"><div>Laws | none |</div> Promulgation Date: June 1 1951</div>').otherwise("")
    block = F.struct("p_partkey", F.concat(F.lit("<div>"), title, behind, F.lit("</div>")).alias("b"))
    pages = t.part.groupBy(F.col("p_size").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n").alias("html"))
    return listings.accordion(pages, "page")
