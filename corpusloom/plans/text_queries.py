"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans.registry import Tables, query

ONE_SPACE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query("content_hash", f"SELECT doc_id, sha256({ONE_SPACE}) AS content_hash, length({ONE_SPACE}) AS n_chars_flat FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.length(T.one_space(F.col("text"))).cast("long").alias("n_chars_flat"))


@query("title_key", r"""SELECT page_id, regexp_replace(lower(regexp_replace(title, '^\s*(?:\d+\s+)?(?:[Tt][Hh][Ee]\s+)?', '')), '[^0-9a-z]', '', 'g') AS key,
 regexp_replace(regexp_replace(regexp_replace(lower(title), '''', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
 FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)""")
def title_key(t: Tables) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    plain = F.regexp_replace(title, "%", "%25")  # these titles hold no percent codes
    return t.pages.select("page_id", T.title_key(plain).alias("key"), T.slug(title).alias("slug"))


@query("search_tokens", f"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(replace(lower(coalesce(text, '')), '-', ' '), '[a-z]+|[0-9]+[a-z]?'),
 lambda w: w NOT IN ({', '.join(f"'{w}'" for w in T.STOP_WORDS)})), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y'
 WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END), ' ') AS tokens FROM documents""")
def search_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("text_quality", r"""SELECT doc_id, letters, CASE WHEN body < 200 THEN 'near-empty' WHEN letters < 0.55 THEN 'few letters'
 WHEN singles / greatest(words, 1) > 0.35 THEN 'single letters' END AS problem FROM (
 SELECT doc_id, length(b) AS body, len(regexp_extract_all(b, '\p{L}')) / nullif(length(b), 0) AS letters, len(w) AS words,
 len(list_filter(w, lambda x: length(x) = 1 AND regexp_matches(x, '\p{L}'))) AS singles
 FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s', '', 'g') AS b, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents))""")
def text_quality(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.letter_ratio(F.col("text")).alias("letters"), T.text_problem(F.col("text"), F.lit(1), F.lit(0)).alias("problem"))


@query("script_ratio", r"""SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) > 0 AS readable, false AS mostly_arabic FROM documents""")
def script_ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.readable(F.col("text")).alias("readable"), T.mostly_arabic(F.col("text")).alias("mostly_arabic"))


@query("language_by_script", r"""SELECT lang, CASE WHEN 2 * len(regexp_extract_all(text, '[\x{600}-\x{6FF}]')) > len(regexp_extract_all(text, '\p{L}')) THEN 'ur' ELSE 'en' END AS guess, count(*) AS n FROM documents GROUP BY ALL""")
def language_by_script(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", F.when(T.mostly_arabic(F.col("text")), "ur").otherwise("en").alias("guess")).agg(F.count("*").alias("n"))


@query("preview_200", f"SELECT doc_id, CASE WHEN length(t) > 200 THEN rtrim(left(t, 200)) || '…' ELSE t END AS preview FROM (SELECT doc_id, {ONE_SPACE} AS t FROM documents)")
def preview_200(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.shortened(F.col("text"), 200).alias("preview"))


@query("excerpt_280", rf"""SELECT doc_id, CASE WHEN length(s) > 280 THEN rtrim(left(s, 280)) || '…' ELSE s END AS excerpt FROM (
 SELECT doc_id, CASE WHEN regexp_matches(t, '^[a-z]') THEN coalesce(nullif(regexp_extract(t, '^[^.]*\. +([A-Z].*)$', 1), ''), t) ELSE t END AS s FROM (SELECT doc_id, {ONE_SPACE} AS t FROM documents))""")
def excerpt_280(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("placeholders", r"""SELECT doc_id, array_to_string(list_distinct(p), '|') AS found FROM (SELECT doc_id, regexp_extract_all(text, '\{\{[^{}\n]{1,80}\}\}') AS p FROM documents) WHERE len(p) = 1""")
def placeholders(t: Tables) -> DataFrame:
    found = F.filter(T.placeholders(F.col("text")), lambda p: p.startswith("{{"))
    return t.documents.where(F.regexp_count("text", F.lit(r"\{\{[^{}\n]{1,80}\}\}")) == 1).select("doc_id", F.array_join(found, "|").alias("found"))


@query("dates_named", r"""SELECT doc_id, CASE WHEN y < 100 THEN y + 2000 ELSE y END AS year, m AS month, d AS day FROM (
 SELECT DISTINCT doc_id, CAST(regexp_extract(s, '(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})', 3) AS INT) AS y, CAST(regexp_extract(s, '(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})', 2) AS INT) AS m,
 CAST(regexp_extract(s, '(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})', 1) AS INT) AS d
 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b')) AS s FROM documents))""")
def dates_named(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(T.dates(F.col("text"))).alias("d")).select("doc_id", "d.*")


@query("file_names", r"""SELECT page_id, regexp_extract(regexp_extract(url, '^[^?#]*'), '([^/]*)/*$', 1) AS name FROM pages""")
def file_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.file_name(F.regexp_extract("url", "^[^?#]*", 0)).alias("name"))


@query("email_domains", r"""SELECT doc_id, lower(split_part(e, '@', 2)) AS domain, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS e FROM documents) GROUP BY ALL""")
def email_domains(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))).alias("e"))
    return found.groupBy("doc_id", T.email_domain(F.col("e")).alias("domain")).agg(F.count("*").alias("n"))


@query("digits_translated", r"""SELECT doc_id, sha256(translate(text, chr(160) || chr(8211) || chr(8212), ' --')) AS text_sha FROM documents""")
def digits_translated(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(T.plain_digits(F.col("text")), 256).alias("text_sha"))


@query("inline_markdown", r"""SELECT page_id, trim(regexp_replace(regexp_replace(body, '\s*<br\s*/?>\s*', '; ', 'gi'), '\*\*(.+?)\*\*', '\1', 'g')) AS body FROM (SELECT page_id, replace(regexp_extract(html, '<p>(.*?)</p>', 1), '_', '') AS body FROM pages) WHERE NOT regexp_matches(body, '(^|[^*])\*([^*]|$)|\*\*\*')""")
def inline_markdown(t: Tables) -> DataFrame:
    body = t.pages.select("page_id", F.replace(F.regexp_extract("html", "<p>(.*?)</p>", 1), F.lit("_"), F.lit("")).alias("body"))
    return body.where(~F.col("body").rlike(r"(^|[^*])\*([^*]|$)|\*\*\*")).select("page_id", T.without_markdown(F.col("body")).alias("body"))


@query("token_estimate", "SELECT conv_id, turn, length(coalesce(text, '')) // 2 + 1 AS tokens FROM conversations")
def token_estimate(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


@query("page_titles", """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)', 1) AS lang FROM pages""")
def page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)', 1).alias("lang"))


@query("page_links", r"""SELECT page_id, href, min(i) AS first_at FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"#]+)"', 1) AS l FROM pages)) GROUP BY ALL""")
def page_links(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1))).alias("i", "href"))
    return links.groupBy("page_id", "href").agg(F.min("i").cast("long").alias("first_at"))


@query("title_status", r"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '(?i)repeal|the end') THEN 'repealed' WHEN regexp_matches(text, '(?i)draft|bill') THEN 'under_review' ELSE 'current' END AS status FROM documents) GROUP BY 1""")
def title_status(t: Tables) -> DataFrame:
    status = T.first_rule(F.col("text"), [("(?i)repeal|the end", "repealed"), ("(?i)draft|bill", "under_review")], "current")
    return t.documents.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("headings_masked", r"""SELECT page_id, length(html) AS n, array_to_string(list_transform(string_split(html, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[ \t]*(#{1,6}[ \t].*|\*\*[^*\n]{1,80}\*\*:?[ \t]*)$') THEN repeat(' ', length(x)) ELSE x END), chr(10)) = html AS same FROM pages""")
def headings_masked(t: Tables) -> DataFrame:
    masked = T.mask_headings(F.col("html"))
    return t.pages.select("page_id", F.length(masked).cast("long").alias("n"), (masked == F.col("html")).alias("same"))


@query("index_exclusion", r"""SELECT item, why FROM (SELECT doc_id * 10000 + i AS item, CASE WHEN length(b) < 40 AND len(list_filter(regexp_extract_all(b, '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{2,}'))) < 3 THEN 'body under 40 characters'
 WHEN regexp_matches(b, '^(?i:omitted|repealed|rep\. by)') AND length(b) < 250 THEN 'removal note' END AS why
 FROM (SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM documents WHERE lang = 'en'))) WHERE why IS NOT NULL""")
def index_exclusion(t: Tables) -> DataFrame:
    from corpusloom.operators.filters import index_exclusion as why

    lines = t.documents.where("lang = 'en'").select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("i", "b"))
    return lines.select((F.col("doc_id") * 10000 + F.col("i") + 1).alias("item"), why(F.col("b")).alias("why")).where("why is not null")


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ':' || coalesce(json_extract_string(props, '$.k'), '') AS tag FROM events")
def json_props(t: Tables) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.events.select("event_id", k.alias("k"), F.concat(F.col("event_type"), F.lit(":"), F.coalesce(k.cast("string"), F.lit(""))).alias("tag"))


@query("record_validation", """SELECT doc_id, array_to_string(list_filter([CASE WHEN length(coalesce(text, '')) < 50 THEN 'short text' END, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'fr') THEN 'language' END,
 CASE WHEN n_chars <> length(text) THEN 'length differs' END, CASE WHEN source IS NULL THEN 'no source' END], lambda x: x IS NOT NULL), '; ') AS problems FROM documents""")
def record_validation(t: Tables) -> DataFrame:
    from corpusloom.operators.filters import problems

    text = F.coalesce("text", F.lit(""))
    found = problems([(F.length(text) < 50, "short text"), (F.coalesce(~F.col("lang").isin("en", "de", "fr"), F.lit(True)), "language"), (F.col("n_chars") != F.length("text"), "length differs"), (F.col("source").isNull(), "no source")])
    return t.documents.select("doc_id", F.array_join(found, "; ").alias("problems"))


@query("map_first_wins", """SELECT user_id, event_type, min_by(value, ts_id) AS value FROM (SELECT *, (ts, event_id) AS ts_id FROM events) GROUP BY ALL""")
def map_first_wins(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("value"))


@query("array_functions", """SELECT l_orderkey, array_to_string(list_sort(list_distinct(array_agg(l_shipmode))), ',') AS flags, count(*) AS n FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def array_functions(t: Tables) -> DataFrame:
    flags = F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",")
    return t.lineitem.groupBy("l_orderkey").agg(flags.alias("flags"), F.count("*").alias("n"))


@query("date_arithmetic", """SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS days_ago, o_orderdate + INTERVAL 30 DAY AS due, o_orderdate >= TIMESTAMP '1998-06-01' AS recent FROM orders""")
def date_arithmetic(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.datediff(F.lit("1998-08-02").cast("date"), day).cast("long").alias("days_ago"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("due"), (F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).alias("recent"))
