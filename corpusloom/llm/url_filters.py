"""URL filters with temporal lists: every capture is judged by the entries that were active when it was fetched.

Dated list entries (add or remove a pattern) become validity intervals. A capture asks for all patterns that could
cover its URL (each parent domain, the host, each path prefix up to the depth that patterns have); those that some list
has go on, one row for each list. An as-of join then gives each the last interval of that list and pattern that begins
at or before its fetch: both sides are put in one order of time, and the interval is carried forward. Nothing is
exploded over time, so neither the unit of time nor the length of an interval matters. The captures of a pattern are
dealt to as many parts as hold PART of them, with the pattern's intervals in each, so a host with very many captures is
no single task.

Tables: captures (id, url, fetched_at), entries (list_name, kind in domain/host/prefix, pattern, action in add/remove,
effective_at); times are timestamps or whole numbers.

Defined results: an interval holds its start and not its end; of entries of one instant removal wins; entries with a null
field are void; a null or unreadable URL, or a null fetch time, matches nothing (host null where unreadable); repeated
captures give repeated rows; repeated entries count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Captures of a pattern in one part of the as-of join.
PART = 50_000
#: Listed patterns up to which they are broadcast (about 100 bytes each); beyond that the join shuffles.
BROADCAST_ROWS = 500_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
REST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?"


def host_of(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(F.length(host) > 0, host)


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, kind, pattern, start, stop (null: still active) of each stretch in which a pattern is listed."""
    whole = entries.dropna(subset=["list_name", "kind", "pattern", "action", "effective_at"])
    host = F.lower(F.substring_index("pattern", "/", 1))  # paths keep their letter case
    folded = F.concat(host, F.substr("pattern", F.length(F.substring_index("pattern", "/", 1)) + 1))
    whole = whole.withColumn("pattern", F.when(F.col("kind") == "prefix", folded).otherwise(F.lower("pattern")))
    last = whole.groupBy("list_name", "kind", "pattern", "effective_at").agg(F.max("action").alias("action"))  # remove sorts after add
    by_time = Window.partitionBy("list_name", "kind", "pattern").orderBy("effective_at")
    turns = last.withColumn("before", F.lag("action").over(by_time)).where(F.coalesce("before", F.lit("remove")) != F.col("action"))
    return turns.withColumn("stop", F.lead("effective_at").over(by_time)).where("action = 'add'").select("list_name", "kind", "pattern", F.col("effective_at").alias("start"), "stop")


def _keys(host: Column, path: Column, depth: Column, lengths: list[int]) -> Column:
    """All (kind, pattern) that could cover a URL. lengths: those of listed prefixes that don't end in a slash."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path, "/")  # the first part is empty
    cuts = F.least(F.size(parts) - 1, depth)
    folders = F.transform(F.sequence(F.lit(1), cuts), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    named = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern")))
    none, whole = F.array().cast("array<string>"), F.concat(host, path)
    cut = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(whole)), lambda n: F.substr(whole, F.lit(1), n)) if lengths else none
    prefixes = F.array_distinct(F.concat(F.when(cuts > 0, F.concat(folders, F.array(whole))).otherwise(none), cut))
    return F.concat(named("domain", parents), named("host", F.array(host)), named("prefix", prefixes))


def as_of(asked: DataFrame, spans: DataFrame, key: list[str], part: int = PART, small: bool = False) -> DataFrame:
    """The rows of ``asked`` (key, at and others) with begun: the last span (start, stop) of their key that starts at or before ``at``.

    small: the keys are few enough to broadcast, so no row of a hot key moves before it is dealt to its part.
    """
    parts = asked.groupBy(*key).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    parts = F.broadcast(parts) if small else parts
    dealt = asked.withColumn("__row", F.struct(*asked.columns)).join(parts, key).withColumn("__part", F.pmod(F.xxhash64(*(c for c in asked.columns if c not in key)), "parts").cast("int"))
    copies = spans.join(parts, key).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    span = spans.select(F.struct("start", "stop").alias("s")).schema["s"].dataType
    # Spans come before the captures of the same instant, as an interval holds its start.
    left = dealt.select(*key, "__part", "at", F.lit(1).alias("__side"), "__row", F.lit(None).cast(span).alias("__span"))
    right = copies.select(*key, "__part", F.col("start").alias("at"), F.lit(0).alias("__side"), F.lit(None).cast(dealt.schema["__row"].dataType).alias("__row"), F.struct("start", "stop").alias("__span"))
    by_time = Window.partitionBy(*key, "__part").orderBy("at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.unionByName(right).withColumn("begun", F.last("__span", ignorenulls=True).over(by_time))
    return carried.where("__side = 1").select("__row.*", "begun")


def judge(captures: DataFrame, entries: DataFrame, part: int = PART) -> DataFrame:
    """Captures with host, n_matches (lists and patterns that were active), first_match and blocked."""
    spans = intervals(entries)
    depth = spans.where("kind = 'prefix'").agg(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit("")))).alias("d"))
    deepest = depth.first()["d"] or 0
    lengths = [r["n"] for r in spans.where("kind = 'prefix' and not endswith(pattern, '/') and pattern <> ''").select(F.length("pattern").alias("n")).distinct().collect()]
    base = captures.select("id", "url", "fetched_at", host_of(F.col("url")).alias("host"))
    path = F.coalesce(F.nullif(F.regexp_extract("url", REST, 1), F.lit("")), F.lit("/"))
    distinct = base.where("host is not null and fetched_at is not null").select("url", "host", F.col("fetched_at").alias("at")).distinct()
    asked = distinct.select("url", "at", F.explode(_keys(F.col("host"), path, F.lit(int(deepest)), lengths)).alias("k")).select("url", "at", "k.*")
    listed = spans.select("list_name", "kind", "pattern").distinct()
    n_listed = listed.count()
    known = asked.join(F.broadcast(listed) if n_listed <= BROADCAST_ROWS else listed, ["kind", "pattern"])
    met = as_of(known, spans, ["list_name", "kind", "pattern"], part, n_listed <= BROADCAST_ROWS).where("begun is not null and (begun.stop is null or at < begun.stop)")
    found = met.groupBy("url", F.col("at").alias("fetched_at")).agg(F.count("*").alias("n_matches"), F.min(F.concat_ws(":", "list_name", "kind", "pattern")).alias("first_match"))
    joined = base.join(found, ["url", "fetched_at"], "left")
    n = F.coalesce("n_matches", F.lit(0)).cast("long")
    return joined.select("id", "url", "fetched_at", "host", n.alias("n_matches"), "first_match", (n > 0).alias("blocked"))


def derived_lists(pages: DataFrame) -> DataFrame:
    """Dated entries derived from the hosts of the pages, as the tables hold no list."""
    domain = F.regexp_replace(host_of(F.col("url")), r"^(www|m|blog)\.", "")
    by_domain = pages.select("page_id", domain.alias("domain")).where("domain is not null").groupBy("domain").agg(F.min("page_id").alias("k"))
    entry = lambda name, kind, pattern, action, at: F.struct(F.lit(name).alias("list_name"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), at.cast("long").alias("effective_at"))
    d, k = F.col("domain"), F.col("k")
    spam = [entry("spam", "domain", d, "add", k % 300), entry("spam", "domain", d, "remove", k % 300 + 200), entry("spam", "domain", d, "add", k % 300 + 350)]
    told = [entry("complaints", "host", F.concat(F.lit("m."), d), "add", k % 500), entry("complaints", "host", F.concat(F.lit("m."), d), "remove", k % 500 + 100)]
    part = [entry("sections", "prefix", F.concat(d, F.lit("/en/")), "add", k % 600)]
    none = F.array().cast("array<struct<list_name:string,kind:string,pattern:string,action:string,effective_at:bigint>>")
    rows = F.concat(F.when(d.rlike("casino|bets|pills|ads"), F.array(*spam)).otherwise(none), F.when(k % 5 == 0, F.array(*told)).otherwise(none), F.when(k % 7 == 0, F.array(*part)).otherwise(none))
    return by_domain.select(F.explode(rows).alias("e")).select("e.*")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged at a fetch day that follows from its id."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("id"), "url", (F.col("page_id") * 7919 % 730).alias("fetched_at"))
    found = judge(captures, derived_lists(pages))
    return found.select(F.col("id").alias("page_id"), "host", F.col("fetched_at").alias("fetched_day"), "n_matches", "first_match", "blocked")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url, page_id * 7919 % 730 AS fetched_day, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
         coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path FROM pages),
d AS (SELECT regexp_replace(host, '^(www|m|blog)\.', '') AS domain, min(page_id) AS k FROM p GROUP BY 1),
s AS (
  SELECT 'spam' AS list_name, 'domain' AS kind, domain AS pattern, k % 300 AS a, k % 300 + 200 AS b FROM d WHERE regexp_matches(domain, 'casino|bets|pills|ads')
  UNION ALL SELECT 'spam', 'domain', domain, k % 300 + 350, NULL FROM d WHERE regexp_matches(domain, 'casino|bets|pills|ads')
  UNION ALL SELECT 'complaints', 'host', 'm.' || domain, k % 500, k % 500 + 100 FROM d WHERE k % 5 = 0
  UNION ALL SELECT 'sections', 'prefix', domain || '/en/', k % 600, NULL FROM d WHERE k % 7 = 0),
m AS (
  SELECT p.page_id, count(*) AS n, min(list_name || ':' || kind || ':' || pattern) AS f
  FROM p JOIN s ON p.fetched_day >= s.a AND (s.b IS NULL OR p.fetched_day < s.b)
   AND CASE kind WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern) WHEN 'host' THEN host = pattern ELSE starts_with(host || path, pattern) END
  GROUP BY 1)
SELECT p.page_id, p.host, p.fetched_day, coalesce(m.n, 0) AS n_matches, m.f AS first_match, coalesce(m.n, 0) > 0 AS blocked FROM p LEFT JOIN m USING (page_id)
"""
