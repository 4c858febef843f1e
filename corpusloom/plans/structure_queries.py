"""Queries over chunking, checks and duplicate detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import checks as K, chunking as C, dedupe as D, joins as J
from corpusloom.plans.registry import Tables, query


@query("chunk_fixed", "SELECT doc_id, n, start, sha256(chunk) AS sha FROM (SELECT doc_id, CAST(i AS INT) AS n, CAST(i * 700 AS INT) AS start, trim(substr(text, CAST(i * 700 + 1 AS BIGINT), 800), ' ') AS chunk FROM documents, (SELECT unnest(range(0, 400)) AS i) WHERE i * 700 <= greatest(0, length(text) - 101) AND length(text) > 0) WHERE chunk <> ''")
def chunk_fixed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(C.fixed_windows(F.col("text"))).alias("c")).select("doc_id", "c.n", "c.start", F.sha2("c.chunk", 256).alias("sha"))


@query("token_windows", """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '') AS ws FROM documents)
 SELECT doc_id, CAST(i * 60 AS INT) AS start, len(ws[i * 60 + 1 : i * 60 + 120])::INT AS n FROM w, (SELECT unnest(range(0, 2000)) AS i) WHERE len(ws) > 0 AND i <= greatest(0, CAST(ceil((len(ws) - 120) / 60) AS BIGINT))""")
def token_windows(t: Tables) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    cut = t.documents.select("doc_id", F.posexplode(C.token_windows(words)).alias("i", "w"))
    return cut.select("doc_id", (F.col("i") * 60).alias("start"), F.size("w").alias("n"))


@query("paragraphs_blank", r"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INT) AS n, b AS text FROM (SELECT page_id, i, trim(regexp_replace(b, '\s+', ' ', 'g')) AS b FROM (
 SELECT page_id, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM (SELECT page_id, string_split_regex(replace(html, '</p><p>', chr(10) || chr(10)), '\n\s*\n') AS l FROM pages))) WHERE length(b) >= 40""")
def paragraphs_blank(t: Tables) -> DataFrame:
    from corpusloom.functions.text import one_space

    blocks = F.filter(F.transform(F.split(F.replace("html", F.lit("</p><p>"), F.lit("\n\n")), r"\n\s*\n"), one_space), lambda b: F.length(b) >= 40)
    return t.pages.select("page_id", F.posexplode(blocks).alias("n", "text")).select("page_id", (F.col("n") + 1).alias("n"), "text")


@query("paragraphs")
def paragraphs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(C.paragraphs(F.col("text"))).alias("p")).select("doc_id", "p.n", "p.text")


@query("chunk_spaces")
def chunk_spaces(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(C.space_windows(F.col("text"))).alias("n", "chunk"))


@query("chunk_prefixed")
def chunk_prefixed(t: Tables) -> DataFrame:
    prefix = F.concat(F.lit("Source "), F.col("source"), F.lit(":"))
    return t.documents.select("doc_id", F.explode(C.prefixed_windows(F.col("text"), prefix, C.word_spans)).alias("c")).select("doc_id", "c.*")


@query("sections", r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+\.( |$)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS seq FROM l)
 SELECT doc_id, CAST(seq AS BIGINT) AS seq, count(*) - 1 AS more_lines FROM m WHERE seq > 0 GROUP BY ALL""")
def sections(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    seq = F.sum(F.col("line").rlike(r"^[A-Z][a-z]+\.( |$)").cast("int")).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("seq", seq).where("seq > 0").groupBy("doc_id", "seq").agg((F.count("*") - 1).alias("more_lines"))


@query("section_records", r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^([A-Z][a-z]+)\.( .*|)$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS seq FROM l WHERE NOT regexp_matches(line, '^(?i:chapter|part)\b')),
 g AS (SELECT doc_id, seq::BIGINT AS seq, string_agg(line, chr(10) ORDER BY i) AS a FROM m WHERE seq > 0 GROUP BY ALL)
 SELECT doc_id, seq, regexp_extract(f, '^([A-Z][a-z]+)\.( .*|)$', 1) AS section, regexp_extract(f, '^([A-Z][a-z]+)\.( .*|)$', 2) AS heading, trim(substr(a, length(f) + 2), ' ') AS text FROM (SELECT *, string_split(a, chr(10))[1] AS f FROM g)""")
def section_records(t: Tables) -> DataFrame:
    return C.sections(t.documents, "doc_id", r"^([A-Z][a-z]+)\.( .*|)$")


@query("document_units")
def document_units(t: Tables) -> DataFrame:
    units = t.documents.select("doc_id", F.explode(F.array(C.units(F.col("text")))).alias("units"))
    return units.select("doc_id", F.posexplode(C.packed(F.col("units"), 2000)).alias("part", "text"))


@query("bio_spans", """WITH x AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'O' WHEN event_type IN ('click', 'error') THEN 'B-' || left(event_type, 1) ELSE 'I-' || left(event_type, 1) END AS tag, value AS score FROM events),
 k AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) ELSE '' END AS kind FROM x), s AS (SELECT *, CASE WHEN tag LIKE 'B-%' OR (tag LIKE 'I-%' AND coalesce(lag(kind) OVER (PARTITION BY user_id ORDER BY event_id), '') <> kind) THEN 1 ELSE 0 END AS st FROM k),
 g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS span FROM s) SELECT user_id, kind, min(event_id) AS first, max(event_id) AS last, round(avg(score), 4) AS score FROM g WHERE tag <> 'O' GROUP BY user_id, span, kind""")
def bio_spans(t: Tables) -> DataFrame:
    letter = F.left("event_type", F.lit(1))
    tag = F.when(F.col("event_type") == "view", "O").when(F.col("event_type").isin("click", "error"), F.concat(F.lit("B-"), letter)).otherwise(F.concat(F.lit("I-"), letter))
    tags = t.events.select("user_id", "event_id", tag.alias("tag"), F.col("value").alias("score"))
    return C.bio_spans(tags, ["user_id"], "event_id").select("user_id", "kind", "first", "last", F.round("score", 4).alias("score"))


@query("contents_tables", r"""SELECT doc_id, regexp_matches(text, '(?m)^\s*(CONTENTS|Contents)\s*$') OR (len(regexp_extract_all(text, '(?m)^\s*\d{1,3}[A-Z]?\.\s+[A-Z]')) >= 8 AND len(regexp_extract_all(text, '\b(shall|may|must|will)\b')) <= 3) AS contents,
 len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*\d{1,3}[A-Z]?\.\s*\S'))) AS entries FROM
 (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1. Aim.' || chr(10) || 'Contents' || chr(10) ELSE '' END || text AS text FROM documents)""")
def contents_tables(t: Tables) -> DataFrame:
    """Every third text is given the header of a table of contents and an entry."""
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "1. Aim.\nContents\n").otherwise(""), F.col("text"))
    return t.documents.select("doc_id", text.alias("text")).select("doc_id", C.has_contents(F.col("text")).alias("contents"), F.size(C.contents_entries(F.col("text"))).cast("long").alias("entries"))


@query("joined_words", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS x FROM documents), v AS (SELECT w, count(*) AS n FROM (SELECT unnest(x) AS w FROM w) GROUP BY 1),
 b AS (SELECT doc_id, CAST(i - 1 AS INT) AS place, x[i] AS word, x[i + 1] AS following FROM (SELECT doc_id, x, unnest(range(1, len(x))) AS i FROM w))
 SELECT doc_id, place, word, following, word || following AS joined FROM b JOIN v j ON j.w = word || following JOIN v p ON p.w = word JOIN v q ON q.w = following WHERE j.n >= 10 AND j.n > greatest(p.n, q.n)""")
def joined_words(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    vocabulary = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return C.joined_words(J.bigrams(words, "doc_id", F.col("w")), "doc_id", vocabulary)


@query("quote_found", r"""SELECT conv_id, turn, len(list_filter(string_split(trim(regexp_replace(q, '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')) >= 3 AS found FROM (SELECT conv_id, turn, substr(text, 5, 30) AS q FROM conversations) WHERE NOT contains(q, '...') AND NOT contains(q, '…')""")
def quote_found(t: Tables) -> DataFrame:
    """A quote cut from its own text is always there, if it has three words."""
    quote = F.substring("text", 5, 30)
    rows = t.conversations.where(~F.contains(quote, F.lit("...")) & ~F.contains(quote, F.lit("…")))
    return rows.select("conv_id", "turn", K.quote_found(quote, F.col("text")).alias("found"))


@query("figures", """SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS amount, 'year' AS unit FROM lineitem WHERE l_quantity <> 25 UNION ALL SELECT l_orderkey, l_linenumber, 25, 'year' FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, l_orderkey, 'rupee' FROM lineitem""")
def figures(t: Tables) -> DataFrame:
    text = F.concat_ws(" ", F.lit("for"), F.col("l_quantity").cast("int").cast("string"), F.lit("to twenty-five years and Rs."), F.col("l_orderkey").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.explode(K.figures(text)).alias("f")).select("l_orderkey", "l_linenumber", "f.amount", "f.unit")


@query("reference_lists", "SELECT l_orderkey, l_linenumber, array_to_string(CASE WHEN s BETWEEN 1 AND 30 THEN list_transform(range(a, a + s + 1), lambda x: x::VARCHAR) ELSE [a::VARCHAR, (a + s)::VARCHAR] END, ',') AS numbers FROM (SELECT l_orderkey, l_linenumber, l_partkey % 90 + 1 AS a, l_suppkey % 40 + 1 AS s FROM lineitem)")
def reference_lists(t: Tables) -> DataFrame:
    a, s = F.col("l_partkey") % 90 + 1, F.col("l_suppkey") % 40 + 1
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(K.expanded_numbers(F.concat(a.cast("string"), F.lit("-"), (a + s).cast("string"))), ",").alias("numbers"))


@query("citation_markers", "SELECT conv_id, '[' || (turn + 1) || '][' || (turn + 2) || ']' AS marks, turn + 2 > 3 AS bad FROM conversations")
def citation_markers(t: Tables) -> DataFrame:
    said = F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit(", "), (F.col("turn") + 2).cast("string"), F.lit("]"))
    return t.conversations.select("conv_id", K.single_markers(said).alias("marks"), (F.size(K.bad_markers(K.single_markers(said), F.lit(3))) > 0).alias("bad"))


@query("grounded_references", "SELECT DISTINCT l_orderkey, l_partkey AS number FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_name), left(lower(p_name), 3)) AND contains(lower(p_name), 'a')")
def grounded_references(t: Tables) -> DataFrame:
    refs = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("number"), F.array(F.lit("A")).alias("words"))
    return K.grounded(refs, t.part.select(F.col("p_partkey").alias("number"), F.col("p_name").alias("owner"))).select("l_orderkey", "number")


@query("absences_contradicted", """WITH w AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS d FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS x FROM documents)),
 a AS (SELECT doc_id, i FROM w WHERE d IN ('than', 'thans')), b AS (SELECT doc_id, i FROM w WHERE d IN ('of', 'ofs')) SELECT DISTINCT a.doc_id FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 40""")
def absences_contradicted(t: Tables) -> DataFrame:
    claims = t.documents.select("doc_id", F.lit("no than of").alias("claim"), F.array(F.lit("than"), F.lit("of")).alias("words"))
    return K.absences_contradicted(claims, t.documents, "doc_id").select("doc_id")


@query("clause_compliance", """SELECT doc_id, clause, bool_or(contains(lower(text), keyword)) AS present, min_by(keyword, ord) FILTER (contains(lower(text), keyword)) AS keyword
 FROM documents, (VALUES ('a', 'the', 1), ('a', 'and', 2), ('b', 'token', 1), ('b', 'license', 2)) r(clause, keyword, ord) GROUP BY ALL""")
def clause_compliance(t: Tables) -> DataFrame:
    rows = [("a", "the", 1), ("a", "and", 2), ("b", "token", 1), ("b", "license", 2)]
    rules = t.spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(c).alias("clause"), F.lit(k).alias("keyword"), F.lit(o).alias("ord")) for c, k, o in rows))).alias("r")).select("r.*")
    return K.clause_report(t.documents, rules, "doc_id")


@query("dedupe_first", r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))")
def dedupe_first(t: Tables) -> DataFrame:
    return D.first_by_hash(t.documents, "doc_id").select("doc_id")


WORD_SETS = "w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS ws FROM documents), c AS (SELECT min(doc_id) AS id, ws FROM w WHERE len(ws) > 0 GROUP BY ws)"


@query("jaccard_pairs", f"WITH {WORD_SETS} SELECT a, b, round(n / (la + lb - n), 6) AS overlap FROM (SELECT x.id AS a, y.id AS b, len(x.ws) AS la, len(y.ws) AS lb, len(list_intersect(x.ws, y.ws)) AS n FROM c x JOIN c y ON x.id < y.id AND least(len(x.ws), len(y.ws)) >= 0.85 * greatest(len(x.ws), len(y.ws))) WHERE n / (la + lb - n) >= 0.85")
def jaccard_pairs(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return D.jaccard_pairs(t.documents, "doc_id", words).select("a", "b", F.round("overlap", 6).alias("overlap"))


@query("word_set_classes", "WITH w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS ws FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY ws) AS class_id FROM w")
def word_set_classes(t: Tables) -> DataFrame:
    return D.class_ids(t.documents, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))


@query("fuzzy_titles")
def fuzzy_titles(t: Tables) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type")
    asked = t.part.select(F.col("p_partkey").alias("id"), F.regexp_replace(name, "a", "e").alias("title"))
    return D.fuzzy_titles(asked, t.part.select(F.col("p_partkey").alias("held_id"), name.alias("title")))


@query("ocr_repaired")
def ocr_repaired(t: Tables) -> DataFrame:
    """Texts with torn words joined, until nothing more can be joined; the vocabulary is that of all texts."""
    from corpusloom.operators import repair

    docs = t.documents.select("doc_id", F.col("text").alias("text"), F.length("text").alias("before"))
    found = repair.repaired(docs, "doc_id", repair.vocabulary(docs))
    return found.select("doc_id", (F.col("before") - F.length("text")).cast("long").alias("joined"), F.sha2("text", 256).alias("digest"))


@query("sections_in_sql", """SELECT c_custkey, 1::BIGINT AS seq, c_custkey::VARCHAR AS section, c_name AS heading, c_mktsegment AS text FROM customer
 UNION ALL SELECT c_custkey, 2, 'B', 'More', 'end of ' || c_nationkey FROM customer WHERE c_custkey % 3 > 0""")
def sections_in_sql(t: Tables) -> DataFrame:
    """The table function of sections, called from SQL over a table."""
    from corpusloom.functions import tables

    tables.register(t.spark)
    more = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("\nPart II\nSection B: More\nend of "), F.col("c_nationkey").cast("string"))).otherwise("")
    text = F.concat(F.lit("Head\nSection "), F.col("c_custkey").cast("string"), F.lit(" - "), F.col("c_name"), F.lit("\n"), F.col("c_mktsegment"), more)
    t.customer.select("c_custkey", text.alias("text")).createOrReplaceTempView("printed_customers")
    return t.spark.sql("SELECT * FROM section_rows(TABLE(printed_customers), 'c_custkey', 'text')")
