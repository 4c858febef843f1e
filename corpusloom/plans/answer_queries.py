"""Queries over answers, citations and metadata: the texts they read are written from rows of the tables first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import metadata as M, text as T
from corpusloom.operators import answers as A, checks as K, chunking as C, citations as Z, filters, joins as J, retrieval as R, windows as W
from corpusloom.plans.registry import Tables, query

said = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
text_of = lambda c: F.col(c).cast("string")


# Citations and their removal

CASES = "PLD 19' || (60 + o_orderkey % 40) || ' SC ' || o_custkey || '"


@query("cases_removed", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Rent is due. It was held in {CASES} that it lapses. Notice is given.' ELSE 'Rent is due. [case citation removed] Notice is given.' END || chr(10)
 || CASE WHEN o_orderkey % 3 = 0 THEN '| rule | {CASES} | yes |' ELSE '| rule | [case citation removed] | yes |' END AS text FROM orders""")
def cases_removed(t: Tables) -> DataFrame:
    """Every third answer's passages hold the report that it cites."""
    cite = said("PLD 19", (60 + F.col("o_orderkey") % 40).cast("string"), " SC ", text_of("o_custkey"))
    answers = t.orders.select("o_orderkey", said("Rent is due. It was held in ", cite, " that it lapses. Notice is given.\n| rule | ", cite, " | yes |").alias("text"))
    passages = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, said("see  ", cite, ".")).otherwise("nothing").alias("text"))
    return Z.without_unbacked_cases(answers, passages, "o_orderkey").select("o_orderkey", "text")


@query("cases_kept", "SELECT c_custkey, c_custkey % 4 = 0 AS removed FROM customer")
def cases_kept(t: Tables) -> DataFrame:
    """A case that was retrieved under a longer name, or by its number, stays; every fourth is another one."""
    other = F.col("c_custkey") % 4 == 0
    name = F.when(F.col("c_custkey") % 2 == 0, "Karim Baksh v. Zeenat Bibi").otherwise("Civil Appeal No. 12 of 1999")
    answers = t.customer.select("c_custkey", said("So it was in ", name, ", and it stands.").alias("text"))
    cases = t.customer.select("c_custkey", F.lit("k").alias("case_id"), F.when(other, "Mst. Nasreen v. Federation").otherwise("Haji Karim Baksh and another v. Mst. Zeenat Bibi").alias("name"), F.array(F.lit("12")).alias("numbers"), F.lit("1999").alias("year"), F.lit(3).alias("paragraph"))
    found = Z.without_unbacked_cases(answers, answers.select("c_custkey", F.lit("x").alias("text")).limit(0), "c_custkey", cases)
    return found.select("c_custkey", F.col("removed").isNotNull().alias("removed"))


@query("paragraphs_wrong", "SELECT c_custkey, CASE WHEN c_custkey % 30 <> 3 THEN (c_custkey % 30)::VARCHAR || ',' ELSE '' END || '7' AS wrong FROM customer")
def paragraphs_wrong(t: Tables) -> DataFrame:
    answers = t.customer.select("c_custkey", said("Karim Baksh v. Zeenat Bibi, paras ", (F.col("c_custkey") % 30).cast("string"), " and 7, says so.\nPara 9 of nothing.").alias("text"))
    cases = t.customer.select("c_custkey", F.lit("k").alias("case_id"), F.lit("Karim Baksh v. Zeenat Bibi").alias("name"), F.array(F.lit("12")).alias("numbers"), F.lit("1999").alias("year"), F.lit(3).alias("paragraph"))
    return Z.wrong_paragraphs(answers, cases, "c_custkey").select("c_custkey", F.array_join(F.transform("wrong", lambda x: x.cast("string")), ",").alias("wrong"))


@query("consequences_unstated", "SELECT p_partkey, 'void' AS consequence FROM part WHERE p_size % 2 = 1 UNION ALL SELECT p_partkey, 'forfeiture' FROM part WHERE p_size % 3 > 0")
def consequences_unstated(t: Tables) -> DataFrame:
    answers = t.part.select("p_partkey", F.lit("The sale is void and leads to forfeiture under the Death Duties Act, 1950.").alias("text"))
    passages = t.part.select("p_partkey", F.concat_ws(" ", F.when(F.col("p_size") % 2 == 0, "Such a sale is Void."), F.when(F.col("p_size") % 3 == 0, "Goods shall be forfeited."), F.lit("End.")).alias("text"))
    return Z.unstated_consequences(answers, passages, "p_partkey")


@query("figures_misattributed", "SELECT p_partkey, p_size + 2 AS amount, '9' AS numbers FROM part WHERE p_size % 5 <> 0")
def figures_misattributed(t: Tables) -> DataFrame:
    """A period given for section 9; the text of section 9 states it for every fifth part, that of section 12 for all."""
    years = (F.col("p_size") + 2).cast("string")
    answers = t.part.select("p_partkey", said("Section 9 gives ", years, " years. Other words follow.").alias("text"))
    nine = t.part.select("p_partkey", F.lit("9").alias("number"), F.when(F.col("p_size") % 5 == 0, said("up to ", years, " years")).otherwise("no term").alias("text"))
    twelve = t.part.select("p_partkey", F.lit("12").alias("number"), said("up to ", years, " years").alias("text"))
    found = Z.misattributed_figures(answers, nine.unionByName(twelve), "p_partkey")
    return found.select("p_partkey", F.col("figure.amount").alias("amount"), F.array_join("numbers", ",").alias("numbers"))


@query("mentions_unsupported", r"""WITH t AS (SELECT *, o_orderkey AS k, o_custkey % 900 + 1 AS s, strftime(o_orderdate, '%-d/%-m/%Y') AS d FROM orders),
 o AS (SELECT *, concat_ws(' ', 'Order.', CASE WHEN k % 2 > 0 THEN 'Dated ' || d END, CASE WHEN k % 3 > 0 THEN 'in No. ' || o_custkey || '-P/98' END, CASE WHEN k % 4 > 0 THEN 'FIR ' || (k + 7) END,
   CASE WHEN k % 5 > 0 THEN 'u/s ' || s || ' PPC' END, CASE WHEN k % 7 > 0 THEN 'by IMRAN  AHMED' END, 'end') AS held,
   concat_ws(' | ', CASE WHEN k % 11 = 0 THEN d END, CASE WHEN k % 13 = 0 THEN 'No. ' || o_custkey || ' of 1998' END, CASE WHEN k % 17 = 0 THEN 'Imran Ahmed' END) AS ents FROM t)
 SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT contains(held || ents, d) THEN strftime(o_orderdate, '%Y-%m-%d') END,
   CASE WHEN NOT regexp_matches(held, '\b' || o_custkey || '\b.{0,25}?(?:\d\d)?98\b') AND NOT regexp_matches(ents, '\b' || o_custkey || '\b.{0,25}?(?:\d\d)?98\b') THEN 'Petition No. ' || o_custkey || ' of 1998' END,
   CASE WHEN NOT contains(held, 'FIR') THEN 'FIR ' || (k + 7) END, CASE WHEN NOT regexp_matches(held, '\D' || s || '\D') THEN 'section ' || s END], lambda x: x IS NOT NULL), ';') AS missing,
 CASE WHEN contains(held, 'IMRAN') OR contains(ents, 'Imran') THEN '' ELSE 'Imran Ahmed' END AS names FROM o""")
def mentions_unsupported(t: Tables) -> DataFrame:
    """Each mention stands in the document or not by its own divisor of the key; entities back some that don't. Any figure backs a section."""
    key, day, number = F.col("o_orderkey"), F.date_format("o_orderdate", "d/M/yyyy"), text_of("o_custkey")
    report, section = (key + 7).cast("string"), (F.col("o_custkey") % 900 + 1).cast("string")
    asked = said("Whether Imran Ahmed was heard on ", day, " in Petition No. ", number, " of 1998 after F.I.R. No. ", report, " under section ", section, " of the Penal Code.")
    items = t.orders.select("o_orderkey", F.lit(1).alias("item"), asked.alias("text"))
    unless = lambda n, *parts: F.when(key % n != 0, said(*parts))
    held = F.concat_ws(" ", F.lit("Order."), unless(2, "Dated ", day), unless(3, "in No. ", number, "-P/98"), unless(4, "FIR ", report), unless(5, "u/s ", section, " PPC"), unless(7, "by IMRAN  AHMED"), F.lit("end"))
    only = lambda n, *parts: F.when(key % n == 0, said(*parts))
    entities = F.array_compact(F.array(only(11, day), only(13, "No. ", number, " of 1998"), only(17, "Imran Ahmed")))
    found = Z.unsupported_mentions(items, t.orders.select("o_orderkey", held.alias("text"), entities.alias("entities")), "o_orderkey")
    return found.select("o_orderkey", F.array_join("missing", ";").alias("missing"), F.array_join("names", ";").alias("names"))


@query("reasoning_report", """SELECT user_id, count(*) FILTER (event_type = 'view' OR event_type = 'click') AS kept, count(*) FILTER (event_type = 'click') AS flagged,
 count(*) FILTER (event_type NOT IN ('view', 'click')) AS no_quote, count(*) FILTER (event_type = 'error') AS no_date FROM events GROUP BY 1""")
def reasoning_report(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    reasons = F.filter(F.array(F.when(~kind.isin("view", "click"), "quote"), F.when(kind == "error", "date")), lambda x: x.isNotNull())
    checked = t.events.select("user_id", reasons.alias("dropped_for"), F.when(kind == "click", F.array(F.lit("A B"))).otherwise(F.array().cast("array<string>")).alias("names"))
    n = lambda c: F.coalesce(F.try_element_at("dropped", F.lit(c)), F.lit(0)).cast("long")
    return Z.reasoning_report(checked, "user_id").select("user_id", "kept", "flagged", n("quote").alias("no_quote"), n("date").alias("no_date"))


@query("entities_corrected", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'caseno' ELSE 'appealcaseno' END AS number_type, 'Tahir Khan' AS person FROM orders")
def entities_corrected(t: Tables) -> DataFrame:
    """A case number before the heading's end is the document's own; a name that begins with another line's "KP" loses it."""
    heading = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("ORDER\n")
    number = said("Criminal Petition No. ", text_of("o_orderkey"))
    docs = t.orders.select("o_orderkey", said("IN COURT\n", heading, number, "\nAgainst the judgment of the High Court\nMr. Altaf, AAG KP\nTahir Khan\nSI").alias("text"))
    at = lambda c: F.position(c, F.col("text")) - 1
    found = docs.select("o_orderkey", F.explode(F.array(F.struct(F.lit("appealcaseno").alias("type"), at(number).alias("start"), (at(number) + F.length(number)).alias("stop")), F.struct(F.lit("person").alias("type"), at(F.lit("KP\n")).alias("start"), F.length("text").alias("stop")))).alias("e")).select("o_orderkey", "e.*")
    fixed = Z.without_line_break_abbreviations(Z.own_case_numbers(found, docs, "o_orderkey"), docs, "o_orderkey").join(docs, "o_orderkey")
    surface = F.substr("text", F.col("start") + 1, F.col("stop") - F.col("start"))
    return fixed.groupBy("o_orderkey").agg(F.max(F.when(F.col("type") != "person", F.col("type"))).alias("number_type"), F.max(F.when(F.col("type") == "person", surface)).alias("person"))


@query("citation_report", "SELECT p_partkey, CASE WHEN p_size > 3 THEN '4' ELSE '' END AS bad_markers, CASE WHEN p_size % 2 = 0 THEN '12' END AS unbacked, CASE WHEN p_size % 3 = 0 THEN 7 END AS figure FROM part")
def citation_report(t: Tables) -> DataFrame:
    answers = t.part.select("p_partkey", said("Section 12 of the Goods Act gives 7 years [1]", F.when(F.col("p_size") > 3, "[4]").otherwise("[2]"), ".").alias("text"), F.lit(3).alias("sources"))
    passages = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "13").otherwise("12").alias("number"), F.lit("The Goods Act, 1950").alias("owner"), F.when(F.col("p_size") % 3 == 0, "no term").otherwise("for seven years").alias("text"))
    found = A.citation_report(answers, passages, "p_partkey")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("p_partkey", joined("bad_markers").alias("bad_markers"), joined("unbacked").alias("unbacked"), F.get("unnamed_figures", F.lit(0))["amount"].alias("figure"))


@query("section_references", "SELECT l_orderkey, l_linenumber, (l_partkey % 400 + 1) || 'A' || CASE WHEN l_suppkey + 1 <= 9999 THEN ',' || (l_suppkey + 1) ELSE '' END AS numbers, 'Goods Act, 1950' AS law FROM lineitem")
def section_references(t: Tables) -> DataFrame:
    """A number of more than four figures is no section's."""
    text = said("under section ", (F.col("l_partkey") % 400 + 1).cast("string"), "-a(2) of the Goods Act, 1950 and s. ", (F.col("l_suppkey") + 1).cast("string"), " too")
    refs = A.section_references(text)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(F.transform(refs, lambda r: r["number"]), ",").alias("numbers"), F.get(refs, F.lit(0))["law"].alias("law"))


@query("acts_named", "SELECT p_partkey, upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' Goods Act, 19' || (40 + p_size) || ';Sale of Land Ordinance' AS acts, 'what is due?' AS unasked FROM part")
def acts_named(t: Tables) -> DataFrame:
    first = F.initcap(F.substring_index("p_name", " ", 1))
    year = (F.col("p_size") + 40).cast("string")
    text = said("by the ", first, " Goods Act, 19", year, " and the Sale of Land Ordinance, if any")
    question = said("what is due under section 4 of the ", first, " Goods Act, 19", year, "?")
    return t.part.select("p_partkey", F.array_join(K.act_names(text), ";").alias("acts"), F.regexp_replace(K.without_acts(question, F.lit("what is due")), r"\s*under\s*", "").alias("unasked"))


@query("answers_renumbered", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '[1] a [2] b [1]' ELSE '[1] a [1]' END AS renumbered FROM conversations")
def answers_renumbered(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "[3] a [1] b [3]").otherwise("[2] a [2]").alias("text"))
    return A.renumbered(rows, "turn").select("conv_id", "turn", "renumbered")


@query("replies_merged", """WITH p AS (SELECT user_id, event_id AS part, CASE WHEN event_type <> 'view' THEN event_type END AS k, event_type AS point FROM events),
 f AS (SELECT user_id, point, min(part) AS first FROM p GROUP BY ALL) SELECT user_id, any_value(a) AS type, any_value(z) AS outcome, string_agg(point, ',' ORDER BY first) AS points FROM f JOIN (SELECT user_id, min_by(k, part) FILTER (k IS NOT NULL) AS a, max_by(k, part) FILTER (k IS NOT NULL) AS z FROM p GROUP BY 1) USING (user_id) GROUP BY 1""")
def replies_merged(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    parts = t.events.select("user_id", F.col("event_id").alias("part"), kind.alias("type"), kind.alias("outcome"), F.array("event_type", "event_type").alias("points"))
    return A.merged_replies(parts, "user_id").select("user_id", "type", "outcome", F.array_join("points", ",").alias("points"))


@query("repealed_notes", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'repeal') THEN text ELSE coalesce(text, '') || chr(10) || chr(10) || 'Note.' END AS answer FROM conversations WHERE text IS NOT NULL")
def repealed_notes(t: Tables) -> DataFrame:
    return t.conversations.where("text is not null").select("conv_id", "turn", K.repealed_note(F.col("text"), "Note.").alias("answer"))


# Retrieval for a chat

VEC = "(SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]"
HITS = f"h AS (SELECT vec_id, label, list_inner_product(embedding::DOUBLE[], {VEC}) AS s FROM embeddings)"


def _hits(t: Tables) -> DataFrame:
    question = [float(x) for x in t.embeddings.where("vec_id = 0").select("embedding").first()[0]]
    return R.vector_scores(t.embeddings, question).select("vec_id", "label", "score")


@query("chat_hits", f"WITH {HITS} SELECT label, vec_id FROM h WINDOW w AS (PARTITION BY label) QUALIFY (max(s) OVER w >= 0.45 AND s >= 0.35) OR (max(s) OVER w < 0.45 AND s >= 0.40)")
def chat_hits(t: Tables) -> DataFrame:
    return A.chat_hits(_hits(t).withColumnRenamed("score", "relevance"), "label", 0.45, 0.35, 0.40).select("label", "vec_id")


@query("chat_neighbours", "WITH h AS (SELECT doc_id AS q, doc_id // 40 AS law, doc_id % 40 AS seq, CASE WHEN doc_id % 3 = 0 THEN 'repealed' ELSE 'in force' END AS status FROM documents) SELECT DISTINCT a.q, b.law, b.seq FROM h a JOIN h b ON b.law = a.law AND abs(b.seq - a.seq) = 1 WHERE b.status <> 'repealed' OR a.status = 'repealed'")
def chat_neighbours(t: Tables) -> DataFrame:
    """The sections next to each hit in its law; a repealed one only beside a repealed one."""
    status = F.when(F.col("doc_id") % 3 == 0, "repealed").otherwise("in force")
    sections = t.documents.select(F.floor(F.col("doc_id") / 40).alias("law"), (F.col("doc_id") % 40).alias("seq"), status.alias("status")).distinct()
    hits = t.documents.select(F.col("doc_id").alias("q"), F.floor(F.col("doc_id") / 40).alias("law"), (F.col("doc_id") % 40).alias("seq"), status.alias("status"), F.lit(1).alias("rank"))
    return A.with_neighbours(hits, sections, "q").select("q", "law", "seq").distinct()


@query("sections_expanded", "WITH g AS (SELECT user_id, event_type AS k, min(event_id) AS rank FROM events GROUP BY ALL), h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank, k) <= 2) SELECT user_id, k, left(repeat(k || ' ', 20), 30) AS text FROM h")
def sections_expanded(t: Tables) -> DataFrame:
    hits = t.events.select("user_id", F.col("event_type").alias("k"), F.col("event_id").alias("rank"))
    sections = t.events.select(F.col("event_type").alias("k")).distinct().withColumn("text", F.repeat(F.concat("k", F.lit(" ")), F.lit(20)))
    return A.expanded_sections(hits, sections, "user_id", "k", 2, 30).select("user_id", "k", "text")


@query("family_windows", f"WITH {HITS} SELECT label, round(max(s), 6) AS score FROM h WHERE label IN (1, 2, 5) AND (label <> 5 OR vec_id % 2 = 0) GROUP BY 1")
def family_windows(t: Tables) -> DataFrame:
    """Score of each allowed law (label) by its best window (vector); of a gated one only some windows count."""
    gated = _hits(t).where("label in (1, 2, 5) and (label <> 5 or vec_id % 2 = 0)")
    return R.best_per(gated, "label", [F.desc("score"), F.asc("vec_id")]).select("label", F.round("score", 6).alias("score"))


@query("case_passages", f"WITH {HITS}, d AS (SELECT h.*, text FROM h JOIN documents ON doc_id = vec_id) SELECT label, vec_id FROM d WHERE s >= 0.2 AND length(text) >= 300 QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) <= 3")
def case_passages(t: Tables) -> DataFrame:
    """Passages over a floor of score and length, the best three of each case (label)."""
    with_text = _hits(t).join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return R.best_per(with_text.where((F.col("score") >= 0.2) & (F.length("text") >= 300)), "label", [F.desc("score"), F.asc("vec_id")], 3).select("label", "vec_id")


@query("hints_fired", "SELECT doc_id, contains(' ' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' ', ' the ') AND contains(' ' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' ', ' and ') AND NOT contains(' ' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' ', ' than ') AS fired FROM documents WHERE text IS NOT NULL")
def hints_fired(t: Tables) -> DataFrame:
    words = t.documents.where("text is not null").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))
    hints = t.spark.range(1).select(F.array(F.array(F.lit("the"), F.lit("and"))).alias("triggers"), F.array(F.lit("than")).alias("unless"), F.lit("x").alias("terms"))
    fired = R.hint_terms(F.col("words"), words.crossJoin(F.broadcast(hints))).select("doc_id", F.lit(True).alias("fired"))  # hints are a short list
    return words.select("doc_id").join(fired.distinct(), "doc_id", "left").select("doc_id", F.coalesce("fired", F.lit(False)).alias("fired"))


@query("audience_gate", "SELECT p_partkey FROM part WHERE p_brand <> 'Brand#2' OR contains('what of small ring goods', lower(p_name))")
def audience_gate(t: Tables) -> DataFrame:
    hits = t.part.select("p_partkey", F.when(F.col("p_brand") == "Brand#2", "special").alias("audience"), F.col("p_name").alias("title"))
    return filters.audience_gate(hits, "What of small ring goods", {"special": ["nothing"]}).select("p_partkey")


@query("foreign_gate", "SELECT n_name, n_nationkey % 3 = 0 AND n_nationkey % 2 = 1 AS foreign_only FROM nation")
def foreign_gate(t: Tables) -> DataFrame:
    asked = said("What is the law on ", F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, " in India").otherwise(" here"), F.when(F.col("n_nationkey") % 2 == 0, " and in Pakistan?").otherwise("?"))
    return t.nation.select("n_name", M.foreign_only(asked).alias("foreign_only"))


# Lookups

@query("exact_sections", "WITH r AS (SELECT p_brand AS title, p_size::VARCHAR || 'A' AS number, min(p_partkey) AS seq FROM part GROUP BY ALL) SELECT q.o_orderkey AS question, seq, row_number() OVER (PARTITION BY q.o_orderkey ORDER BY place, seq) AS rank FROM (SELECT o_orderkey, 'Brand#' || (o_custkey % 25 + 1) AS title, o_custkey % 50 || 'A' AS number, 0 AS place FROM orders) q JOIN r USING (title, number) QUALIFY rank <= 2".replace("row_number() OVER (PARTITION BY q.o_orderkey ORDER BY place, seq) AS rank", "CAST(row_number() OVER (PARTITION BY q.o_orderkey ORDER BY place, seq) AS INT) AS rank"))
def exact_sections(t: Tables) -> DataFrame:
    records = t.part.select(F.col("p_brand").alias("title"), said(text_of("p_size"), "-a").alias("section"), F.col("p_partkey").alias("seq"))
    refs = t.orders.select(F.col("o_orderkey").alias("question"), said("Brand#", (F.col("o_custkey") % 25 + 1).cast("string")).alias("title"), said((F.col("o_custkey") % 50).cast("string"), " A").alias("number"), F.lit(0).alias("place"))
    return J.exact_sections(refs, records).select("question", "seq", "rank")


@query("nearest_owners", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'after' WHEN o_orderkey % 3 = 1 THEN 'before' ELSE 'near' END AS owner FROM orders")
def nearest_owners(t: Tables) -> DataFrame:
    """A number belongs to the law right behind it, else to the one right before it, else to the nearest."""
    numbers = t.orders.select("o_orderkey", F.lit(100).alias("start"), F.lit(103).alias("stop"))
    span = lambda name, a, b: F.struct(F.lit(name).alias("owner"), F.lit(a).alias("start"), F.lit(b).alias("stop"))
    spans = F.when(F.col("o_orderkey") % 3 == 0, F.array(span("after", 106, 120), span("before", 80, 98))).when(F.col("o_orderkey") % 3 == 1, F.array(span("after", 120, 130), span("before", 80, 98))).otherwise(F.array(span("near", 115, 130), span("far", 10, 60)))
    owners = t.orders.select("o_orderkey", F.explode(spans).alias("s")).select("o_orderkey", "s.*")
    return J.nearest_owner(numbers, owners, "o_orderkey").select("o_orderkey", "owner")


@query("laws_named", "SELECT o_orderkey, n_name || ' Goods Tax Act, 1950' AS title FROM orders JOIN nation ON n_nationkey = o_custkey % 40 UNION ALL SELECT o_orderkey, 'NATION_3 Goods Tax Act, 1950' FROM orders WHERE o_custkey % 40 >= 25".replace("n_name || ", "'NATION_' || n_nationkey || ").replace("NATION_3", "NATION_3"))
def laws_named(t: Tables) -> DataFrame:
    """Laws by the words of their titles; figures aren't words, so a nation's number is spelt in letters here."""
    spelt = lambda n: F.translate(n.cast("string"), "0123456789", "abcdefghij")
    laws = t.nation.select(said("The ", spelt(F.col("n_nationkey")), " Goods Tax Act, 1950").alias("title"), F.col("n_nationkey"))
    aliases = laws.where("n_nationkey = 3").select("title", F.lit(r"common\s+tax").alias("pattern"))
    key = F.col("o_custkey") % 40
    questions = t.orders.select("o_orderkey", F.when(key < 25, said("Is it due under the ", spelt(key), "  goods Tax act?")).otherwise("Is it a COMMON tax?").alias("question"))
    found = J.laws_named(questions, J.law_patterns(laws, aliases), "o_orderkey").join(laws, "title")
    return found.select("o_orderkey", said("NATION_", text_of("n_nationkey"), " Goods Tax Act, 1950").alias("title"))


# Facts from titles and texts

@query("titles_cleaned", """SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name || ' of the ' || p_type), ' '), lambda x, i: CASE WHEN i > 1 AND x IN ('of', 'the') THEN x ELSE upper(left(x, 1)) || substr(x, 2) END), ' ') AS title, 'Sale Goods Act, 19' || (40 + p_size) AS short, 1940 + p_size AS year, 'Act' AS kind FROM part""")
def titles_cleaned(t: Tables) -> DataFrame:
    listed = said(text_of("p_size"), ". ", F.upper("p_name"), " OF THE ", F.upper("p_type"), " [Repealed by Act IV].pdf")
    year = (F.col("p_size") + 40).cast("string")
    text = said("1. This law may be called the Sale Goods Act, 19", year, ". It comes next.")
    short = M.short_title(text)
    return t.part.select("p_partkey", M.clean_title(listed).alias("title"), short.alias("short"), M.year_of(short, text).alias("year"), M.document_type(short).alias("kind"))


@query("amendments_listed", "SELECT p_partkey, 'Sale of Goods Act, 19' || (40 + p_size) || ';Loan of Money Ordinance, 1984' AS amended_by FROM part")
def amendments_listed(t: Tables) -> DataFrame:
    text = said("Subs. by the Sale of Goods Act, 19", (F.col("p_size") + 40).cast("string"), ", s. 2. Ins. by Loan of Money Ordinance, 1984, s. 3; amended by the Sale of Goods Act, 19", (F.col("p_size") + 40).cast("string"))
    return t.part.select("p_partkey", F.array_join(M.amendments(text), ";").alias("amended_by"))


@query("judgment_facts", """SELECT o_orderkey, 'Karim Baksh v. Zeenat Bibi' AS parties, CASE WHEN o_orderkey % 2 = 0 THEN 'High Court' ELSE 'Supreme Court' END AS court, 'Civil Appeal No. ' || o_custkey || ' of 1999' AS number, 'Asif Khan;Omar A. Shah' AS judges, CASE WHEN o_orderkey % 3 = 0 THEN 'dower' ELSE '' END AS topics FROM orders""")
def judgment_facts(t: Tables) -> DataFrame:
    text = said("IN THE ", F.when(F.col("o_orderkey") % 2 == 0, "LAHORE HIGH COURT").otherwise("SUPREME COURT"), "\nPresent: Asif Khan, CJ. and Omar A. Shah, J.\nCivil Appeal No. ", text_of("o_custkey"), " of 1999\nKarim Baksh versus Zeenat Bibi\nThe dower was due.", F.when(F.col("o_orderkey") % 3 == 0, " Dower is a debt.").otherwise(""))
    return t.orders.select("o_orderkey", M.parties(text).alias("parties"), M.court(text).alias("court"), M.case_number(text).alias("number"), F.array_join(M.judges(text), ";").alias("judges"), F.array_join(M.topics(text, {"dower": r"\bdower\b", "rent": r"\brent\b"}), ";").alias("topics"))


@query("judgment_quality", "SELECT doc_id, CASE WHEN length(trim(text, ' ')) < 500 AND doc_id % 7 <> 0 THEN 'near-empty' WHEN doc_id % 7 = 0 THEN 'needs OCR' END AS problem FROM documents WHERE text IS NOT NULL")
def judgment_quality(t: Tables) -> DataFrame:
    empty = F.when(F.col("doc_id") % 7 == 0, 3).otherwise(0)
    return t.documents.where("text is not null").select("doc_id", M.judgment_quality(F.col("text"), F.lit(4), empty).alias("problem"))


@query("display_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'No. ' || c_custkey ELSE 'doc/' || c_custkey END AS name FROM customer")
def display_names(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("Order of the day")
    number = F.when(F.col("c_custkey") % 3 == 1, said("No. ", text_of("c_custkey")))
    return t.customer.select("c_custkey", M.display_name(name, number, said("doc/", text_of("c_custkey"))).alias("name"))


@query("section_keys", "SELECT l_orderkey, l_linenumber, l_partkey || 'AB' AS number, l_partkey AS n, 'AB' AS letters FROM lineitem")
def section_keys(t: Tables) -> DataFrame:
    raw = said(" ", text_of("l_partkey"), " - ab")
    return t.lineitem.select("l_orderkey", "l_linenumber", T.section_number(raw).alias("number"), T.section_sort_key(raw)["number"].cast("long").alias("n"), T.section_sort_key(raw)["letters"].alias("letters"))


@query("preambles", "SELECT p_partkey, 'WHEREAS it is fit to regulate ' || p_name || ';' AS preamble FROM part")
def preambles(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", M.preamble(said("THE ACT\nWHEREAS it is fit to regulate ", F.col("p_name"), ";\n 1. Short title.")).alias("preamble"))


@query("prose_paragraphs", r"""SELECT doc_id, n >= 25 AND marks < 2 AND cited * 8 < n AS prose FROM (SELECT doc_id, len(regexp_extract_all(text, '\b[a-z]{2,}\b')) AS n,
 len(regexp_extract_all(text, '\b(?:PLD|SCMR|CLC|YLR)\b')) AS cited, len(regexp_extract_all(left(text, 400), '(?i)\b(?:versus|petitioner|respondent|date of hearing|for the)\b')) AS marks FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[a-zA-Z \n.,]*'))""")
def prose_paragraphs(t: Tables) -> DataFrame:
    """On plain texts words, reports and marks of a heading decide; brackets and footnotes have tests of their own."""
    plain = t.documents.where(F.col("text").rlike(r"^[a-zA-Z \n.,]*\z"))
    return plain.select("doc_id", M.prose(F.col("text")).alias("prose"))


@query("labelled_parts", "SELECT conv_id, turn, 'q' || turn AS issue, 'held ' || conv_id AS findings FROM conversations")
def labelled_parts(t: Tables) -> DataFrame:
    text = said("**Issue:** q", text_of("turn"), "\n## Findings\nheld ", text_of("conv_id"), "\n\nIssue: again")
    found = M.labelled(text, ["Issue", "Findings"])
    return t.conversations.select("conv_id", "turn", F.try_element_at(found, F.lit("issue")).alias("issue"), F.try_element_at(found, F.lit("findings")).alias("findings"))


@query("summary_parts", "SELECT p_partkey, 'Key clauses' AS heading, p_name || '; pays ' || p_size AS lines FROM part")
def summary_parts(t: Tables) -> DataFrame:
    text = said("Intro\n1. **Key clauses:**\n- ", F.col("p_name"), "\n| pays ", text_of("p_size"), " |\n|---|\n2. Risks\nnone")
    parts = K.summary_sections(text)
    return t.part.select("p_partkey", F.get(parts, F.lit(0))["heading"].alias("heading"), F.array_join(F.get(parts, F.lit(0))["lines"], "; ").alias("lines"))


@query("dates_unsupported", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderdate <> TIMESTAMP '2001-04-03' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS dates FROM orders")
def dates_unsupported(t: Tables) -> DataFrame:
    claim = said("filed on ", F.date_format("o_orderdate", "d MMMM yyyy"), " and 3.4.2001")
    source = said("3 April 2001", F.when(F.col("o_orderkey") % 2 == 1, said(", ", F.date_format("o_orderdate", "dd/MM/yyyy"))).otherwise(""))
    day = lambda d: F.concat_ws("-", d["year"].cast("string"), F.lpad(d["month"].cast("string"), 2, "0"), F.lpad(d["day"].cast("string"), 2, "0"))
    return t.orders.select("o_orderkey", F.array_join(F.transform(K.unsupported_dates(claim, source), day), ",").alias("dates"))


@query("json_replies", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_replies(t: Tables) -> DataFrame:
    reply = said("Here it is:\n```json\n", F.col("props"), "\n```\nDone.")
    return t.events.select("event_id", F.variant_get(T.json_object(reply), "$.k", "long").alias("k"))


@query("input_fingerprints", """SELECT p_partkey, sha256('["' || p_partkey || '","' || p_name || '"]') AS print FROM part""")
def input_fingerprints(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.fingerprint(F.col("p_partkey"), F.col("p_name")).alias("print"))


@query("statute_words", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) > 1))), ' ') AS words FROM part")
def statute_words(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(K.statute_words(said("The ", F.col("p_name"), " Act, 1950, s. 4")), " ").alias("words"))


@query("ocr_error_rate", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS x FROM documents), v AS (SELECT w, count(*) AS n FROM (SELECT unnest(x) AS w FROM w) GROUP BY 1),
 b AS (SELECT doc_id, x[i] AS a, x[i + 1] AS c FROM w, (SELECT unnest(range(1, (SELECT max(len(x)) FROM w))) AS i) WHERE i < len(x)),
 s AS (SELECT doc_id, count(*) AS split FROM b JOIN v j ON j.w = a || c JOIN v p ON p.w = a JOIN v q ON q.w = c WHERE j.n >= 10 AND j.n > greatest(p.n, q.n) GROUP BY 1)
 SELECT doc_id, round(10000 * coalesce(split, 0) / len(x), 1) AS rate FROM w LEFT JOIN s USING (doc_id) WHERE len(x) > 0""")
def ocr_error_rate(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    vocabulary = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return C.ocr_errors(words, "doc_id", vocabulary).select("doc_id", "rate")


@query("pilot_selection", "SELECT doc_id FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 40")
def pilot_selection(t: Tables) -> DataFrame:
    """Favoured rows first; with as many as are asked for, that is all (rounds and names have a test against brute force)."""
    rows = t.labels.select("doc_id", F.col("toxic").alias("weight"), (F.col("doc_id") % 7).alias("group"), F.array((F.col("doc_id") % 11).cast("string")).alias("names"))
    return W.pilot(rows, "doc_id", min(40, t.labels.where("toxic = 1").count())).select("doc_id")


@query("embedding_backlog", "SELECT count(DISTINCT text) AS missing FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def embedding_backlog(t: Tables) -> DataFrame:
    """What a resumed run has still to embed."""
    from corpusloom.sources import sinks

    cache = t.documents.where("doc_id % 3 = 0").select(sinks.cache_key("mini", F.col("text")).alias("key"))
    return sinks.cache_misses(t.documents.where("text is not null"), cache, "mini").agg(F.countDistinct("key").alias("missing"))
