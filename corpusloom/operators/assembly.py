"""Records of statutes and judgments put together from a source's listing and a text, or put aside with the first reason against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import metadata as M, text as T
from corpusloom.operators import statutes as S
from corpusloom.sources.scratch import stored


def first_reason(*rules: tuple[Column, Column | str]) -> Column:
    """The reason of the first rule that holds; null if none does."""
    out = F.when(rules[0][0], rules[0][1])
    for broken, reason in rules[1:]:
        out = out.when(broken, reason)
    return out


def statute_records(laws: DataFrame, key: str, held: DataFrame, least: float = 0.5, min_chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """(records, put aside) of scraped laws.

    laws: key, text, pages, empty_pages, listing_title, listing_year, listing_status, source; held: title_key of the laws
    that the library has. The text's own short title goes before the listing's, the title's year before the listing's and
    that before the text's. Reasons in order: no title, held already, a text that can't be used, no year, too few
    sections found. Records are one row for each section: key, seq, title, year, status, document_type, slug, section,
    heading and text.
    """
    own = F.coalesce(M.short_title(F.col("text")), F.nullif(M.clean_title(F.col("listing_title")), F.lit("")))
    nothing = F.lit(None).cast("string")
    year = F.coalesce(M.year_of(F.col("title"), nothing), F.col("listing_year"), M.year_of(nothing, F.col("text")))
    problem = T.text_problem(F.col("text"), F.col("pages"), F.col("empty_pages"), min_chars)
    facts = {"year": year, "title_key": T.title_key(F.col("title")), "problem": problem}
    named = laws.withColumn("title", own).select(key, "text", "title", "listing_title", "listing_status", *(c.alias(n) for n, c in facts.items()))
    cut = S.detection(S.with_schedules(S.cut_laws(named, key, "title", "listing_title", "listing_status", *facts)))
    # Each law is read once, in its row; what is kept of it is written, as records and the laws put aside are both made of it.
    known = stored(cut.select(key, "title", "listing_title", "listing_status", *facts, "expected", "found", "detection", "sections", "schedules"), "statute-records")
    judged = known.join(held.select("title_key", F.lit(True).alias("__held")).distinct(), "title_key", "left")
    few = F.concat(F.lit("no recognisable sections (found "), F.col("found").cast("string"), F.lit(" of "), F.col("expected").cast("string"), F.lit(")"))
    reason = first_reason(
        (F.col("title").isNull(), "missing title"), (F.coalesce("__held", F.lit(False)), "held already"), (F.col("problem").isNotNull(), F.col("problem")),
        (F.col("year").isNull(), "missing year"), ((F.col("found") == 0) | (F.col("detection") < least), few),
    )
    decided = judged.withColumn("reason", reason)
    repealed = F.col("listing_title").rlike(r"(?i)\brepealed\b") | (F.col("listing_status") == "repealed")
    status = F.when(F.coalesce(repealed, F.lit(False)), "repealed").otherwise("under_review")
    own = decided.where("reason is null").select(key, "title", "year", status.alias("status"), M.document_type(F.col("title")).alias("document_type"), T.slug(F.col("title")).alias("slug"), "sections", "schedules")
    told = (key, "title", "year", "status", "document_type", "slug")
    plain = own.select(*told, F.explode(F.filter("sections", lambda x: x["text"].isNotNull())).alias("x")).select(*told, F.col("x.i").alias("seq"), "x.section", "x.heading", "x.text")
    listed = own.select(*told, F.explode("schedules").alias("x")).select(F.struct(*told).alias("law"), "x.section", "x.text")
    extra = S.schedule_items(listed, "law").select("law.*", F.lit(1 << 40).alias("seq"), "section", "heading", "text")
    return plain.unionByName(extra), decided.where("reason is not null").select(key, "title", "reason")


def judgment_records(judgments: DataFrame, key: str, courts: DataFrame, min_chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """(records, put aside) of scraped judgments.

    judgments: key, text, pages, empty_pages, listing_title, source; courts: source and court, where a source is one
    court's own. The source's court goes before the text's; the listing's title stands for a name that says nothing.
    Reasons in order: bad quality, a text that can't be used, no title, no year.
    """
    listing = F.nullif(T.one_space(F.col("listing_title")), F.lit(""))
    name, text = F.col("__name"), F.col("text")
    spoken = F.regexp_replace(F.col("__listed"), r"(?i)^judge?ments?\s+on\s+(?:the\s+)?", "")
    weak = F.coalesce((F.length(name) < 8) | name.rlike(r"\bv\.\s+\d*$"), F.lit(True))
    title = F.when(weak, F.coalesce(F.nullif(spoken, F.lit("")), name)).otherwise(name)
    year_in = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit(r"\b(1[89]\d\d|20\d\d)\b"), F.lit(1)), F.lit(-1)).try_cast("int")
    # Each fact is a column that others refer to, and all of them are written once: a text is read for each fact one time only.
    known = judgments.join(courts.select("source", F.col("court").alias("__court")), "source", "left").withColumns({"__name": M.parties(text), "case_number": M.case_number(text)})
    known = known.withColumns({"__quality": M.judgment_quality(text, F.col("pages"), F.col("empty_pages")), "__listed": listing})
    known = known.withColumns({
        "case_name": title, "year": F.coalesce(year_in(F.col("case_number")), year_in(F.col("__listed"))),
        "__problem": F.when(F.col("__quality").isNull(), T.text_problem(text, F.col("pages"), F.col("empty_pages"), min_chars)),
    })
    reason = first_reason(
        (F.col("__quality").isNotNull(), F.col("__quality")), (F.col("__problem").isNotNull(), F.col("__problem")),
        (F.col("case_name").isNull(), "missing title"), (F.col("year").isNull(), "missing year"),
    )
    of_record = F.when(F.col("reason").isNull(), F.struct(F.coalesce("__court", M.court(text)).alias("court"), "year", "case_number", M.judges(text).alias("judges"), T.content_hash(text).alias("content_hash"), "source"))
    decided = stored(known.withColumn("reason", reason).select(key, "case_name", "reason", of_record.alias("r")), "judgment-facts")
    records = decided.where("reason is null").select(key, "case_name", "r.*")
    return records, decided.where("reason is not null").select(key, "case_name", "reason")
