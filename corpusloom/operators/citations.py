"""Checks of an answer's citations against what was retrieved for it: cases, paragraphs, consequences, figures, mentions.

Texts are cut into lines and sentences by Column functions; what is named in them meets the retrieved cases, passages and
documents in joins on the answer's key, so no answer is compared with another one's sources.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers as A, checks as K

# Law reports that stand before their year and behind it, kinds of cases and their short forms, words that a stop doesn't
# end a sentence after, and legal consequences with what states them in a source.
REPORTS_BEFORE = "PLD PLJ NLR KLR".split()
REPORTS_BEHIND = "SCMR MLD CLC YLR PCrLJ PLC CLD PTD SCJ MLR CLJ".split()
CASE_KINDS = "petition appeal revision reference suit case".split()
CASE_SHORT = "CPLA CP CA CrlA CrlP WP".split()
ABBREVIATIONS = "mst v vs s ss sec secs art arts no nos mr mrs ms dr st ltd co sc lah kar pesh cr eg ie cf viz pp p".split()
CONSEQUENCES = {
    "void": r"\bvoid\b", "voidable": r"\bvoidable\b", "invalid": r"\binvalid", "forfeiture": r"\bforfeit", "death": r"\bdeath\b", "imprisonment for life": r"\bimprisonment for life\b",
}


def _lettered(names: list[str]) -> str:
    """Pattern of any of some short forms, whose letters may have stops and a space between them ("PCrLJ" is "P. Cr. L. J.")."""
    return "|".join(r"\.?\s?".join(re.findall("[A-Z][a-z]*", name)) for name in names)


_PAGE = r"(?:\s+\([^)]*\))?(?:\s+[0-9]{1,5}\b)?"
_BEFORE = rf"(?:{_lettered(REPORTS_BEFORE)})\.?\s*\(?[0-9]{{4}}\)?(?:\s+[A-Z][A-Za-z.]*(?=\s+[(0-9]))?{_PAGE}"
_BEHIND = rf"[0-9]{{4}}\s+(?:{_lettered(REPORTS_BEHIND)})(?![A-Za-z])\.?{_PAGE}"
REPORTED = rf"\b(?:{_BEFORE}|{_BEHIND})"
#: Spaces that end a sentence: those behind a stop that isn't one of an abbreviation or an initial.
SENTENCE_END = rf"(?<=[.!?])(?<!(?i:\b(?:{'|'.join(ABBREVIATIONS)}|[a-z])\.))\s+"
#: A word of a party's name: titles and initials have stops.
_WORD = r"(?:(?:Mst|Mr|Mrs|Ms|Dr|Ch)\.|[A-Z]\.|[A-Z][\w'’-]*)"
_PARTY = rf"{_WORD}(?:\s+(?:of\s+|and\s+|the\s+)?{_WORD}){{0,5}}"
NAMED = rf"\b{_PARTY}\s+(?:v\.|vs\.?|versus)\s+{_PARTY}"
#: A case by its number, or by the first of several, and its year.
NUMBERED = (
    rf"(?i)\b(?:(?:{'|'.join(CASE_KINDS)})s?|(?:{_lettered(CASE_SHORT)})\.?)\s*(?:nos?\b\.?\s*)?([0-9]+)(?:-[a-z]\b)?"
    r"(?:\s*(?:,|&|-|\band\b|\bto\b)\s*[0-9]+)*\s*(?:\bof\b|/)\s*([0-9]{4})\b"
)
PARAGRAPH = r"(?i)\bpara(?:graph)?s?\.?\s+(\d{1,3}(?:\s*(?:,|and|&)\s*\d{1,3})*)"
# Words that may stand in capitals before a person's name, and words that are no part of one.
BEFORE_NAMES = (
    "whether the a an in on at for if when his her their counsel according as after before since while that this both all no did does "
    "was is who why how what can could should would may although but"
).split()
NO_NAMES = (
    "supreme court high pakistan state petitioner respondent appellant complainant trial medical board standing police station district "
    "learned counsel the criminal petition appeal civil code penal procedure act order ordinance khyber pakhtunkhwa punjab sindh "
    "balochistan islamabad peshawar lahore karachi quetta federal shariat government judge justice under section this that both courts "
    "below further inquiry bail"
).split()
#: A first information report by its number; the three letters may have stops and spaces.
REPORT = r"(?i)\bf[. ]{0,2}i[. ]{0,2}r\b[. ]*(?:no\b[. ]*)?(\d+)\b"
#: Words of a case's name that tell nothing.
NAME_NOISE = "v vs versus the of and another others state".split()


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def name_words(name: Column) -> Column:
    """Distinct words of a case's name that tell it from others."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"[a-z]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(NAME_NOISE)))


def case_mentions(rows: DataFrame, key: str) -> DataFrame:
    """key, line, start, stop (characters within the line) and cite of all cases that texts name by parties or by number."""
    lines = rows.select(key, F.posexplode(F.split("text", "\n")).alias("line", "said"))
    both = F.concat(_all(F.col("said"), NAMED), _all(F.col("said"), NUMBERED))
    found = lines.select(key, "line", "said", F.explode(F.array_distinct(both)).alias("cite"))
    start = F.position(F.col("cite"), F.col("said"))
    return found.select(key, "line", start.alias("start"), (start + F.length("cite")).alias("stop"), "cite")


def retrieved_cases(mentions: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """``mentions`` with the case of the same key that each refers to: all words of its name are in the case's, or number and year agree.

    cases: key, case_id, name, numbers (array<string>), year (string), paragraph. Mentions of no case of theirs have no row.
    """
    number, year = F.regexp_extract("cite", NUMBERED, 1), F.regexp_extract("cite", NUMBERED, 2)
    several = F.slice(F.regexp_extract_all("cite", F.lit("[0-9]+"), F.lit(0)), 1, F.size(F.regexp_extract_all("cite", F.lit("[0-9]+"), F.lit(0))) - 1)  # all but the year
    asked = mentions.withColumns({"__words": name_words(F.regexp_replace("cite", r"\b(?:v\.|vs\.?|versus)(?=\s)", " ")), "__number": number, "__year": year, "__several": F.when(number != "", several)})
    held = cases.withColumns({"__held": name_words(F.col("name"))})
    by_number = (F.col("__number") != "") & F.arrays_overlap("numbers", "__several") & (F.col("__year") == F.col("year"))
    by_name = (F.col("__number") == "") & (F.size("__words") >= 2) & (F.size(F.array_except("__words", "__held")) == 0)
    met = asked.join(held, key).where(by_number | by_name)
    first = F.row_number().over(Window.partitionBy(key, "line", "start", "cite").orderBy("case_id"))
    return met.withColumn("__n", first).where("__n = 1").drop("__n", "__words", "__number", "__year", "__several", "__held")


def wrong_paragraphs(answers: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """key, case_id, name, paragraph (that was retrieved) and wrong: paragraphs an answer gives for a case instead.

    "Para N" belongs to the nearest case on its line, one before it rather than one behind; without one it is left alone.
    """
    lines = answers.select(key, F.posexplode(F.split("text", "\n")).alias("line", "said"))
    paras = lines.select(key, "line", "said", F.posexplode(_all(F.col("said"), PARAGRAPH)).alias("nth", "para"))
    paras = paras.withColumn("p_start", F.position(F.col("para"), F.col("said"))).withColumn("p_stop", F.col("p_start") + F.length("para")).drop("said")
    near = paras.join(retrieved_cases(case_mentions(answers, key), cases, key), [key, "line"]).where("stop <= p_start or start >= p_stop")
    gap = F.when(F.col("stop") <= F.col("p_start"), F.col("p_start") - F.col("stop")).otherwise(F.col("start") - F.col("p_stop") + 1000)
    nearest = near.withColumn("__n", F.row_number().over(Window.partitionBy(key, "line", "nth").orderBy(gap, "start"))).where("__n = 1")
    numbers = F.transform(F.regexp_extract_all("para", F.lit(r"\d{1,3}"), F.lit(0)), lambda x: x.cast("int"))
    return nearest.select(key, "case_id", "name", "paragraph", F.filter(numbers, lambda n: n != F.col("paragraph")).alias("wrong")).where(F.size("wrong") > 0)


def without_unbacked_cases(answers: DataFrame, passages: DataFrame, key: str, cases: DataFrame | None = None, mark: str = "[case citation removed]") -> DataFrame:
    """``answers`` with text cleaned, and removed: citations of cases that neither a passage nor a retrieved case backs.

    The sentence that holds one becomes ``mark``; in a row of a table it is the cell, or all cells if it is the first one.
    Marks in a row are one. passages: key, text.
    """
    cites = F.concat(_all(F.col("text"), REPORTED), _all(F.col("text"), NAMED), _all(F.col("text"), NUMBERED) if cases is not None else F.array().cast("array<string>"))
    named = answers.select(key, F.explode(F.array_distinct(cites)).alias("cite"))
    told = named.join(passages.select(key, T.one_space(F.col("text")).alias("__p")), key).where(F.contains("__p", T.one_space(F.col("cite")))).select(key, "cite").distinct()
    if cases is not None:
        told = told.unionByName(retrieved_cases(named.withColumns({"line": F.lit(0), "start": F.lit(0), "stop": F.lit(0)}), cases, key).select(key, "cite")).distinct()
    bad = named.join(told, [key, "cite"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_list("cite")).alias("removed"))
    spoilt = lambda part: F.exists("removed", lambda c: F.contains(part, c))

    def table_row(line: Column) -> Column:
        cells = F.split(line, r"\|")
        whole = spoilt(F.get(cells, F.lit(1)))
        inner = F.transform(cells, lambda c, i: F.when((i > 0) & (i < F.size(cells) - 1) & (whole | spoilt(c)), F.when(~whole | (i == 1), F.lit(f" {mark} ")).otherwise(F.lit(" "))).otherwise(c))
        return F.array_join(inner, "|")

    def prose(line: Column) -> Column:
        sentences = F.split(line, SENTENCE_END)
        return F.regexp_replace(F.array_join(F.transform(sentences, lambda s: F.when(spoilt(s), F.lit(mark)).otherwise(s)), " "), rf"(?:\Q{mark}\E\s*){{2,}}", F.lit(f"{mark} "))

    lines = F.transform(F.split("text", "\n"), lambda x: F.when(~spoilt(x), x).when(F.ltrim(x).startswith("|"), table_row(x)).otherwise(F.rtrim(prose(x))))
    joined = answers.join(bad, key, "left")
    return joined.withColumn("text", F.when(F.col("removed").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("text")))


def unstated_consequences(answers: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """key and consequence: those that an answer states (outside the names of acts) and no passage of its own does."""
    plain = F.lower(F.regexp_replace("text", K.ACT_NAME, " "))
    stated = answers.select(key, F.explode(F.array(*(F.when(plain.rlike(p), F.lit(name)) for name, p in CONSEQUENCES.items()))).alias("consequence")).where("consequence is not null")
    low = F.lower("text")
    known = passages.select(key, F.explode(F.array(*(F.when(low.rlike(p), F.lit(name)) for name, p in CONSEQUENCES.items()))).alias("consequence")).where("consequence is not null").distinct()
    return stated.join(known, [key, "consequence"], "left_anti").distinct()


def misattributed_figures(answers: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """key, figure and numbers: periods and amounts in a sentence about sections that no section of its paragraph states.

    passages: key, number (of the section), text. Answers none of whose passages is a section aren't judged.
    """
    paragraphs = answers.select(key, F.posexplode(F.split("text", r"\n\s*\n")).alias("paragraph", "__t"))
    sentences = paragraphs.select(key, "paragraph", F.posexplode(F.split("__t", r"(?<=[.!?])\s+(?=[A-Z\[(])")).alias("sentence", "said"))
    refs = sentences.select(key, "paragraph", "sentence", F.explode(A.section_references(F.col("said"))).alias("r")).select(key, "paragraph", "sentence", F.col("r.number").alias("number")).distinct()
    numbers = refs.groupBy(key, "paragraph", "sentence").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    given = sentences.join(numbers, [key, "paragraph", "sentence"]).select(key, "paragraph", "sentence", "numbers", F.explode(K.figures(F.col("said"))).alias("figure"))
    sections = passages.where(F.col("number").rlike(r"^\d")).select(key, T.section_number(F.col("number")).alias("number"), "text")
    stated = sections.select(key, "number", F.explode(K.figures(F.col("text"))).alias("figure")).distinct()
    together = refs.select(key, "paragraph", "number").distinct().join(stated, [key, "number"]).select(key, "paragraph", "figure").distinct()
    judged = given.join(sections.select(key).distinct(), key, "left_semi").join(together, [key, "paragraph", "figure"], "left_anti")
    return judged.groupBy(key, "figure").agg(F.min_by("numbers", F.struct("paragraph", "sentence")).alias("numbers"))


def person_names(text: Column) -> Column:
    """Distinct runs of two to four capitalised words of three letters or more, without words that only stand before a name.

    Runs that hold a word of courts, places and papers are no person's name.
    """
    runs = F.transform(_all(text, r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){1,3}\b"), lambda r: F.split(r, r"\s+"))
    no_lead = lambda ws: F.aggregate(ws, F.slice(ws, 1, 0), lambda kept, w: F.when((F.size(kept) == 0) & F.lower(w).isin(BEFORE_NAMES), kept).otherwise(F.concat(kept, F.array(w))))
    people = F.filter(F.transform(runs, no_lead), lambda ws: (F.size(ws) >= 2) & ~F.exists(ws, lambda w: F.lower(w).isin(NO_NAMES)))
    return F.array_distinct(F.transform(people, lambda ws: F.array_join(ws, " ")))


def unsupported_mentions(items: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """key, item, missing (dates, case numbers, report numbers and sections that the document lacks: drop), names (unknown: flag).

    items: key, item, text; documents: key, text (one each) and, if there, entities (texts of recognised entities), which back
    dates, case numbers and names. Any figure of the document backs a section's number; a report's must be announced as one.
    """
    said, held = F.col("text"), F.col("__d")
    known = F.coalesce("__e", F.lit(""))
    squash = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    day = lambda d: F.concat_ws("-", d["year"].cast("string"), F.lpad(d["month"].cast("string"), 2, "0"), F.lpad(d["day"].cast("string"), 2, "0"))
    days = F.transform(F.array_except(F.array_except(T.dates(said), T.dates(held)), T.dates(known)), day)
    case_parts = F.transform(_all(said, NUMBERED), lambda m: F.struct(m.alias("cite"), F.regexp_extract(m, NUMBERED, 1).alias("n"), F.right(m, F.lit(2)).alias("y")))
    numbered = lambda c: F.concat(F.lit(r"(?s)\b"), c["n"], F.lit(r"\b.{0,25}?(?:\d\d)?"), c["y"], F.lit(r"\b"))
    cases = F.transform(F.filter(case_parts, lambda c: ~F.regexp_like(held, numbered(c)) & ~F.regexp_like(known, numbered(c))), lambda c: c["cite"])
    reports = F.array_except(F.regexp_extract_all(said, F.lit(REPORT), F.lit(1)), F.regexp_extract_all(held, F.lit(REPORT), F.lit(1)))
    numbers = F.array_distinct(F.transform(A.section_references(said), lambda r: r["number"]))
    sections = F.transform(F.filter(numbers, lambda n: ~F.regexp_like(held, F.concat(F.lit(r"(?<!\d)"), n, F.lit(r"(?!\d)")))), lambda n: F.concat(F.lit("section "), n))
    names = F.filter(person_names(said), lambda n: ~F.contains(squash(held), squash(n)) & ~F.contains(squash(known), squash(n)))
    entities = F.array_join("entities", " | ") if "entities" in documents.columns else F.lit(None).cast("string")
    joined = items.join(documents.select(key, F.col("text").alias("__d"), entities.alias("__e")), key)
    missing = F.concat(days, cases, F.transform(reports, lambda n: F.concat(F.lit("FIR "), n)), sections)
    return joined.select(key, "item", missing.alias("missing"), names.alias("names"))


def reasoning_report(checked: DataFrame, key: str) -> DataFrame:
    """key, kept, flagged, and dropped by reason (a map). checked: key, dropped_for (array of reasons; empty: kept), names."""
    reasons = checked.select(key, F.explode("dropped_for").alias("reason")).groupBy(key, "reason").agg(F.count("*").alias("n"))
    maps = reasons.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("dropped"))
    kept = F.size("dropped_for") == 0
    return checked.groupBy(key).agg(F.count_if(kept).alias("kept"), F.count_if(kept & (F.size("names") > 0)).alias("flagged")).join(maps, key, "left")


def own_case_numbers(entities: DataFrame, documents: DataFrame, key: str, top: int = 2000) -> DataFrame:
    """``entities`` (key, type, start, stop from 0) with a cited case number in a judgment's heading relabelled as its own.

    The heading ends at "Against" or at a title ORDER or JUDGMENT within the first ``top`` characters; without one nothing changes.
    """
    end = F.length(F.regexp_extract(F.left("text", F.lit(top)), r"(?s)^(.*?)(?:\bAgainst\b|(?<=\n)[ \t]*(?:ORDER|JUDGE?MENT)[ \t]*(?=\n|$))", 1))
    found = F.left("text", F.lit(top)).rlike(r"(?m)\bAgainst\b|^[ \t]*(?:ORDER|JUDGE?MENT)[ \t]*$")
    heads = documents.select(key, F.when(found, end).alias("__end"), F.col("text").alias("__text"))
    surface = F.substr("__text", F.col("start") + 1, F.col("stop") - F.col("start"))
    own = F.col("type").isin("appealcaseno", "refcase") & (F.col("stop") <= F.col("__end")) & surface.rlike(r"(?i)\bnos?\b") & surface.rlike(r"\d")
    return entities.join(heads, key, "left").withColumn("type", F.when(F.coalesce(own, F.lit(False)), "caseno").otherwise(F.col("type"))).drop("__end", "__text")


def without_line_break_abbreviations(entities: DataFrame, documents: DataFrame, key: str, types: tuple[str, ...] = ("person", "respondent")) -> DataFrame:
    """``entities`` of persons that cross a line break without the part that is only an abbreviation in capitals (at most five)."""
    joined = entities.join(documents.select(key, F.col("text").alias("__text")), key, "left")
    surface = F.substr("__text", F.col("start") + 1, F.col("stop") - F.col("start"))
    front = F.length(F.regexp_extract(surface, r"^(\s*[A-Z]{1,5}\s*\n\s*)", 1))
    back = F.length(F.regexp_extract(surface, r"(\s*\n\s*[A-Z]{1,5}\s*)$", 1))
    person = F.col("type").isin(*types)
    return joined.withColumns({"start": F.when(person, F.col("start") + front).otherwise(F.col("start")), "stop": F.when(person, F.col("stop") - back).otherwise(F.col("stop"))}).drop("__text")
