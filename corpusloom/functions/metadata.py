"""Facts about laws and judgments from their titles and texts, and gates on questions; missing facts are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import one_space

# Small words of titles, types of documents, courts by pattern, and countries outside the scope.
SMALL_WORDS = "a an and as at by for from in into of on or the to with".split()
DOCUMENT_TYPES = "Act Ordinance Order Rules Regulations Code Bill Notification".split()
COURTS = [(r"(?i)supreme\s+court", "Supreme Court"), (r"(?i)federal\s+shariat\s+court", "Federal Shariat Court"), (r"(?i)high\s+court", "High Court"), (r"(?i)(district|sessions|civil)\s+(court|judge)", "District Court"), (r"(?i)tribunal", "Tribunal")]
FOREIGN = "india|indian|united kingdom|british|england|united states|american|usa|uk|canada|canadian|australia|australian|dubai|uae|saudi arabia|china|bangladesh"


def _or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def clean_title(title: Column) -> Column:
    """A title without leading numbers, bracketed notes of repeal and file endings; capitals throughout become title case."""
    bare = one_space(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"(?i)\.(pdf|docx?|txt)$", ""), r"(?i)[\[(][^\])]*(repealed|amended|as modified)[^\])]*[\])]", ""), r"^\s*\d+[.)]?\s+", ""))
    words = F.transform(F.split(F.lower(bare), " "), lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 200))))
    return F.when((F.upper(bare) == bare) & F.length(bare).between(2, 10_000), F.array_join(words, " ")).otherwise(bare)


def short_title(text: Column) -> Column:
    """The name by which a law says it may be called: what follows, up to the first word for a kind of law and its year."""
    behind = F.regexp_extract(text, r"(?i)\bmay\s+be\s+(?:called|cited\s+as)\s+([^.;\n]{5,160})", 1)
    kinds = "|".join(k for k in DOCUMENT_TYPES if k not in ("Bill", "Notification", "Regulations"))
    return _or_null(F.regexp_extract(F.regexp_replace(behind, r"(?i)^the\s+", ""), rf"(?i)^(.*?\b(?:{kinds})\b(?:,?\s*\d{{4}})?)", 1))


def year_of(title: Column, text: Column) -> Column:
    """The last year in the title, else that of "Act No. X of YYYY" in the text."""
    years = F.regexp_extract_all(title, F.lit(r"\b(1[89]\d\d|20\d\d)\b"), F.lit(1))
    return F.coalesce(F.try_element_at(years, F.lit(-1)), _or_null(F.regexp_extract(text, r"(?i)\b(?:act|ordinance)\s+no\.?\s*[IVXLCDM\d]+\s+of\s+(\d{4})", 1))).try_cast("int")


def document_type(title: Column) -> Column:
    """The last word of the title that names a type."""
    return F.try_element_at(F.regexp_extract_all(title, F.lit(rf"\b({'|'.join(DOCUMENT_TYPES)})\b"), F.lit(1)), F.lit(-1))


def amendments(text: Column, most: int = 30) -> Column:
    """Laws that the text says amended it, distinct, ``most`` at most as the record holds no more."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:[Ss]ubs\.|[Ii]ns\.|[Aa]mended|[Oo]mitted) by (?:the )?([A-Z][A-Za-z ,()]{5,80}?(?:Act|Ordinance|Order),? \d{4})"), F.lit(1))), 1, most)


def parties(text: Column) -> Column:
    """Case name "A v. B" from the first lines of a judgment."""
    top = F.left(text, F.lit(1500))  # lines stay apart: a name ends with its line
    both = r"([A-Z][\w.'& ]{2,80}?)\s+(?i:versus|vs\.?|v\.)\s+([A-Z][\w.'& ]{2,80})"
    side = lambda m, g: F.trim(F.regexp_extract(m, both, g))
    # The lines are searched once; both sides are read from what was found.
    return F.get(F.transform(F.array(F.regexp_extract(top, both, 0)), lambda m: F.when(m != "", F.concat(side(m, 1), F.lit(" v. "), side(m, 2)))), F.lit(0))


def case_number(text: Column) -> Column:
    return _or_null(F.regexp_extract(F.left(text, F.lit(3000)), r"(?i)\b((?:civil|criminal|writ|constitution(?:al)?)\s+(?:appeal|petition|revision|misc\.?)\s+no\.?\s*[\w-]+(?:/[\w-]+)?\s*(?:of\s+\d{4}|/\s*\d{4}))", 1))


def court(text: Column) -> Column:
    top = F.left(text, F.lit(2000))
    out = F.when(top.rlike(COURTS[0][0]), COURTS[0][1])
    for pattern, name in COURTS[1:]:
        out = out.when(top.rlike(pattern), name)
    return out


def judges(text: Column) -> Column:
    """Names before ", J." or ", CJ." near the top, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.left(text, F.lit(4000)), F.lit(r"([A-Z][A-Za-z.'-]+(?: [A-Z][A-Za-z.'-]+){1,4}),? (?:C\.?J\.?|J\.)"), F.lit(1)), lambda x: F.trim(x)))


def topics(text: Column, patterns: dict[str, str], least: int = 2) -> Column:
    """Topics whose pattern is found ``least`` times or more."""
    low = F.lower(text)
    return F.filter(F.array(*(F.when(F.regexp_count(low, F.lit(p)) >= least, F.lit(name)) for name, p in patterns.items())), lambda x: x.isNotNull())


def judgment_quality(text: Column, pages: Column, empty_pages: Column, least: int = 500) -> Column:
    """Reason to leave a judgment out (near-empty, needs OCR, a publisher's copy), or null."""
    scanned = F.coalesce(empty_pages > pages / 2, F.lit(False))
    report = F.left(F.ltrim(text), F.lit(300)).rlike(r"\b(?:\d{4}\s+(?:SCMR|CLC|YLR|MLD|PCrLJ|PLC)|PLD\s+\d{4})\b") & F.left(text, F.lit(8000)).rlike(r"(?m)^\s*(?:\([a-z]\)|-{2,}|Ss?\.\s*\d+)")
    return F.when((F.length(F.trim(text)) < least) & ~scanned, "near-empty").when(scanned, "needs OCR").when(report, "law-report copy")


def foreign_only(question: Column) -> Column:
    """A question about a country outside the scope that doesn't speak of the one inside."""
    low = F.lower(question)
    return low.rlike(rf"\b(?:{FOREIGN})\b") & ~low.rlike(r"\bpakistan")


def prose(text: Column) -> Column:
    """A paragraph of sentences rather than a heading, a list of citations or footnotes."""
    head = F.left(text, F.lit(400))
    words, cited = F.regexp_count(text, F.lit(r"\b[a-z]{2,}\b")), F.regexp_count(text, F.lit(r"\b(?:PLD|SCMR|CLC|YLR)\b|\(\d{4}\)"))
    marks = F.regexp_count(head, F.lit(r"(?i)\b(?:versus|petitioner|respondent|present:|date of hearing|for the)\b"))
    bracketed = F.length(F.regexp_replace(text, r"[^\[\]()]*([\[(][^\[\]()]*[\])])?", "$1"))
    return (words >= 25) & (bracketed <= F.length(text) / 2) & (marks < 2) & (cited * 8 < words) & ~text.rlike(r"^\s*\d{1,2}\s*(?:Subs|Ins|Omitted)\b")


def display_name(name: Column, number: Column, doc_id: Column) -> Column:
    """Case name if it says something, else the number, else the id."""
    weak = F.coalesce((F.length(name) < 8) | name.rlike(r"(?i)^(?:order|judgment|case)\b|^\W*$"), F.lit(True))
    return F.when(~weak, name).otherwise(F.coalesce(number, doc_id))


def preamble(text: Column) -> Column:
    """Preamble of a law: from WHEREAS up to its first section."""
    return _or_null(F.regexp_extract(text, r"(?s)\b(WHEREAS\b.*?)(?=\n\s*1\.\s)", 1))


def labelled(text: Column, labels: list[str]) -> Column:
    """Map of the labels that open a line ("Issue: ...", with or without marks of emphasis) to what follows them."""
    opening = rf"^\s*[*#]*\s*({'|'.join(labels)})\s*[*]*\s*:?\s*[*]*\s*"
    marked = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(rf"(?i){opening}"), F.concat(F.lit("\x1e"), x)).otherwise(x))
    blocks = F.filter(F.split(F.array_join(marked, "\n"), "\x1e"), lambda b: b.rlike(rf"(?i){opening}"))
    pairs = F.transform(blocks, lambda b: F.struct(F.lower(F.regexp_extract(b, rf"(?i){opening}", 1)).alias("label"), F.regexp_replace(F.regexp_replace(b, rf"(?i){opening}", ""), r"\s+\z", "").alias("body")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["label"] == p["label"]))
    return F.map_from_entries(first)
