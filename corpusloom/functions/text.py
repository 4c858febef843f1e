"""Text functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for ranking, and what search expands a question with.
STOP_WORDS = (
    "a an the of and or to in on at for by with from as is are was were be been being this that these those "
    "which who whom whose what when where why how can could may might shall should will would do does did not no any all "
    "each every some such under into upon than then there their its it his her him he she they them my our your you i we "
    "if about after before between during within without against per s sec section sections article articles art act "
    "ordinance order code pakistan law laws legal"
).split()
GLOSSARY = {
    "murder": ["qatl", "amd"], "qatl": ["murder"], "manslaughter": ["qatl", "khata"], "divorce": ["talaq"], "talaq": ["divorce"],
    "khula": ["dissolution"], "dower": ["mehr", "mahr"], "mehr": ["dower"], "mahr": ["dower"], "maintenance": ["nafqa", "nafaqa"],
    "nafqa": ["maintenance"], "nafaqa": ["maintenance"], "custody": ["hizanat"], "hizanat": ["custody"], "gift": ["hiba"],
    "hiba": ["gift"], "will": ["wasiyat"], "wasiyat": ["will"], "adultery": ["zina"], "zina": ["adultery"], "slander": ["qazf"],
    "qazf": ["slander"], "retaliation": ["qisas"], "qisas": ["retaliation"], "compensation": ["diyat", "arsh", "daman"],
    "diyat": ["compensation"], "endowment": ["waqf"], "waqf": ["endowment"],
}
# Words that announce the number of a section or an article, and the names of months.
ANNOUNCERS = "section sections sec sec. secs secs. s. u/s article articles art art. arts arts.".split()
MONTHS = "January February March April May June July August September October November December".split()
#: Any announcer, the longest that fits; and a figure with the letters behind it, which ``is_section_number`` judges.
ANNOUNCING = "|".join(re.escape(w) for w in sorted(ANNOUNCERS, key=len, reverse=True))
NUMBERED = r"[0-9]+(?:-?[A-Za-z]+)?"
SECTION_REFERENCE = rf"(?i)(?<!\w)(?:{ANNOUNCING})\s*({NUMBERED})"


#: White space of any script but the plain space.
_OTHER_SPACE = r"\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def one_space(text: Column) -> Column:
    """Runs of white space (of any script) as one space, none at the ends. A plain space by itself isn't touched, as most are."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf" [ {_OTHER_SPACE}]+|[{_OTHER_SPACE}][ {_OTHER_SPACE}]*", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with white space normalised."""
    return F.sha2(one_space(text), 256)


def squash(text: Column) -> Column:
    """Lower-case ASCII letters and digits only, so that split words compare equal."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z]", "")


def title_key(title: Column) -> Column:
    """Key of a title: percent codes decoded, a leading number and "the" dropped, then squashed."""
    decoded = F.coalesce(F.try_url_decode(F.replace(title, F.lit("+"), F.lit("%2B"))), title)  # a plus is no space in a path
    return squash(F.regexp_replace(decoded, r"(?i)^\s*(?:\d+\s+)?(?:the\s+)?", ""))


def slug(text: Column) -> Column:
    """Kebab case; apostrophes vanish."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "'", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def section_number(number: Column) -> Column:
    """Canonical form: white space and hyphens out, upper case ("25-a" is "25A")."""
    return F.upper(F.regexp_replace(F.coalesce(number, F.lit("")), r"[\s-]", ""))


def section_sort_key(number: Column) -> Column:
    """(number, letters) of a section number."""
    canonical = section_number(number)
    return F.struct(F.regexp_extract(canonical, r"^(\d+)", 1).try_cast("int").alias("number"), F.regexp_extract(canonical, r"^\d*([A-Z]*)", 1).alias("letters"))


def stem(word: Column) -> Column:
    """Plural endings of words over four letters: ies becomes y, s goes unless doubled."""
    long = F.length(word) > 4
    return F.when(long & word.endswith("ies"), F.concat(F.left(word, F.length(word) - 3), F.lit("y"))).when(long & word.endswith("s") & ~word.endswith("ss"), F.left(word, F.length(word) - 1)).otherwise(word)


def tokens(text: Column) -> Column:
    """Search tokens: lower case, hyphens as spaces, stop words out, then stemmed."""
    words = F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("-"), F.lit(" ")), F.lit(r"[a-z]+|[0-9]+[a-z]?"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(STOP_WORDS)), stem)


def is_section_number(number: Column) -> Column:
    """Whether figures and the letters behind them can be a section's number: four figures and two letters at most."""
    return (F.length(F.regexp_replace(number, "[^0-9]", "")) <= 4) & (F.length(F.regexp_replace(number, "[^A-Za-z]", "")) <= 2)


def section_tokens(text: Column) -> Column:
    """Section references of a question as tokens ("s. 25-A" is "sec25a")."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SECTION_REFERENCE), F.lit(1)), is_section_number)
    return F.transform(found, lambda n: F.concat(F.lit("sec"), F.lower(F.replace(n, F.lit("-"), F.lit("")))))


def question_tokens(question: Column) -> Column:
    """Tokens of a question, the glossary's terms for them, and its section references."""
    terms = F.create_map(*(x for k, v in GLOSSARY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    base = tokens(question)
    extra = F.flatten(F.transform(base, lambda w: F.coalesce(F.get(F.array(F.try_element_at(terms, w)), F.lit(0)), F.array().cast("array<string>"))))
    return F.concat(base, F.transform(extra, stem), section_tokens(question))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed one time, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def letter_ratio(text: Column) -> Column:
    """Letters among the signs that aren't white space (null where there are none)."""
    whole = F.coalesce(text, F.lit(""))

    def share(others: Column) -> Column:
        letters = F.length(whole) - F.length(others)
        return letters / F.nullif(letters + F.length(F.regexp_replace(others, r"(?U)\s+", "")), F.lit(0))

    return _once(F.regexp_replace(whole, r"\p{L}+", ""), share)


def text_problem(text: Column, pages: Column, empty_pages: Column, min_chars: int = 200, letters: float = 0.55, single: float = 0.35) -> Column:
    """First reason why an extracted text can't be used: no text layer, too short, or garbled; else null. Each fact is one count."""
    whole = F.coalesce(text, F.lit(""))
    words = F.regexp_count(whole, F.lit(r"\S+"))
    singles = F.regexp_count(whole, F.lit(r"(?<!\S)\p{L}(?!\S)"))
    short = lambda t: F.length(F.regexp_replace(t, r"\s+", "")) < min_chars
    return (
        F.when(empty_pages > pages / 2, "no text layer")
        .when(short(F.left(whole, F.lit(2 * min_chars))) & short(whole), "near-empty")  # most texts have enough at their head
        .when(letter_ratio(text) < letters, "few letters")
        .when(_once(singles, lambda n: (n > 0) & (n / F.greatest(words, F.lit(1)) > single)), "single letters")
    )


def readable(text: Column, share: float = 0.30, forms: int = 5) -> Column:
    """Whether a paragraph is mostly in a script the index reads: few Arabic letters and presentation forms."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    arabic = F.regexp_count(text, F.lit(r"[\x{600}-\x{6FF}\x{750}-\x{77F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"))
    shaped = F.regexp_count(text, F.lit(r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"))
    return F.coalesce((letters > 0) & (arabic / F.nullif(letters, F.lit(0)) <= share) & (shaped < forms), F.lit(False))


def mostly_arabic(text: Column) -> Column:
    """Whether more than half the letters are of the Arabic script (such pages are recognised again in that script alone)."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce(F.regexp_count(text, F.lit(r"[\x{600}-\x{6FF}]")) > letters / 2, F.lit(False))


def shortened(text: Column, size: int) -> Column:
    """White space normalised, cut to ``size`` characters with an ellipsis where longer."""
    flat = one_space(text)
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.left(flat, F.lit(size))), F.lit("…"))).otherwise(flat)


def excerpt(text: Column, size: int = 280) -> Column:
    """Shortened from the first sentence start: what stands before a capital after a full stop goes if the text starts in lower case."""
    flat = one_space(text)
    from_start = F.when(flat.rlike(r"^[a-z]"), F.coalesce(F.nullif(F.regexp_extract(flat, r"^[^.]*\. +([A-Z].*)$", 1), F.lit("")), flat)).otherwise(flat)
    return shortened(from_start, size)


def _numeric_dates(text: Column) -> Column:
    """Structs of day, month and year from chains of figures joined by stops, strokes or hyphens: any three in a row that could be one."""
    chains = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\w)[0-9]+(?:[./-][0-9]+){2,}(?!\w)"), F.lit(0)), lambda c: F.split(c, "[./-]"))
    size = lambda c, i: F.length(F.get(c, i))
    fits = lambda c, i: (size(c, i) <= 2) & (size(c, i + 1) <= 2) & size(c, i + 2).between(2, 4)
    starts = lambda c: F.filter(F.sequence(F.lit(0), F.size(c) - 3), lambda i: fits(c, i))
    return F.flatten(F.transform(chains, lambda c: F.transform(F.slice(starts(c), 1, 1), lambda i: F.slice(c, i + 1, 3))))


def _named_dates() -> tuple[str, str]:
    """Patterns of "3rd of March, 2001" (day, month, year) and "March 3, 2001" (month, day, year), from the months' names and short forms."""
    month = "(" + "|".join(f"{m[:3]}(?:{'|'.join(dict.fromkeys((m[3:], 't') if m[:4] == 'Sept' else (m[3:],)))})?" if m[3:] else m for m in MONTHS) + ")"
    day, gap = r"([0-9]{1,2})(?:st|nd|rd|th)?", r"[.,]*\s+"
    return rf"(?i)\b{day}\s+(?:of\s+)?{month}{gap}([0-9]{{4}})\b", rf"(?i)\b{month}{gap}{day}{gap}([0-9]{{4}})\b"


def dates(text: Column) -> Column:
    """Distinct (year, month, day) named in a text as d/m/y, "3 March 2001" or "March 3, 2001"; impossible days stay.

    Years of two figures are those of this century.
    """
    t = F.coalesce(text, F.lit(""))
    day_first, month_first = _named_dates()
    short = ",".join(m[:3].lower() for m in MONTHS)
    number = lambda m: F.floor(F.position(F.lower(F.left(m, F.lit(3))), F.lit(short)) / 4) + 1
    row = lambda y, m, d: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), d.cast("int").alias("day"))
    century = lambda y: F.when(y < 100, y + 2000).otherwise(y)
    numeric = F.transform(_numeric_dates(t), lambda c: row(century(F.get(c, F.lit(2)).cast("int")), F.get(c, F.lit(1)), F.get(c, F.lit(0))))

    def named(pattern: str, day: int, month: int) -> Column:
        part = lambda x, i: F.regexp_extract(x, pattern, i)
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: row(part(x, 3), number(part(x, month)), part(x, day)))

    return F.array_sort(F.array_distinct(F.concat(numeric, named(day_first, 1, 2), named(month_first, 2, 1))))


def placeholders(text: Column) -> Column:
    """Distinct unfilled placeholders, [..], {{..}} or <<..>>, in order; [IV] and the like are none."""
    found = F.regexp_extract_all(text, F.lit(r"\[[^\[\]\n]{1,80}\]|\{\{[^{}\n]{1,80}\}\}|<<[^<>\n]{1,80}>>"), F.lit(0))
    inner = lambda p: F.trim(F.regexp_replace(p, r"^\[|\]$", ""))
    real = lambda p: inner(p).rlike(r"^[_.\s…]+$") | ((F.regexp_count(inner(p), F.lit(r"\p{L}")) >= 2) & ~inner(p).rlike(r"^[IVXLCDMivxlcdm]+$"))
    return F.array_distinct(F.filter(found, lambda p: ~p.startswith("[") | real(p)))


def file_name(name: Column, size: int = 255) -> Column:
    """Last path component without control characters, cut to ``size`` with its extension kept."""
    last = F.trim(F.regexp_replace(F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1), r"[\x00-\x1f\x7f]", ""))
    end = F.regexp_extract(last, r"(\.[A-Za-z0-9]{1,10})$", 1)
    return F.when(F.length(last) > size, F.concat(F.left(last, F.lit(size) - F.length(end)), end)).otherwise(last)


def email_domain(address: Column) -> Column:
    """Domain of a well-formed address, in lower case; else null."""
    return F.when(address.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.lower(F.substring_index(address, "@", -1)))


def plain_digits(text: Column) -> Column:
    """One-to-one translation: no-break spaces, dash variants, Arabic-Indic and extended digits, so offsets hold."""
    spaces, dashes = "\u00a0\u202f\u2009", "\u2010\u2011\u2012\u2013\u2014"
    digits = "".join(chr(0x660 + k) for k in range(10)) + "".join(chr(0x6F0 + k) for k in range(10))
    return F.translate(text, spaces + dashes + digits, " " * 3 + "-" * 5 + "0123456789" * 2)


def without_markdown(text: Column) -> Column:
    """Line breaks as "; ", bold and italic marks removed."""
    t = F.regexp_replace(text, r"(?i)\s*<br\s*/?>\s*", "; ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\*\*(.+?)\*\*", "$1"), r"(?<![\w*])[*_](\S(?:.*?\S)?)[*_](?![\w*])", "$1"))


def token_estimate(text: Column) -> Column:
    """Tokens where no encoder is at hand: half the characters and one."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 2).cast("long") + 1


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Name of the first pattern found in a text."""
    out = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, name in rules[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def mask_headings(text: Column) -> Column:
    """Markdown heading lines blanked with as many spaces, so offsets hold: lines behind one to six #, and lines all in bold."""

    def heading(x: Column) -> Column:
        bare = F.ltrim(x, F.lit(" \t"))
        hashes = F.length(bare) - F.length(F.ltrim(bare, F.lit("#")))
        bold = F.length(F.regexp_extract(F.rtrim(bare, F.lit(" \t")), r"^\*\*([^*]*)\*\*:?$", 1))
        return (hashes.between(1, 6) & F.substr(bare, hashes + 1, F.lit(1)).isin(" ", "\t")) | bold.between(1, 80)

    lines = F.transform(F.split(text, "\n"), lambda x: F.when(heading(x), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    return F.array_join(lines, "\n")


def json_object(text: Column) -> Column:
    """Outermost braces of a model's reply as a variant, where they hold a JSON object; else null."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.try_parse_json(F.nullif(body, F.lit("")))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the values as JSON."""
    return F.sha2(F.to_json(F.array(*(c.cast("string") for c in columns))), 256)
