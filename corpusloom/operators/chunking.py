"""Chunks, sections and paragraphs of texts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from corpusloom.functions import text as T
from corpusloom.sources.scratch import stored

BROADCAST_ROWS = 1_000_000  # common words, some 30 bytes each; beyond that the join shuffles


def fixed_windows(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Array of structs n, start and chunk: windows of ``size`` characters, the last one reaching the end; blank ones left out."""
    stride, n = size - overlap, F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(stride))
    cut = F.transform(starts, lambda s, i: F.struct(i.alias("n"), s.alias("start"), F.trim(F.substring(text, s + 1, F.lit(size))).alias("chunk")))
    return F.when(n > 0, F.filter(cut, lambda c: c["chunk"] != "")).otherwise(F.filter(cut, lambda c: F.lit(False)))


def token_windows(tokens: Column, size: int = 120, stride: int = 60) -> Column:
    """Windows of a token array, the last one reaching its end."""
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride).cast("int") * stride)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda s: F.slice(tokens, s + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def space_windows(text: Column, size: int = 1200) -> Column:
    """Windows of about ``size`` characters, each cut at the last space of its second half; a cut depends on the one before.

    One pattern says so: what is left if it fits, else up to the last space from the middle on, else ``size`` characters.
    """
    first = max(size // 2, 1)
    window = rf"(?s)\G(?:.{{1,{size}}}+\z|.{{{first},{size - 1}}}(?= )|.{{{size}}})"
    cut = F.transform(F.regexp_extract_all(T.one_space(text), F.lit(window), F.lit(0)), lambda w: F.btrim(w, F.lit(" \x1c\x1d\x1e\x1f")))
    return F.filter(cut, lambda w: w != "")


def prefixed_windows(text: Column, prefix: Column, tokenize: Callable[[str], list[tuple[int, int]]], most: int = 120, most_prefix: int = 60, overlap: int = 20) -> Column:
    """Windows of at most ``most`` tokens, their prefix counted in, overlapping by ``overlap``; an empty body gives the prefix alone.

    ``tokenize`` gives the spans of a text's tokens; a prefix over its budget is cut to it.
    """

    @F.pandas_udf("array<struct<n:int,start:int,stop:int,chunk:string>>")
    def cut(texts: pd.Series, prefixes: pd.Series) -> pd.Series:
        def one(body: str | None, head: str | None) -> list[tuple[int, int, int, str]]:
            body, head = body or "", head or ""
            spans = tokenize(head)
            if len(spans) > most_prefix:
                head, spans = head[: spans[most_prefix - 1][1]], spans[:most_prefix]
            room, places, out, at = max(1, most - len(spans)), tokenize(body), [], 0
            while at < len(places):
                stop = min(at + room, len(places))
                a, b = places[at][0], places[stop - 1][1]
                out.append((len(out) + 1, a, b, f"{head} {body[a:b]}".strip()))
                if stop == len(places):
                    break
                at += max(1, room - overlap)
            return out or [(1, 0, 0, head)]

        return pd.Series([one(b, h) for b, h in zip(texts, prefixes)])

    return cut(text, prefix)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Spans of words between white space: the tokenizer where none is given."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def _from_one(found: list[float | None] | None) -> list[bool]:
    out, want = [], 1
    for n in [] if found is None else found:
        out.append(n is not None and n == want)
        want += out[-1]
    return out


@F.pandas_udf(ArrayType(BooleanType()))
def from_one(numbers: pd.Series) -> pd.Series:
    """Which of an array's numbers go 1, 2, 3; others (and nulls) between them are passed over."""
    return numbers.map(_from_one)


def paragraphs(text: Column, least: int = 40) -> Column:
    """Structs n and text: the text's own paragraphs 1., 2., 3. if three or more are in order (what stands before is 0), else blank-line blocks."""
    whole, sign = F.coalesce(text, F.lit("")), r"^\s*(\d{1,3})[.)]\s"

    @F.pandas_udf("array<boolean>")
    def opens(texts: pd.Series) -> pd.Series:
        numbers = texts.map(lambda t: [m and int(m[1]) for m in map(re.compile(sign).match, t.split("\n"))])
        return numbers.map(_from_one)

    marked = F.zip_with(F.split(whole, "\n"), opens(whole), lambda x, ok: F.when(ok, F.concat(F.lit("\x1e"), F.regexp_replace(x, sign, ""))).otherwise(x))
    own = F.transform(F.split(F.array_join(marked, "\n"), "\x1e"), lambda p, i: F.struct(i.alias("n"), T.one_space(p).alias("text")))
    blocks = F.filter(F.transform(F.split(whole, r"\n\s*\n"), T.one_space), lambda b: F.length(b) >= least)
    by_blank = F.transform(blocks, lambda b, i: F.struct((i + 1).alias("n"), b.alias("text")))
    return F.when(F.size(own) > 3, F.filter(own, lambda p: F.length(p["text"]) >= least)).otherwise(by_blank)


def sections(docs: DataFrame, key: str, header: str = r"^Section\s+(\w+)\s*[-.:]\s*(.*)$", skip: str = r"^(?i:chapter|part)\b") -> DataFrame:
    """key, seq, section, heading and text: lines are given to the header above them by a running count of headers."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("at", "line")).where(~F.col("line").rlike(skip))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("seq", F.sum(F.col("line").rlike(header).cast("int")).over(w)).where("seq > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    whole = marked.groupBy(key, "seq").agg(body.alias("all"))
    first = F.substring_index("all", "\n", 1)
    return whole.select(key, "seq", F.regexp_extract(first, header, 1).alias("section"), F.regexp_extract(first, header, 2).alias("heading"), F.trim(F.substring("all", F.length(first) + 2, F.length("all"))).alias("text"))


def detection(found: DataFrame, key: str) -> DataFrame:
    """key, expected (highest number), found and missing numbers, and their ratio."""
    numbers = F.array_distinct(F.transform(F.collect_list(F.regexp_extract("section", r"^(\d+)", 1).try_cast("int")), lambda x: x))
    per = found.groupBy(key).agg(numbers.alias("numbers")).withColumn("expected", F.coalesce(F.array_max("numbers"), F.lit(0)))
    missing = F.when(F.col("expected") > 0, F.array_except(F.sequence(F.lit(1), F.col("expected")), "numbers")).otherwise(F.array().cast("array<int>"))
    return per.select(key, "expected", F.size("numbers").alias("found"), missing.alias("missing"), (F.size("numbers") / F.nullif("expected", F.lit(0))).alias("detection"))


def units(text: Column) -> Column:
    """Pieces of a document: one starts at a blank line, a numbered paragraph or a heading in capitals."""
    starts = lambda x: (F.trim(x) == "") | x.rlike(r"^\s*(\(?\d{1,3}[.)]|[A-Z][A-Z ,&'-]{3,}:?\s*$)")
    marked = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(starts(x), F.concat(F.lit("\x1e"), x)).otherwise(x))
    return F.filter(F.transform(F.split(F.array_join(marked, "\n"), "\x1e"), lambda u: F.trim(u)), lambda u: u != "")


def packed(items: Column, budget: int) -> Column:
    """Greedy packing of strings, in order, into parts of ``budget`` characters (an item over it is a part of its own).

    items: a column as such, since a Python function can't take an expression that holds lambdas.
    """

    def one(found: list[str] | None) -> list[str]:
        parts: list[list[str]] = []
        room = -1
        for x in [] if found is None else found:
            if parts and len(x) < room:
                parts[-1].append(x)
                room -= 1 + len(x)
            else:
                parts.append([x])
                room = budget - len(x)
        return ["\n".join(p) for p in parts]

    @F.pandas_udf("array<string>")
    def pack(lists: pd.Series) -> pd.Series:
        return lists.map(one)

    return pack(items)


def bio_spans(tags: DataFrame, key: list[str], at: str) -> DataFrame:
    """Spans of B-/I- tags: kind, first and last token, mean score. An I- tag of another kind starts a span, too."""
    w = Window.partitionBy(*key).orderBy(at)
    kind = F.regexp_extract("tag", r"^[BI]-(.*)$", 1)
    starts = F.col("tag").startswith("B-") | (F.col("tag").startswith("I-") & ~F.coalesce(F.regexp_extract(F.lag("tag").over(w), r"^[BI]-(.*)$", 1) == kind, F.lit(False)))
    marked = tags.withColumns({"kind": kind, "__s": starts.cast("int")}).withColumn("span", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("tag <> 'O'").groupBy(*key, "span", "kind").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.avg("score").alias("score"))


def has_contents(text: Column) -> Column:
    """Whether a chunk is a table of contents: its header, or eight headings and hardly any sentence."""
    headings = F.regexp_count(text, F.lit(r"(?m)^\s*\d{1,3}[A-Z]?\.\s+[A-Z]"))
    modal = F.regexp_count(text, F.lit(r"\b(shall|may|must|will)\b"))
    return text.rlike(r"(?m)^\s*(CONTENTS|Contents)\s*$") | ((headings >= 8) & (modal <= 3))


def contents_entries(text: Column) -> Column:
    """Structs number and heading of the entries of a table of contents."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\d{1,3}[A-Z]?\.\s*\S"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d{1,3}[A-Z]?)\.", 1).alias("number"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*\d{1,3}[A-Z]?\.\s*", ""), r"[.\s]*\d*\s*$", "")).alias("heading")))


def without_page_marks(text: Column) -> Column:
    """Page numbers ("Page 3 of 10", a number alone on its line) and form feeds out."""
    return F.regexp_replace(F.regexp_replace(text, r"(?mi)^\s*(?:page\s+\d+\s+of\s+\d+|\d{1,4})\s*$\n?", ""), "\f", "")


def joined_words(words: DataFrame, key: str, vocabulary: DataFrame, least: int = 10) -> DataFrame:
    """Neighbouring words (key, place, word, following) whose joined form is a common word, more common than both pieces.

    Common words are few beside the places of a corpus: they go to the places while they are at most ``BROADCAST_ROWS``.
    """
    vocabulary = stored(vocabulary, "vocabulary")
    common = vocabulary.where(F.col("n") >= least)
    few = common.count() <= BROADCAST_ROWS
    count = lambda name, col: vocabulary.select(F.col("word").alias(col), F.col("n").alias(name))
    joined = common.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    both = words.withColumn("joined", F.concat("word", "following")).join(F.broadcast(joined) if few else joined, "joined")
    pieces = both.join(count("n_word", "word"), "word", "left").join(count("n_following", "following"), "following", "left")
    return pieces.where(F.col("n_joined") > F.greatest(F.coalesce("n_word", F.lit(0)), F.coalesce("n_following", F.lit(0)))).select(key, "place", "word", "following", "joined")


def ocr_errors(words: DataFrame, key: str, vocabulary: DataFrame, least: int = 10) -> DataFrame:
    """key, split (neighbours whose joined form is the commoner word) and rate, in 10,000 words. words: key and w, an array."""
    from corpusloom.operators.joins import bigrams

    split = joined_words(bigrams(words, key, F.col("w")), key, vocabulary, least).groupBy(key).agg(F.count("*").alias("split"))
    counted = words.select(key, F.size("w").alias("n")).where("n > 0").join(split, key, "left")
    return counted.select(key, F.coalesce("split", F.lit(0)).alias("split"), F.round(10_000 * F.coalesce("split", F.lit(0)) / F.col("n"), 1).alias("rate"))
