"""Scans of records, tables in text files, and documents in several encodings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION_RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("doc_id", "title", "section", "heading", "text", "source_type", "jurisdiction", "category", "act_number", "source", "source_url", "original_file", "scraped_at", "content_hash", "status", "audience")]
    + [T.StructField("year", T.IntegerType()), T.StructField("source_tier", T.IntegerType()), T.StructField("sectioned", T.BooleanType()), T.StructField("amendments", T.ArrayType(T.StringType()))]
)
JUDGMENT_RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("doc_id", "case_name", "case_number", "court", "citation", "text_hash")]
    + [T.StructField("year", T.IntegerType()), T.StructField("judges", T.ArrayType(T.StringType())), T.StructField("topics", T.ArrayType(T.StringType()))]
    + [T.StructField("paragraphs", T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType())])))]
)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines, one a line; blank lines are skipped, unreadable ones are kept in ``bad_line``. Adds file."""
    whole = T.StructType([*schema.fields, T.StructField("bad_line", T.StringType())])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").json(path)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def with_set(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of several, the name of each in the column set; missing columns are null."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("set", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def csv_table(spark: SparkSession, path: str, columns: list[str], required: list[str]) -> DataFrame:
    """Columns of a CSV file with a header (a byte order mark is no part of it); rows with a blank required field are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    clean = rows.toDF(*(c.lstrip("﻿") for c in rows.columns)).select(*columns)
    for c in required:
        clean = clean.where(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    return clean


def markdown_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table as strings; header and ruler lines, and lines with another number of cells, are left out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\|.*\|$") & ~F.col("value").rlike(r"^[\s|:-]+$")).select(cells.alias("c"))
    kept = rows.where((F.size("c") == len(columns)) & F.col("c")[0].rlike(r"^\d+$"))
    return kept.select(*(F.col("c")[i].alias(name) for i, name in enumerate(columns)))


def tagged_sentences(spark: SparkSession, path: str) -> DataFrame:
    """sentence, at, token and tag of "token tag" lines; a blank line ends a sentence, malformed lines are skipped."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "").select(F.xxhash64("value", F.monotonically_increasing_id()).alias("sentence"), "value")
    lines = blocks.select("sentence", F.posexplode(F.split("value", "\n")).alias("at", "line")).where(F.col("line").rlike(r"^\S+\s+[BIO](-\S+)?$"))
    return lines.select("sentence", "at", F.regexp_extract("line", r"^(\S+)", 1).alias("token"), F.regexp_extract("line", r"(\S+)$", 1).alias("tag"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 (byte order mark dropped), else UTF-16 where it starts with its mark, else Windows-1252."""

    @F.pandas_udf("string")
    def read(batch: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            for name in ("utf-8-sig", *(["utf-16"] if b[:2] in (b"\xff\xfe", b"\xfe\xff") else []), "cp1252"):
                try:
                    return b.decode(name)
                except UnicodeDecodeError:
                    continue
            return b.decode("utf-8", "replace")

        return batch.map(one, na_action="ignore")

    return read(content)


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path and text of files in one of several encodings."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length"), decoded(F.col("content")).alias("text"))


def zipped_texts(files: DataFrame) -> DataFrame:
    """path, member and text of the text files inside zip files (a table of the binaryFile source)."""

    def members(batches):
        import io
        import zipfile

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, n, z.read(n)) for n in z.namelist() if n.lower().endswith(".txt")]
            yield pd.DataFrame(rows, columns=["path", "member", "content"])

    return files.select("path", "content").mapInPandas(members, "path string, member string, content binary").select("path", "member", decoded(F.col("content")).alias("text"))


#: An anchor with its address and what it holds, as Python says it, and the same in Java's words (white space of any script).
_ANCHOR = r"""<a\b[^>]*\bhref\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
_ANCHOR_JAVA = "(?isU)" + _ANCHOR.replace(r"\s", r"[\s\x1c-\x1f]")


def links(pages: DataFrame, base: str = "url", html: str = "html") -> DataFrame:
    """Pages with at, target (absolute) and title of each link; the first of a target stays.

    Anchors are cut out of a page first, so that what goes to Python grows with the links and not with the pages.
    """

    @F.pandas_udf("array<struct<target:string,title:string>>")
    def find(urls: pd.Series, anchors: pd.Series) -> pd.Series:
        import re
        from html import unescape
        from urllib.parse import urljoin

        anchor, tag = re.compile(_ANCHOR, re.I | re.S), re.compile(r"<[^>]+>")

        def one(url: str | None, texts: list[str] | None) -> list[tuple[str, str]]:
            seen: dict[str, str] = {}
            for href, body in (pair for text in ([] if texts is None else texts) for pair in anchor.findall(text)):
                target = urljoin(url or "", unescape(href.strip()))
                title = " ".join(unescape(tag.sub(" ", body)).split())
                if not seen.get(target):
                    seen[target] = title
            return list(seen.items())

        return pd.Series([one(u, t) for u, t in zip(urls, anchors)], dtype=object)

    cut = F.regexp_extract_all(html, F.lit(_ANCHOR_JAVA), F.lit(0))
    return pages.withColumn("__l", find(base, cut)).select(*pages.columns, F.posexplode("__l").alias("at", "l")).select(*pages.columns, "at", "l.target", "l.title")


def pages_until_empty(pages: DataFrame, letter: str, offset: str, new: Column) -> DataFrame:
    """Pages of each letter before its first page that adds nothing new."""
    stop = pages.groupBy(letter).agg(F.min(F.when(~new, F.col(offset))).alias("__stop"))
    return pages.join(stop, letter).where(F.col("__stop").isNull() | (F.col(offset) < F.col("__stop"))).drop("__stop")
