"""Table functions for SQL: sections and paragraphs of a table of texts, one partition of it at a time.

    register(spark)
    spark.sql("SELECT * FROM section_rows(TABLE(laws), 'law', 'text')")
    spark.sql("SELECT * FROM paragraph_rows(TABLE(docs), 'doc_id', 'text', 40)")
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

SPACE = re.compile(r"\s+")


def _named(table: AnalyzeArgument, *columns: AnalyzeArgument) -> list[str]:
    """The columns that constant arguments name, which the table must have."""
    names = [c.value for c in columns]
    missing = [n for n in names if n not in table.dataType.names]
    if not table.isTable or missing:
        raise ValueError(f"a table with the columns {', '.join(map(str, names))} is asked for")
    return names


class _Rows:
    """Rows are partitioned by their key, which the result has in its own type."""

    @staticmethod
    def _result(table: AnalyzeArgument, key: str, order: list[str], **columns) -> AnalyzeResult:
        schema = StructType().add(key, table.dataType[key].dataType)
        for name, kind in columns.items():
            schema.add(name, kind)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(c) for c in order])


class SectionRows(_Rows):
    """Key, seq, section, heading and text: lines under a header "Section 9 - Title", chapter lines left out."""

    HEADER, SKIP = re.compile(r"^Section\s+(\w+)\s*[-.:]\s*(.*)$"), re.compile(r"^(?:chapter|part)\b", re.I)

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        name, body = _named(table, key, text)
        return _Rows._result(table, name, [body], seq=LongType(), section=StringType(), heading=StringType(), text=StringType())

    def eval(self, row, key: str, text: str) -> Iterator[tuple]:
        seq, open_section = 0, None
        for line in (row[text] or "").split("\n"):
            if self.SKIP.search(line):
                continue
            if found := self.HEADER.search(line):
                if open_section:
                    yield self._done(open_section)
                seq += 1
                open_section = row[key], seq, found[1], found[2], []
            elif open_section:
                open_section[4].append(line)
        if open_section:
            yield self._done(open_section)

    @staticmethod
    def _done(found: tuple) -> tuple:
        return *found[:4], "\n".join(found[4]).strip(" ")


class ParagraphRows(_Rows):
    """Key, n and text of the blank-line blocks of ``least`` characters or more, white space as one space."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        name, body = _named(table, key, text)
        return _Rows._result(table, name, [body], n=LongType(), text=StringType())

    def eval(self, row, key: str, text: str, least: int) -> Iterator[tuple]:
        blocks = (SPACE.sub(" ", b).strip() for b in re.split(r"\n\s*\n", row[text] or ""))
        for n, block in enumerate((b for b in blocks if len(b) >= least), 1):
            yield row[key], n, block


def register(spark: SparkSession) -> None:
    """Make both functions known to SQL of this session."""
    spark.udtf.register("section_rows", udtf(SectionRows))
    spark.udtf.register("paragraph_rows", udtf(ParagraphRows))
