"""Language identification by compression with per-language zstandard dictionaries.

For each language a raw-content dictionary is cut from a bounded sample of its documents. A text is cut into pieces
of a few KB that cover all of it; each piece is compressed with every dictionary, and the language whose dictionary
leaves the fewest bytes in all wins. The score is the margin to the runner-up; where it is narrow, the operator
rejects the text (column ``accepted``).

Bound of the sample: the ``LANGUAGES`` most frequent values of lang, at most ``DOCS_PER_LANGUAGE`` documents for each, those of
the smallest hash of their id. In that order each whole text that still fits ``DICTIONARY_BYTES`` is chosen, by lengths alone;
only the chosen ones leave the executors. Where none fits, the start of the shortest is the dictionary. All are compressed at one level.

Defined results: null, empty and letterless texts are ``und`` with score 0 and not accepted; equal sizes go to the
language that comes first by name; where nothing can be learned every text is ``und``; documents with a null
lang or id are never learned from; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out, table, text_batches

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 300
LANGUAGES = 500
DICTIONARY_BYTES = 64 * 1024
PIECE = 8_192
LEVEL = 6
#: A margin, as a share of the runner-up's size over what any compressor adds, under which a text is rejected.
NARROW = 0.004
_LETTER = regex.compile(r"\p{L}")
#: Digits, signs and control characters of ASCII as spaces.
_PLAIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
#: Stands at the end of every dictionary and before every piece. It always matches, so that even a text of a few
#: words is compressed rather than stored, and its size shows how well it matches.
MARK = bytes(range(128, 224))


def training_sample(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, size: int = DICTIONARY_BYTES) -> DataFrame:
    """lang, r (order) and text of the bounded sample, ``size`` bytes a language at most; held-out documents are not in it."""
    key = F.xxhash64("text").alias("row_key")
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    frequent = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    # Ids, hashes and lengths are ranked; only the texts of those chosen leave their files.
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "row_key")
    lengths = usable.select("lang", "doc_id", key, F.octet_length("text").cast("long").alias("bytes"))
    ranked = lengths.withColumn("r", F.row_number().over(first)).where(F.col("r") <= docs_per_language).join(F.broadcast(frequent), "lang")
    listed = ranked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "bytes", "doc_id", "row_key"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice("rows", 1, 0).alias("taken"))
    fits = lambda s, x: s["used"] + x["bytes"] <= size
    step = lambda s, x: F.struct(F.when(fits(s, x), s["used"] + x["bytes"]).otherwise(s["used"]).alias("used"), F.when(fits(s, x), F.concat(s["taken"], F.array(x))).otherwise(s["taken"]).alias("taken"))
    taken = F.aggregate("rows", start, step)["taken"]
    shortest = F.array(F.element_at(F.array_sort(F.transform("rows", lambda x: F.struct(x["bytes"].alias("bytes"), x["r"].alias("r"), x["doc_id"].alias("doc_id"), x["row_key"].alias("row_key")))), 1))
    taken = F.when(F.size(taken) > 0, F.transform(taken, lambda x: F.struct(x["r"].alias("r"), x["doc_id"].alias("doc_id"), x["row_key"].alias("row_key")))).otherwise(F.transform(shortest, lambda x: F.struct(x["r"].alias("r"), x["doc_id"].alias("doc_id"), x["row_key"].alias("row_key"))))
    few = listed.select("lang", F.explode(taken).alias("x")).select("lang", "x.*")
    chosen = usable.select("lang", "doc_id", key, F.left("text", F.lit(size)).alias("text")).join(F.broadcast(few), ["lang", "doc_id", "row_key"])
    return chosen.select("lang", "r", "text").dropDuplicates(["lang", "r"])


def _normal(text: str) -> bytes:
    """Words only: case, digits and signs say little of a language."""
    return b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(_PLAIN).split(), b""])


def dictionaries(sample: DataFrame) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from the sample, whose bytes are bounded."""
    rows = sample.toPandas().sort_values(["lang", "r"])
    return {str(lang): b"".join(map(_normal, group["text"])) + MARK for lang, group in rows.groupby("lang")}


class Compressors:
    """One compressor for each language; the dictionaries are digested once."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(content)
        self.tools = [self._compressor(content[k], level) for k in self.langs]

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        digested = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        digested.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=digested, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: str) -> np.ndarray:
        """Bytes left by each dictionary."""
        data = _normal(text)
        pieces = [MARK + data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.tools], float)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.langs[best], 1.0
        second = float(np.delete(sizes, best).min())
        return self.langs[best], float((second - sizes[best]) / second)


def identify(docs: DataFrame, content: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """The documents with lang_pred, lang_score and accepted; all columns of the documents stay."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tools = Compressors(content)
        for texts in batches:
            yield pd.DataFrame([tools.predict(t) for t in texts], columns=["lang_pred", "score"])

    # The prediction has a name of its own while the documents' columns, which may clash with it, are kept.
    held = docs.select(F.struct(*docs.columns).alias("row"), predict("text").alias("p"))
    keep = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "lang_score", "accepted")]
    return held.select(*keep, F.col("p.lang_pred"), F.col("p.score").alias("lang_score"), ((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= narrow)).alias("accepted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents")
    content = dictionaries(training_sample(docs))
    found = identify(docs.select("doc_id", "text"), content)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "accepted")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was told apart; those that the identification rejects go."""
    text_batches(spark)
    return identify(docs, dictionaries(training_sample(docs))).where("accepted").select(*docs.columns)
