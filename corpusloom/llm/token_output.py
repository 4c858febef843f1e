"""Token ids as Parquet: list columns in doc_id order, with encodings, row groups and pages chosen for selective reads.

Layout of a folder: ``data`` has a row for each document (doc_id, unit, at, n_tokens, ids), sorted by doc_id, a unit for each
writing task; ``units`` has a row for each unit (first and last doc_id, documents, tokens, base) and is written last, so a folder
without it is no finished output. ``at`` is the number of ids before the document in its unit, ``base`` in all units before. Ids are
dictionary-encoded; doc_id and at are delta-encoded (ascending numbers); row groups and pages have stated sizes, and the writer adds
page indexes, so a read of some documents or columns takes the pages that hold them and no more.

Ids are those of the tokenizers library for the whole text. The vocabulary drops white space and never joins across it, nor across
letters, figures and signs, so a text is taken apart there; each different part is encoded once by the library and then looked up.

Defined results: null text is the end id alone. A null doc_id comes before all others; rows that share one stand in the order in
which they were read. No documents give no units. Columns of other names are left alone.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import scratch_folder, table, text_batches, tokenizer_path

MODEL = "word_bpe_49k.json"
END_ID = 1
UNIT_BYTES = 256 << 20  # bytes of text of a unit, about
BROADCAST_UNITS = 1_000_000  # rows of two numbers; with more units their bases are joined by a shuffle
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
MEMO_PIECES, MEMO_UNITS = 100_000, 500_000  # pieces between white space and their units that a worker remembers; then it starts anew
LONG_PIECE = 64  # bytes; longer ones are encoded each time
JOINED = 2_000  # units that are encoded in one text
TOGETHER_BYTES = 1 << 20  # bytes of texts that are encoded at a time
_ENCODED = "doc_id long, unit int, at long, n_tokens int, ids array<int>"
WRITER = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#at": "false",
}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    A text is lowered and cut into units, as the vocabulary's own rules do for ASCII and Latin letters. Where a unit holds other signs
    (its entry is None) or the text a special string, it is taken apart at white space, and what isn't all known units goes to the
    library as it is.
    """

    UNITS = re.compile(rb"[a-z\x80-\xff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-z\x80-\xff]+")
    KNOWN = re.compile("[!-~\xdf-\xf6\xf8-\u012f\u0131-\u017f]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # ids of tokens that end a unit
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix) and i < len(self.last)]] = True
        self.units: dict[bytes, bytes | None] = {}
        self.pieces: dict[bytes, bytes] = {}

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of parts without special strings: many in one text, told apart by the tokens that end a unit.

        A vocabulary that doesn't mark them gives other numbers of ends; then the library says where a token starts.
        """
        for at in range(0, len(parts), JOINED):
            some = parts[at : at + JOINED]
            text = " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(some) or ends[-1] != len(ids):
                starts = np.array([a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets], np.int64)
                ends = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in some])).tolist()
            yield from (ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends))

    def _cut(self, text: bytes) -> list[bytes]:
        return self.UNITS.findall(text.decode("utf-8", "replace").lower().encode())

    def _by_pieces(self, text: bytes) -> bytes:
        out: list[bytes | None] = []
        pieces = text.split()
        for p in pieces:
            ids = [self.units.get(u) for u in self._cut(p)] if b"<|" not in p else [None]
            out.append(self.pieces.get(p) if None in ids else b"".join(ids))
        new = list({p for p, ids in zip(pieces, out) if ids is None})
        found = dict(zip(new, self._each([p.decode("utf-8", "replace") for p in new]))) if new else {}
        self.pieces.update((p, ids) for p, ids in found.items() if len(p) <= LONG_PIECE)
        return b"".join([found[p] if ids is None else ids for p, ids in zip(pieces, out)])

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        known = self.units
        if len(known) > MEMO_UNITS:
            known.clear()
        if len(self.pieces) > MEMO_PIECES:
            self.pieces.clear()
        cut = [self._cut(t) for t in texts]
        new = list(set(filterfalse(known.__contains__, chain.from_iterable(cut))))
        known.update(dict.fromkeys(new))
        plain = [u for u in new if self.KNOWN.fullmatch(u.decode())]
        known.update(zip(plain, self._together([u.decode() for u in plain])))
        out = []
        for text, units in zip(texts, cut):
            try:
                out.append(self._by_pieces(text) if b"<|" in text else b"".join(map(known.__getitem__, units)))
            except TypeError:  # a unit of other signs, whose entry is None
                out.append(self._by_pieces(text))
        for u in new:
            if len(u) > LONG_PIECE:  # not worth remembering
                del known[u]
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    return Encoder(path)


def _bounded(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in lists of TOGETHER_BYTES, about."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py() or b"")
        size += len(part[-1])
        if size >= TOGETHER_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _encoded(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit, at = TaskContext.get().partitionId(), 0
        encode, end = _encoder(path or tokenizer_path(MODEL)), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            parts = [ids + end for some in _bounded(batch.column(1)) for ids in encode(some)]
            sizes = np.array([len(p) >> 2 for p in parts], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            flat = pa.Array.from_buffers(pa.int32(), int(starts[-1]), [None, pa.py_buffer(b"".join(parts))])
            ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)
            columns = [batch.column(0), pa.array(np.full(len(parts), unit, np.int32)), pa.array(at + starts[:-1]), pa.array(sizes.astype(np.int32)), ids]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "unit", "at", "n_tokens", "ids"])
            at += int(starts[-1])

    return run


def write_tokens(docs: DataFrame, path: str, model: str | None = None, end_id: int = END_ID, unit_bytes: int = UNIT_BYTES) -> str:
    """Encode doc_id and text of ``docs`` and write them below ``path`` (a new folder). Returns ``path``.

    Texts are dealt to units by ranges of doc_id, as many as their bytes ask for; a doc_id with very many rows is split by the rows'
    places, so no unit grows with it.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, -(-total // unit_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20))
    keyed = rows.withColumn("__place", F.monotonically_increasing_id())  # ranges are sampled from two numbers; no text is read for that
    dealt = keyed.repartitionByRange(int(units), "doc_id", "__place").sortWithinPartitions("doc_id", "__place").select("doc_id", "text")
    dealt.mapInArrow(_encoded(model, end_id), _ENCODED).write.options(**WRITER).parquet(f"{path}/data")
    data = spark.read.schema(_ENCODED).parquet(f"{path}/data")
    # ranges are numbered in the order of doc_id; the units' table has a row for each task of the writing job
    sums = data.groupBy("unit").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"))
    before = Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).coalesce(1).write.parquet(f"{path}/units")
    return path


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """unit, first_id, last_id, n_docs, n_tokens, base of a finished output."""
    return spark.read.parquet(f"{path}/units")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents; filters on doc_id and unread columns reach the files."""
    bases = read_units(spark, path).select("unit", "base")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_UNITS else bases
    data = spark.read.schema(_ENCODED).parquet(f"{path}/data")
    return data.join(bases, "unit").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """doc_id, start and ids of what lies in [start, stop) of the stream of all ids: only its units' pages are read."""
    near = read_units(spark, path).where((F.col("base") < stop) & (F.col("base") + F.col("n_tokens") > start)).select("unit", "base", "n_tokens").collect()  # a row a unit of the span
    if not near:
        return spark.read.schema(_ENCODED).parquet(f"{path}/data").where("false").select("doc_id", F.col("at").alias("start"), "ids")
    data = spark.read.schema(_ENCODED).parquet(f"{path}/data").where(F.col("unit").isin([r.unit for r in near]))
    low, high = min(r.base for r in near), {r.unit: r.base for r in near}
    if len(near) == 1:  # the span is a range of at, too, and reaches the page index
        data = data.where(F.col("at") < stop - low)
    base = F.element_at(F.create_map(*(F.lit(x) for pair in high.items() for x in pair)), F.col("unit"))
    placed = data.select("doc_id", (base + F.col("at")).alias("__s"), "n_tokens", "ids").where((F.col("__s") < stop) & (F.col("__s") + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(start) - F.col("__s"), F.lit(0)).cast("int")
    take = F.least(F.lit(stop) - F.col("__s"), F.col("n_tokens")).cast("int") - skip
    return placed.select("doc_id", (F.col("__s") + skip).alias("start"), F.slice("ids", skip + 1, take).alias("ids"))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what ``read_tokens`` returns: counted and summed from the ids that were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            values = ids.values.to_numpy().view("<u4")
            ends = ids.offsets.to_numpy()
            sums = np.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}")
    return checksums(read_tokens(spark, path))
