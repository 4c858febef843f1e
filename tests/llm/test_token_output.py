"""Token output: ids, places and files against the tokenizers library."""

import glob
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import token_output as T
from corpusloom.llm.common import tokenizer_path
from corpusloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, unit string, at double, ids string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(T.MODEL))


def _want(library, docs):
    """(doc_id, start, ids) in the order of doc_id; texts of one doc_id must be equal."""
    out, at = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, ids))
        at += len(ids)
    return out


ODD = [None, "", " ", "It's  a\ttest\n\nof WORDS", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", "a\x0bb\x0cc\x1cd\x85e\xa0f g", "́abc é ́", "ΣΑΣ İstanbul ﬁ", "日本語のテキスト" * 40,
       "<|end oftext|>", "123 4567", "emoji 😀👩‍👩‍👧", "w" * 300, "a\x00b", "\r\n", "don't we'll I'M"]


def test_encoder_is_the_library(library):
    encode, rnd = T.Encoder(tokenizer_path(T.MODEL)), random.Random(3)
    chars = "aZé'sßŸİŉſ×²ªĲ<| \t\n\x0b\x0c\x1c\x85́ͅİΣς1٣½<|>日​ 😀"
    texts = [*(t for t in ODD if t), *("".join(rnd.choice(chars) for _ in range(rnd.randrange(40))) for _ in range(3000))]
    for t, ids in zip(texts, encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert encode([texts[3].encode()]) == [encode([t.encode() for t in texts])[3]]


def test_files_and_spans(spark, library, tmp_path):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (5, "again"), (5, "again")]
    docs = [(i, "again" if i == 5 else t) for i, t in docs]
    frame = spark.createDataFrame([(i, t, "en", "u", 0.5, "x") for i, t in docs], DOCS).repartition(3)
    path = T.write_tokens(frame, f"file://{tmp_path}/out", unit_bytes=300)
    want = _want(library, docs)
    got = sorted(((r.doc_id, r.start, r.ids) for r in T.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    sums = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in T.checksums(T.read_tokens(spark, path)).collect()}
    assert sums == {(i, at): (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, ids in want}
    units = T.read_units(spark, path).orderBy("unit").collect()
    assert len(units) > 2 and units[-1].base + units[-1].n_tokens == sum(len(ids) for _, _, ids in want)
    stream = [x for _, _, ids in want for x in ids]
    for a, b in ((0, 7), (3, 90), (50, 51), (0, len(stream)), (len(stream), len(stream) + 5)):
        rows = sorted(T.read_span(spark, path, a, b).collect(), key=lambda r: r.start)
        assert [x for r in rows for x in r.ids] == stream[a:b] and [r.start for r in rows] == sorted({r.start for r in rows})


def test_encodings_and_pushdown(spark, tmp_path):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words number "), F.col("id").cast("string")).alias("text"))
    path = T.write_tokens(frame, f"file://{tmp_path}/out")
    file = max(glob.glob(f"{tmp_path}/out/data/*.parquet"))
    meta = pq.ParquetFile(file).metadata
    group = meta.row_group(0)
    columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["at"].encodings
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    rows = T.read_tokens(spark, path).where("doc_id between 700 and 703")
    plan = rows.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,700)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert rows.count() == 4


def test_nothing_to_write(spark, tmp_path):
    path = T.write_tokens(spark.createDataFrame([], DOCS), f"file://{tmp_path}/out")
    assert T.read_tokens(spark, path).count() == 0 and T.read_span(spark, path, 0, 9).count() == 0


def test_query_by_the_library(spark, small, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {i: (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, ids in _want(library, docs)}
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op13_token_output"](spark, small).collect()} == want


def test_units_are_told_apart_by_their_last_tokens(library):
    """No places of tokens are asked for; a vocabulary without marks of ends still gives the same ids."""
    parts = ["word", "'s", "unbelievably", "7", "</", "</w>"[2:3], "é", "...", "x" * 90]
    want = [np.array(library.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in parts]
    encoder = T.Encoder(tokenizer_path(T.MODEL))
    assert encoder.last.sum() > 1000

    class Fast:
        encode_batch_fast = encoder.tokenizer.encode_batch_fast

    whole, encoder.tokenizer = encoder.tokenizer, Fast()
    assert list(encoder._together(parts)) == want
    encoder.tokenizer = whole
    encoder.last[:] = False
    assert list(encoder._together(parts)) == want
