"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed into its pieces, trainer and normaliser settings; from them a tokenizer of the other
library is rebuilt: normaliser (character map, white space rules, dummy prefix), the metaspace marker, unigram scores or
BPE merges (each split of a piece into two pieces, ranked by the score of the whole), and byte fallback. Texts are cut
into words before a marker that follows another sign (and at line ends, if no piece holds one), which is exact where no
piece holds a marker inside; so long texts take linear time, and a worker's known words are remembered. All new words of
a batch are encoded at once by the library's threads; ``parity`` compares whole texts with the original library.

Defined results: null text is an empty text with no ids; control pieces inside texts are ordinary text; decoding gives
the text after normalisation (the dummy prefix removed), with each maximal run of bytes that isn't UTF-8 as U+FFFD.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, text_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Threads of one task's encoder, and characters given to it at a time.
THREADS, BATCH_CHARS = 2, 1_000_000
#: Words a worker remembers before it starts anew; bounds its memory only.
MEMO = 250_000


class Codec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        trainer, rules = proto.trainer_spec, proto.normalizer_spec
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        self.bytes = {i: int(p[3:-1], 16) for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        #: Bytes of signs outside ASCII: such ids only mean something together.
        self.high = np.array([self.bytes.get(i, 0) > 127 for i in range(len(pieces))])
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.texts = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else chr(self.bytes[i]) if k == BYTE else p.replace(MARK, " ") for i, (p, _, k) in enumerate(pieces)]
        self.dummy_prefix = rules.add_dummy_prefix
        ids = {p: i for i, (p, _, _) in enumerate(pieces)}
        if trainer.model_type == trainer.UNIGRAM:
            model: Any = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=self.unknown, byte_fallback=trainer.byte_fallback)
        elif trainer.model_type == trainer.BPE:
            scores = {p: s for p, s, k in pieces if k in (NORMAL, USER)}
            merges = []
            for whole, score in scores.items():
                for cut in range(1, len(whole)):
                    if whole[:cut] in scores and whole[cut:] in scores:
                        merges.append((-score, ids[whole[:cut]], ids[whole[cut:]], (whole[:cut], whole[cut:])))
            merges.sort(key=lambda m: m[:3])
            model = models.BPE(vocab=ids, merges=[m[3] for m in merges], unk_token=pieces[self.unknown][0], fuse_unk=True, byte_fallback=trainer.byte_fallback, cache_capacity=0)
        else:
            raise ValueError("only unigram and BPE models are known")
        tok = Tokenizer(model)
        steps: list[Any] = []
        if rules.precompiled_charsmap:
            steps.append(normalizers.Precompiled(rules.precompiled_charsmap))
        if rules.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
        if rules.add_dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if rules.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        self.normaliser = normalizers.Sequence(steps)
        #: With these rules only, white space is all that the normaliser changes.
        self.plain = rules.escape_whitespaces and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
        users = [p for p, _, k in pieces if k == USER]
        inside = users or any(MARK in p.lstrip(MARK) for p, _, k in pieces if k == NORMAL)
        lines = trainer.byte_fallback and not any("\n" in p for p, _, k in pieces if k != BYTE)
        #: Words whose ids don't depend on their neighbours; line ends are such where no piece holds one.
        self.words = re.compile(r"(?s).+" if inside else rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if lines else rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        if users:
            tok.add_tokens([AddedToken(p, normalized=False) for p in users])
        self.tok = tok
        self.memo: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        if not self.plain:
            return self.normaliser.normalize_str(text)
        return ((MARK if self.dummy_prefix else "") + text.replace(" ", MARK)) if text else ""

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; words met for the first time go to the library in one multithreaded batch."""
        words = [self.words.findall(self.normalise(t)) for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        memo = self.memo
        new = list({w for ws in words for w in ws if w not in memo})
        for w, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
            memo[w] = np.array(e.ids, np.int32).tobytes()
        return [np.frombuffer(b"".join(map(memo.__getitem__, ws)), np.int32) for ws in words]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        ids = np.asarray(ids, np.int64)
        if not self.high[ids].any():
            text = "".join(map(self.texts.__getitem__, ids.tolist()))
        else:
            out, run = [], bytearray()
            for i in ids.tolist():
                if i in self.bytes:
                    run.append(self.bytes[i])
                    continue
                out += (run.decode("utf-8", "replace"), self.texts[i])
                run = bytearray()
            text = "".join(out) + run.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Codec(path)


def _parts(texts: pd.Series) -> Iterator[list[str]]:
    """The texts in lists of bounded size."""
    part, chars = [], 0
    for t in texts:
        part.append(t or "")
        chars += len(part[-1])
        if chars >= BATCH_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode(text: Column, model: str | None = None) -> Column:
    """Column of piece ids (array<int>) of a text column."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec = _codec(model or tokenizer_path(MODEL))
        return pd.Series([x for part in _parts(texts) for x in codec.encode(part)], dtype=object)

    return ids(text)


def decode(ids: Column, model: str | None = None) -> Column:
    """Column of the texts that piece ids stand for (null ids: empty)."""

    @F.pandas_udf("string")
    def texts(batch: pd.Series) -> pd.Series:
        codec = _codec(model or tokenizer_path(MODEL))
        return pd.Series([codec.decode([] if x is None else x) for x in batch], dtype=object)

    return texts(ids)


def parity(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and whether both libraries give the same ids and the same decoded text."""

    @F.pandas_udf("boolean")
    def same(texts: pd.Series) -> pd.Series:
        import sentencepiece

        path = model or tokenizer_path(MODEL)
        codec, other, out = _codec(path), sentencepiece.SentencePieceProcessor(model_file=path), []
        for part in _parts(texts):
            for a, b in zip(codec.encode(part), other.encode(part, num_threads=THREADS)):
                out.append(a.tolist() == b and codec.decode(a) == other.decode(b))
        return pd.Series(out, dtype=bool)

    return docs.select("doc_id", same("text").alias("same"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and their digest for every whole text, and whether decoding them gives the text back."""
    text_batches(spark)
    docs = table(spark, sf_dir, "documents")

    @F.pandas_udf("n_tokens long, ids_crc32 long, round_trip boolean")
    def both(texts: pd.Series) -> pd.DataFrame:
        import zlib

        codec, rows = _codec(tokenizer_path(MODEL)), []
        for part in _parts(texts):
            for text, ids in zip(part, codec.encode(part)):
                rows.append((len(ids), zlib.crc32(ids.astype("<i4").tobytes()), codec.decode(ids) == text))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_crc32", "round_trip"])

    return docs.select("doc_id", both("text").alias("r")).select("doc_id", "r.n_tokens", "r.ids_crc32", "r.round_trip")


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the whole text, and their number."""
    text_batches(spark)
    return docs.select("doc_id", "lang", "source", encode(F.col("text")).alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))
