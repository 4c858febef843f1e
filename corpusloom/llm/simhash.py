"""SimHash near-duplicates found with Golay-code fuzzy hashing.

The fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of the perfect binary Golay code
(23, 12) with leading zeros. Decoding a word and its 23 neighbours at distance one gives its keys: one codeword index
or six. Words that differ in at most one bit share one, as either is a neighbour of the other. Two fingerprints that
differ in at most three bits have two segments with at most one differing bit each (errors sort as 0+0, 0+1 or 1+1
once the worst segment is left out), so for every pair of segments (s, t) they meet under (all keys of s, own key of
t) on one side and (own key of s, all keys of t) on the other. What meets is verified by the exact distance inside the
join. Equal fingerprints are one node, so exact copies never make pairs.

Defined results: null text is an empty text; a text without words has fingerprint zero and links like any other; a
null doc_id is kept, with the component of its fingerprint's smallest id; repeated rows stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, table, text_batches
from corpusloom.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Widths of the segments, from the lowest bits up.
SEGMENTS = (22, 21, 21)
#: x^11+x^9+x^7+x^6+x^5+x+1, which generates the Golay code.
GENERATOR = 0b101011100011
#: Shingles hashed at a time; bounds memory for very long texts.
STEP = 1 << 16


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words after division by the generator."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


@lru_cache(maxsize=1)
def _correction() -> np.ndarray:
    """Error pattern of weight three or less for each of the 2048 remainders; the code is perfect, so there is one."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)])
    out = np.zeros(2048, np.int64)
    out[_remainder(patterns)] = patterns
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword next to each 23-bit word."""
    words = words.astype(np.int64)
    return (words ^ _correction()[_remainder(words)]) >> 11


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own codeword index of each word, and the indexes of itself and all words at distance one (24 columns)."""
    near = words.astype(np.int64)[:, None] ^ np.array([0, *(1 << np.arange(23))])
    found = decode(near)
    return found[:, 0], found


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + SHINGLE - 1] if len(words) >= SHINGLE else words
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(part) >= SHINGLE else [b" ".join(part)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * x > n else "0" for x in ones), 2)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (hash of the text) and fp (the 64 bits as a signed long) of every row."""

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("row_key"), bits("text").alias("fp"))


def links(prints: DataFrame) -> DataFrame:
    """Pairs a < b of different fingerprints (column fp, distinct) that differ in DISTANCE bits or fewer."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            left, own, all_keys = b["fp"].to_numpy().view(np.uint64), [], []
            for width in SEGMENTS:
                word = (left & np.uint64((1 << width) - 1)).astype(np.int64)
                left = left >> np.uint64(width)
                one, many = fuzzy_keys(word)
                own.append(one)
                all_keys.append(np.sort(many, axis=1))
            fp = b["fp"].to_numpy()
            for n, (s, t) in enumerate(combinations(range(len(SEGMENTS)), 2)):
                for side, (wide, fixed, shift, to) in enumerate(((all_keys[s], own[t], 12, 0), (all_keys[t], own[s], 0, 12))):
                    fresh = np.ones(wide.shape, bool)
                    fresh[:, 1:] = wide[:, 1:] != wide[:, :-1]
                    row, col = np.nonzero(fresh)
                    key = (n << 24) | (wide[row, col] << shift) | (fixed[row] << to)
                    yield pd.DataFrame({"key": key.astype(np.int32), "side": np.full(len(row), side, np.int8), "fp": fp[row]})

    found = prints.select("fp").mapInPandas(keys, "key int, side byte, fp long")
    left = found.where("side = 0").select("key", F.col("fp").alias("x"))
    right = found.where("side = 1").select("key", F.col("fp").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).between(1, DISTANCE)
    pairs = left.join(right, (left["key"] == right["key"]) & near)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, fp, component_id (smallest doc_id of the component) and component_key (smallest row_key of its rows without id)."""
    prints, _ = materialise(fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(F.when(F.col("doc_id").isNull(), F.col("row_key"))).alias("first_key"))
    roots = components(links(nodes))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", "first_key", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first_key").alias("component_key"))
    by_print = named.join(smallest, "root").select("fp", "component_id", "component_key")
    return prints.join(by_print, "fp").select("doc_id", "row_key", "fp", "component_id", "component_key")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest id, and one row of it where id and text repeat.

    Different texts that share the smallest id all stay. Rows with a null id are told apart by their text: one of them
    (of the smallest hash) stays where the whole component has no id, none elsewhere.
    """
    text_batches(spark)
    found = near_duplicates(docs)
    chosen = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("doc_id").isNotNull() | (F.col("row_key") == F.col("component_key")))
    keep = found.where(chosen).select("doc_id", "row_key").distinct()
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]) & (F.xxhash64(docs["text"]) == keep["row_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
