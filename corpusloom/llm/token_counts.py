"""Token counts at every prefix of a text, by dynamic programming over byte-level BPE.

The table of a text holds, for each code point, how much the exact token count of the prefix ending there differs
from that of the prefix before (one signed byte). Counts, budgets and truncations are read from it; nothing is
encoded again.

Inside one pre-token, ``last[i]``, the final token of the encoding of its first i bytes, is the one vocabulary token
that ends there and that BPE leaves apart from ``last[i - len]``; then ``count[i] = count[i - len] + 1``. Pre-tokens
are independent of each other but for white space and special tokens, whose prefixes are corrected here.

Defined results: null text is an empty text (an empty table, 0 tokens); a special token inside a text is one token,
as the library has it by default, while its proper prefixes are ordinary text.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, tokenizer_path

MODEL = "byte_bpe_50k.json"
LIMIT = 512
#: Entries a worker keeps of units and of token pairs before it starts anew; bounds its memory only.
MEMO = 1_000_000
#: Lengths in bytes of the beginnings whose state is kept, longest first.
SHARED = (12, 9, 6, 4)

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTION = regex.compile(r"'(?:s|t|re|ve|m|ll|d)$")


class _Patterns:
    """Patterns of the pre-tokeniser; ``moved`` has signs whose class (L, N or O) the library sees otherwise."""

    def __init__(self, moved: dict[str, str]):
        of = lambda kinds: "".join(map(regex.escape, (c for c, k in moved.items() if k in kinds)))
        letter, number = r"\p{L}", r"\p{N}"
        if moved:
            letter, number = (rf"[[{x}{of(k)}]--[{of('LNO'.replace(k, ''))}\x00]]" for x, k in ((letter, "L"), (number, "N")))
        other = rf"[^{_SPACE}{letter}{number}]" if not moved else rf"[[^{_SPACE}\p{{L}}\p{{N}}{of('LN')}]{of('O')}]"
        compiled = lambda p: regex.compile(p, regex.V1 if moved else regex.V0)
        #: Stretches whose prefix counts don't depend on what stands before them.
        self.unit = compiled(
            rf"'(?:s|t|re|ve|m|ll|d)| ?{letter}+| ?{number}+| ?{other}+|[{_SPACE}](?=[^{_SPACE}])"
            rf"|[{_SPACE}]{{2,}}(?:'{letter}+|{letter}+|{number}+|{other}+)?|[{_SPACE}]"
        )
        self.tail = compiled(rf"[{_SPACE}]*{other}*$")
        self.kinds = {k: compiled(p) for k, p in (("L", letter), ("N", number), ("O", other))}


_RUN = regex.compile(rf"[{_SPACE}]{{2,}}")


class _Restart(Exception):
    """A sign turned out to be of another class; the text is cut anew."""


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE, by the published rule: other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Lengths(dict):
    """Lengths of the tokens that can end in two given bytes (a token of one byte always can)."""

    def __init__(self, vocab: set[bytes]):
        found: dict[bytes, set[int]] = {}
        for token in vocab:
            if len(token) > 1:
                found.setdefault(token[-2:], set()).add(len(token))
        super().__init__({k: (*sorted(v, reverse=True), 1) for k, v in found.items()})

    def __missing__(self, tail: bytes) -> tuple[int, ...]:
        return (1,)


class PrefixCounter(dict):
    """Prefix tables of texts; as a dict it remembers those of units."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("prefix tables need byte-level BPE without normaliser and with its usual pre-tokeniser")
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {raw(s) for s in model["vocab"] if s not in specials}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.born = {a + b: k for (a, b), k in reversed(self.ranks.items())}
        self.halves = {a + b: (a, b) for a, b in reversed(self.ranks)}
        #: Lengths of tokens by their last two bytes, longest first.
        self.lengths: dict[bytes, tuple[int, ...]] = _Lengths(self.vocab)
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        #: The dynamic program's state after common beginnings of pre-tokens.
        self.heads: dict[bytes, tuple[tuple[bytes, ...], tuple[int, ...]]] = {}
        self.known: set[str] = set(map(chr, range(128)))
        self.moved: dict[str, str] = {}
        self.patterns = _Patterns(self.moved)
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def check_classes(self, text: str) -> None:
        """Unicode versions differ: each sign's class is asked of the library once, when it is first met."""
        fresh = set(text) - self.known
        if not fresh:
            return
        from tokenizers import pre_tokenizers

        pieces = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        moved = {}
        for c in fresh:
            kind = next((k for k, x in (("L", "a"), ("N", "1"), ("O", "!")) if len(pieces(x + c)) == 1), None)
            if kind and not self.patterns.kinds[kind].match(c):
                moved[c] = kind
        self.known |= fresh
        if moved:
            self.moved |= moved
            self.patterns = _Patterns(self.moved)
            self.clear()
            raise _Restart

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: the best-ranked pair first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether BPE keeps this boundary: merges are undone, latest first, until the two sides would have met."""
        if len(self.apart) > MEMO:
            self.apart.clear()
        left, right = pair
        if not left:
            found = self.merge(right) == [right]
        else:
            until, found = len(self.ranks), True
            while found:
                if self.ranks.get((left, right), until) < until:
                    found = False
                elif (a := self.born.get(left, -1)) > (b := self.born.get(right, -1)):
                    until, left = a, self.halves[left][1]
                elif b >= 0:
                    until, right = b + 1, self.halves[right][0]  # of equal merges the left one comes first
                else:
                    break
        self.apart[pair] = found
        return found

    def piece(self, text: str) -> list[int]:
        """Counts of all prefixes of one pre-token."""
        data = text.encode("utf-8", "surrogatepass")
        start = next((k for k in SHARED if data[:k] in self.heads and len(data) >= k), 0)
        last, count = map(list, self.heads[data[:start]]) if start else ([b""], [0])
        apart, lengths = self.apart, self.lengths
        for i in range(start + 1, len(data) + 1):
            for n in lengths[data[max(0, i - 2) : i]]:
                if n <= i:
                    token = data[i - n : i]
                    if token in self.vocab:
                        pair = (last[i - n], token)
                        if apart[pair] if pair in apart else self.stay_apart(pair):
                            break
            last.append(token)
            count.append(count[i - n] + 1)
            if i in SHARED:
                if len(self.heads) > MEMO // 4:
                    self.heads.clear()
                self.heads[data[:i]] = tuple(last), tuple(count)
        if len(data) == len(text):
            return count[1:]
        ends = accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)
        return [count[e] for e in ends]

    def unit(self, text: str) -> list[int]:
        if run := _RUN.match(text):
            # White space up to the last takes part as one piece, unless nothing follows.
            space = run.group()
            if len(space) == len(text):
                return self.piece(text)
            whole, before = self.piece(space), self.piece(space[:-1])[-1]
            return whole + [before + k for k in self.plain(text[len(space) - 1 :])[1:]]
        if _CONTRACTION.match(text):
            return [1, *(1 + k for k in self.piece(text[1:-1])), self.piece(text)[-1]]
        return self.piece(text)

    def plain(self, text: str) -> list[int]:
        out, base = [], 0
        for u in self.patterns.unit.findall(text):
            out += (base + k for k in self.unit(u))
            base = out[-1]
        return out

    def __missing__(self, unit: str) -> bytes:
        if not unit.isascii():
            self.check_classes(unit)
        n = self.unit(unit)
        found = bytes([b - a & 255 for a, b in zip([0, *n], n)])
        if len(unit) <= 64:
            if len(self) > MEMO:
                self.clear()
            self[unit] = found
        return found

    def table(self, text: str | None) -> bytes:
        """One signed byte for each code point: the change of the exact token count of the prefix."""
        while True:
            try:
                return self._table(text or "")
            except _Restart:
                continue

    def _table(self, text: str) -> bytes:
        if self.special is None or not (found := list(self.special.finditer(text))):
            return b"".join(map(self.__getitem__, self.patterns.unit.findall(text)))
        out, at = [], 0
        for m in found:
            part = text[at : m.start()]
            out += map(self.__getitem__, self.patterns.unit.findall(part))
            tail = self.patterns.tail.search(part).group()
            counts = self.plain(tail + m.group()[:-1])[len(tail) :]
            base = self.plain(tail)[-1] if tail else 0
            out.append(np.diff(np.array([base, *counts, base + 1]) - base).astype(np.int8).tobytes())
            at = m.end()
        out += map(self.__getitem__, self.patterns.unit.findall(text[at:]))
        return b"".join(out)


def counts(deltas: bytes) -> np.ndarray:
    """Token counts of all prefixes, the empty one first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas or b"", np.int8), dtype=np.int64)])


@lru_cache(maxsize=4)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_table(text: Column, model: str | None = None) -> Column:
    """Column of prefix tables (binary, a signed byte for each code point) of a text column."""

    @F.pandas_udf("binary")
    def build(texts: pd.Series) -> pd.Series:
        counter = _counter(model or tokenizer_path(MODEL))
        return texts.map(counter.table, na_action=None)

    return build(text)


def count_at(deltas: Column, prefix: Column) -> Column:
    """Exact token count of the first ``prefix`` code points (of the whole text where it is shorter)."""

    @F.pandas_udf("long")
    def read(tables: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(t[: max(0, int(n))], np.int8).sum(dtype=np.int64)) for t, n in zip(tables, lengths)])

    return read(deltas, prefix)


def truncation(deltas: Column, budget: int) -> Column:
    """Code points of the longest prefix whose own encoding has ``budget`` tokens or fewer."""

    @F.pandas_udf("long")
    def read(tables: pd.Series) -> pd.Series:
        return tables.map(lambda t: int(np.flatnonzero(counts(t) <= budget)[-1]))

    return read(deltas)


def totals(deltas: Column, limit: int) -> Column:
    """Struct of the whole text's count and whether it is over ``limit``."""

    @F.pandas_udf("n_tokens long, over_limit boolean")
    def read(tables: pd.Series) -> pd.DataFrame:
        n = np.array([np.frombuffer(t, np.int8).sum(dtype=np.int64) for t in tables], np.int64)
        return pd.DataFrame({"n_tokens": n, "over_limit": n > limit})

    return read(deltas)


def token_counts(docs: DataFrame, limit: int = LIMIT, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text, read from its prefix table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), totals(prefix_table(text, model), limit).alias("t"))
    return counted.select("doc_id", "n_bytes", "t.n_tokens", "t.over_limit")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
