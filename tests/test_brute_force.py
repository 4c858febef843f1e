"""Registered queries without SQL against plain Python over the same small tables."""

import difflib
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, dedupe, windows
from corpusloom.plans import all_queries

QUERIES, _ = all_queries()


@pytest.fixture(scope="module")
def texts(spark):
    from conftest import SMALL

    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def _flat(t):
    return " ".join(t.split())


def test_paragraphs(spark, small, texts):
    def one(text):
        lines, kept, want = (text or "").split("\n"), [[]], 1
        for x in lines:
            m = re.match(r"\s*(\d{1,3})[.)]\s", x)
            if m and int(m[1]) == want:
                kept.append([x[m.end() :]])
                want += 1
            else:
                kept[-1].append(x)
        if want > 3:
            found = [(n, _flat("\n".join(p))) for n, p in enumerate(kept)]
        else:
            found = [(n, t) for n, t in enumerate((t for t in map(_flat, re.split(r"\n\s*\n", text or "")) if len(t) >= 40), 1)]
        return [(n, t) for n, t in found if len(t) >= 40]

    got = sorted((r.doc_id, r.n, r.text) for r in QUERIES["paragraphs"](spark, small).collect())
    assert got == sorted((d, n, t) for d, x in texts.items() for n, t in one(x))
    own = "Head\n1. " + "a" * 40 + "\nmore\n2) " + "b" * 50 + "\n9. nine\n3. " + "c" * 41
    df = spark.createDataFrame([(own,), (None,), ("",)], "t string").select(chunking.paragraphs(F.col("t")).alias("p"))
    assert [[tuple(x) for x in r.p] for r in df.collect()] == [[(1, "a" * 40 + " more"), (2, "b" * 50 + " 9. nine"), (3, "c" * 41)], [], []]


def test_chunks_at_spaces(spark, small, texts):
    got = {}
    for r in QUERIES["chunk_spaces"](spark, small).collect():
        got.setdefault(r.doc_id, {})[r.n] = r.chunk
    for d, text in texts.items():
        flat, at, want = _flat(text or ""), 0, []
        while at < len(flat):
            end = at + 1200
            if end < len(flat):
                space = flat.rfind(" ", at + 600, end)
                end = space if space > 0 else end
            want.append(flat[at:end].strip())
            at = end
        assert [got.get(d, {}).get(n) for n in range(len(want))] == [w for w in want if w] and "".join(want).replace(" ", "") == flat.replace(" ", "")


def test_prefixed_chunks(spark, small, texts):
    got = {}
    for r in QUERIES["chunk_prefixed"](spark, small).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, text in texts.items():
        words, rows = (text or "").split(), got[d]
        assert [r.n for r in rows] == list(range(1, len(rows) + 1))
        room, at, body = 118, 0, []  # "Source x:" are two words of 120
        while at < len(words):
            body.append(words[at : at + room])
            if at + room >= len(words):
                break
            at += room - 20
        for r, want in zip(rows, body or [[]], strict=True):
            assert r.chunk.split()[0] == "Source" and r.chunk.split()[2:] == want and (not want or text[r.start : r.stop].split() == want)


def test_document_units(spark, small, texts):
    opens = re.compile(r"\s*(\(?\d{1,3}[.)]|[A-Z][A-Z ,&'-]{3,}:?\s*$)")
    got = {}
    for r in QUERIES["document_units"](spark, small).orderBy("doc_id", "part").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for d, text in texts.items():
        units = [[]]
        for x in (text or "").split("\n"):
            if not x.strip(" ") or opens.match(x):
                units.append([])
            units[-1].append(x)
        parts = []
        for u in (u for u in ("\n".join(u).strip(" ") for u in units) if u):
            if parts and len(parts[-1]) + 1 + len(u) <= 2000:
                parts[-1] += "\n" + u
            else:
                parts.append(u)
        assert got.get(d, []) == parts


def test_greedy_numbering(spark, small, texts):
    for r in QUERIES["greedy_numbering"](spark, small).collect():
        found, want = [int(x) for x in re.findall(r"(?a)\b(\d{1,3})\b", texts[r.doc_id] or "")], 1
        for n in found:
            want += n == want
        assert (r.n_kept, r.n_found) == (want - 1, len(found))


def test_seeded_sample(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", F.xxhash64("doc_id", F.lit(42)).alias("h")).collect()
    by_source = {}
    for r in sorted(docs, key=lambda r: (r.h, r.doc_id)):
        by_source.setdefault(r.source, []).append(r.doc_id)
    got = sorted((r.source, r.doc_id) for r in QUERIES["seeded_sample"](spark, small).collect())
    assert got == sorted((s, d) for s, ids in by_source.items() for d in ids[:3])


def test_links(spark, small):
    class Anchors(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.open = [], None

        def handle_starttag(self, tag, attrs):
            href = dict(attrs).get("href")
            if tag == "a" and href:
                self.open = (href, [])
            elif self.open:
                self.open[1].append(" ")

        def handle_data(self, data):
            if self.open:
                self.open[1].append(data)

        def handle_endtag(self, tag):
            if tag == "a" and self.open:
                self.found.append((self.open[0], _flat("".join(self.open[1]))))
                self.open = None

    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {}
    for r in QUERIES["html_links"](spark, small).orderBy("page_id", "at").collect():
        got.setdefault(r.page_id, []).append((r.target, r.title))
    for p in pages:
        parser, seen = Anchors(), {}
        parser.feed(p.html or "")
        for href, title in parser.found:
            target = urljoin(p.url or "", href.strip())
            seen[target] = seen.get(target) or title
        assert got.get(p.page_id, []) == list(seen.items())


def test_fuzzy_titles(spark):
    random.seed(1)
    held = [(i, " ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(3, 8))) for _ in range(3))) for i in range(60)]

    def spoilt(t, n):
        for _ in range(n):
            k = random.randrange(len(t))
            t = t[:k] + random.choice(["", "x", "yz"]) + t[k + random.randint(0, 1) :]
        return t

    asked = [(i, spoilt(random.choice(held)[1], random.choice([0, 1, 2, 3, 9]))) for i in range(150)] + [(900, None), (901, "")]
    got = {r.id: (r.match, r.how) for r in dedupe.fuzzy_titles(spark.createDataFrame(asked, "id long, title string"), spark.createDataFrame(held, "held_id long, title string")).collect()}
    squash = lambda t: re.sub("[^0-9a-z]", "", (t or "").lower())
    for i, t in asked:
        k = squash(t)
        scored = sorted(((-difflib.SequenceMatcher(None, k, squash(h)).ratio(), j) for j, h in held)) if k else []
        best = [x for x in scored if -x[0] >= 0.85][:1]
        want = (best[0][1], "exact" if best[0][0] == -1 else "near" if -best[0][0] >= 0.93 else "possible") if best else (None, None)
        assert got[i] == want, (t, want)


def test_packing_and_sequences(spark):
    rows = spark.createDataFrame([(["a", "bb", "ccc", "d" * 9, "e"],), ([],), (None,)], "x array<string>").select(chunking.packed(F.col("x"), 6).alias("p")).collect()
    assert [r.p for r in rows] == [["a\nbb", "ccc", "d" * 9, "e"], [], []]
    rows = spark.createDataFrame([([5, 1, 1, 3, 2, 3],)], "x array<int>").select(windows.sequence_numbers(F.col("x")).alias("p")).collect()
    assert rows[0].p == [1, 2, 3]
