"""Cases that earlier versions missed: coinciding values, repeats of short lines, samples bounded in bytes, hot hosts."""

import random

from pyspark.sql import functions as F

from corpusloom.llm import decontamination, language_id, line_dedup, token_counts, url_filters
from corpusloom.llm.common import tokenizer_path

ITEM = "A baker sells 12 loaves and 5 rolls every morning at the old market near the river. On Friday the baker named Karim keeps 12 loaves for the school. How many loaves are then left for others?"


def _found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.kind, r.n_found == r.n_windows) for r in decontamination.leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()}


def test_values_that_coincide_are_still_a_leak(spark):
    both_eight = ITEM.replace("12", "8").replace("5", "8")
    renamed = both_eight.replace("Karim", "Peter")
    torn = ITEM.replace("12", "9", 1)  # the same value became 9 and 12: another question, but for the words that are the same
    clean = "A gardener waters 12 trees and 5 beds every evening in the new park behind the hill. How many trees are dry?"
    found = _found(spark, [both_eight, renamed, f"Before. {renamed} After.", torn, clean])
    assert {i: k for i, (k, _) in found.items() if i < 3} == {0: "reparameterised", 1: "reparameterised", 2: "reparameterised"} and 4 not in found
    assert all(whole for i, (_, whole) in found.items() if i < 3)


def test_repeats_of_short_lines_go(spark):
    rows = [(1, "Menu\n\n---\nfirst text line that is long enough\nMenu"), (2, "Menu\n---\nanother text line that is quite long"), (3, "Home"), (4, "Home"), (5, "}\n}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert kept == {1: "Menu\n\n---\nfirst text line that is long enough", 2: "---\nanother text line that is quite long", 3: "Home", 5: "}\n}"}


def test_language_sample_is_bounded_in_bytes(spark):
    rnd = random.Random(6)
    words = {g: [f"{chr(97 + g % 26)}{chr(97 + g // 26)}{rnd.randrange(10**6)}" for _ in range(30)] for g in range(60)}
    rows = [(i, " ".join(rnd.choice(words[i % 60]) for _ in range(rnd.choice([3, 40, 400]))), f"l{i % 60}") for i in range(1200)] + [(5000 + i, "zz " * 3000, "huge") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sample = language_id.training_sample(docs, 10, 2000)
    sizes = {r.lang: r.n for r in sample.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert len(sizes) == 61 and max(sizes.values()) <= 2000 and sizes["huge"] == 2000  # none of its texts fits: the start of one
    content = language_id.dictionaries(sample)
    assert len(content) == 61 and max(map(len, content.values())) <= 2000 + 2 * 10 + len(language_id.MARK)


def test_hot_host_in_parts(spark):
    rnd = random.Random(7)
    captures = [(i, f"http://hot.example/{i % 3}/x", rnd.randrange(1000)) for i in range(400)] + [(1000 + i, f"http://c{i}.example/", rnd.randrange(1000)) for i in range(30)]
    turns = sorted(rnd.sample(range(1000), 12))
    entries = [("l", "domain", "hot.example", "add" if n % 2 == 0 else "remove", t) for n, t in enumerate(turns)] + [("l", "prefix", "hot.example/1/", "add", 500), ("m", "host", "c3.example", "add", 0)]
    active = lambda t: sum(x <= t for x in turns) % 2 == 1
    want = {i: int("hot" in u and active(t)) + int("/1/" in u and t >= 500) + int("c3." in u) for i, u, t in captures}
    frames = spark.createDataFrame(captures, "id long, url string, fetched_at long"), spark.createDataFrame(entries, "list_name string, kind string, pattern string, action string, effective_at long")
    for part in (9, 50_000):
        assert {r.id: r.n_matches for r in url_filters.judge(*frames, part).collect()} == want


def test_one_very_long_text_among_many(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(token_counts.MODEL))
    texts = [f"short text {i}" for i in range(50)] + ["a long text, again and again. " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
