"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, decontamination, language_id, line_dedup, nearest, quality, sentencepiece_codec, simhash, token_counts, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, removed int, h long, key string"
LONG = "The quick brown fox jumps over the lazy dog number. " * 8000
ROWS = [
    (1, "The cat sat on the mat and looked at the moon all night.", "en"),
    (1, "The cat sat on the mat and looked at the moon all night.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "  \n\t ", "fr"),
    (None, "Le chat est sur la table et regarde la lune toute la nuit.", "fr"),
    (5, LONG, "en"),
    (6, "Der Hund liegt unter dem Tisch und schläft den ganzen Tag.", "de"),
    (7, "12345 67 !!!", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "s", 0, 0.5, "x", 9, 1, "k") for i, t, g in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def _labels(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def test_token_counts(docs, none):
    rows = token_counts.token_counts(docs).collect()
    assert len(rows) == len(ROWS) and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert token_counts.token_counts(none).count() == 0


def test_quality(spark, docs, none):
    labels = _labels(spark, [(1, 1, 0), (5, 0, 0), (6, 1, 0), (6, 0, 1), (None, 1, 0), (4, None, None), (3, 0, 0)])
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(none, labels).count() == 0
    assert {r.score for r in quality.quality(docs, _labels(spark, [])).collect()} == {0.5}


def test_language(docs, none):
    content = language_id.dictionaries(language_id.training_sample(docs))
    rows = language_id.identify(docs, content).collect()
    assert len(rows) == len(ROWS) and all(r.lang_pred == "und" and not r.accepted for r in rows if r.doc_id in (2, 3, 4, 7))
    assert language_id.identify(none, language_id.dictionaries(language_id.training_sample(none))).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_sentencepiece(docs, none):
    out = docs.select("doc_id", "text", sentencepiece_codec.encode(F.col("text")).alias("ids")).withColumn("back", sentencepiece_codec.decode(F.col("ids")))
    assert all(r.back == (r.text or "") for r in out.collect())
    assert none.select(sentencepiece_codec.encode(F.col("text"))).count() == 0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.simhash_stage(docs.sparkSession, docs, "").collect()
    assert sorted((r.doc_id for r in kept), key=str).count(1) == 1


def test_line_dedup(docs, none):
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    assert (1, ROWS[0][1]) in texts and (5, LONG) in texts and (3, "") in texts and (2, None) in texts
    assert line_dedup.dedup_lines(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, ROWS[0][1], "x"), (2, None, "x"), (3, "", "x"), (None, ROWS[7][1], "x")], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id, r.kind) for r in decontamination.leaks(docs, items).collect()}
    assert found == {(1, 1, "verbatim"), (6, None, "verbatim")}
    assert decontamination.leaks(none, items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0


ITEM = "In March the farmer John sold 25 apples and 13 pears to Mary for 7 dollars a week in Boston. How many apples did John sell?"


def _leaks(spark, rows, item=ITEM):
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    return sorted((r.doc_id, r.kind) for r in decontamination.leaks(docs, items).collect())


def test_leaks_in_other_forms(spark):
    other = ITEM.replace("John", "Peter").replace("25", "31")
    rows = [(1, f"{other} \x03"), (2, ITEM.lower()), (3, ITEM.upper()), (4, other.replace("farmer ", "farmer\n").replace("to ", "to  ").replace("in Boston", "in\u00a0Boston").replace("did ", "did\t")), (5, ITEM.title())]
    assert _leaks(spark, rows) == [(1, "reparameterised"), (2, "verbatim"), (3, "verbatim"), (4, "reparameterised"), (5, "verbatim")]


def test_values_must_map_one_to_one(spark):
    """A value that recurs becomes one value, and two values don't become the same."""
    two_names = ITEM.replace("farmer John", "farmer Peter").replace("did John", "did Karl")
    one_number = ITEM.replace("25", "31").replace("13", "31").replace(" 7 ", " 31 ").replace("farmer John", "farmer Peter").replace("did John", "did Boris")
    merged = ITEM.replace("25", "31").replace("13", "31").replace("John", "Peter").replace("Mary", "Anna").replace("7", "9")
    kept = ITEM.replace("25", "31").replace("13", "19").replace("John", "Peter").replace("Mary", "Anna").replace("7", "9")
    assert _leaks(spark, [(1, kept), (2, merged), (3, one_number), (4, f"Well, {two_names.replace('25', '31').replace('13', '19').replace('Mary', 'Anna').replace('7', '9')}")]) == [(1, "reparameterised")]


def test_leak_beside_a_variant(spark):
    item = "A train with 40 red seats leaves the old station early and every one of the 40 seats is taken by a child"
    variant = item.replace("40 red", "31 red").replace("the 40", "the 57")
    moved = item.replace("40", "66")
    assert _leaks(spark, [(1, f"{item}. {variant}"), (2, variant), (3, f"{variant}. {moved}. {variant}")], item) == [(1, "verbatim"), (3, "reparameterised")]


def test_rows_without_or_with_equal_ids_are_told_apart(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = ["Nothing of that kind is in here at all.", "The cat sat on the mat all night.", ITEM[:60], ITEM[60:]]
    rows = [(i, t) for i in (None, 7) for t in [f"So. {ITEM}", *clean]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontamination.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, ((i, t) for i in (None, 7) for t in clean)))
    rows = [(1, clean[0]), (None, clean[0]), (None, clean[1]), (None, clean[1].upper()), (None, clean[2]), (5, clean[3]), (5, clean[0].upper())]
    kept = sorted((str(r.doc_id), r.text.lower()) for r in simhash.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert kept == [("1", clean[0].lower()), ("5", clean[3].lower()), ("None", clean[2].lower()), ("None", clean[1].lower())]


def test_nearest(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [0.9, 0.1]), (8, [0.9, 0.1]), (None, [1.0, 1.0]), (9, [2.0]), (10, [float("inf"), 0.0])]
    clashing = "label int, score double, v int, id string, list int, lists string, unit int, part int, bound double, copy int, rank int, query_id int"
    vectors = spark.createDataFrame([(*r, 1, 0.5, 2, "x", 3, "y", 4, 5, 0.1, 6, 7, 8) for r in rows], f"vec_id long, embedding array<float>, {clashing}")
    found = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest.search(vectors, F.col("id").isin(1, 7)).collect())
    assert found == [(1, 1, 2, 0.9), (1, 2, 8, 0.9), (7, 1, 9, 2.0)]
    assert nearest.search(vectors.limit(0), F.lit(True)).count() == 0


def test_nearest_is_whole_whatever_the_groups(spark):
    rng = np.random.default_rng(5)
    equal = [(i, [1.0, 2.0, 2.0]) for i in range(1, 401)]
    found = [(r.query_id, r.vec_id) for r in nearest.search(spark.createDataFrame(equal, "vec_id long, embedding array<float>"), F.col("id").isin(3, 300)).orderBy("query_id", "rank").collect()]
    assert found == [(3, i) for i in range(1, 22) if i != 3] + [(300, i) for i in range(1, 21)]
    few = [(i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((60, 4)))]
    x = np.array([v for _, v in few], np.float32).astype(float)
    found = nearest.search(spark.createDataFrame(equal[:0] + few, "vec_id long, embedding array<float>"), F.lit(True), k=80).toPandas()
    assert len(found) == 60 * 59 and np.allclose(found.score, (x[found.query_id] * x[found.vec_id]).sum(axis=1), atol=1e-12)


def test_nearest_of_many_equal_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1800, 24))
    x[rng.choice(1800, 300, replace=False)] = np.ones(24) * 2
    ids, q = rng.permutation(1800), np.ones(24)
    norm = float(np.linalg.norm(x, axis=1).max())
    coarse = nearest.Coarse(np.linalg.qr(rng.standard_normal((25, 25)))[0], norm, np.zeros((1, 25)))
    want = ids[np.lexsort((ids, -(x * q).sum(axis=1)))[:20]].tolist()
    for bound in (None, 48.0):
        asked = pd.DataFrame({"id": [-1], "v": [q], "bound": [bound]})
        assert nearest.scan(asked, pd.DataFrame({"id": ids, "v": list(x)}), coarse, 20)["id"].tolist() == want
    rows = [(i, [1.0, 0.5]) for i in range(200, 0, -1)] + [(1000 + i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.standard_normal((60, 2)) / 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r.vec_id for r in nearest.search(vectors, F.col("id") == 50).orderBy("rank").collect()] == list(range(1, 21))


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, spans int, n_turns string"
    rows = [(1, 1, "assistant", None, 0, ""), (1, 0, "user", "<|im_end|>", 0, ""), (1, 0, "user", "<|im_end|>", 0, ""), (None, 0, None, "x", 0, "")]
    out = {r.conv_id: r for r in chat_format.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].n_turns == 3 and chat_format.read_back(out[1].formatted) == [("user", "<|im_end|>")] * 2 + [("assistant", "")]
    assert chat_format.read_back(out[None].formatted) == [("", "x")]
    assert chat_format.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_url_filters(spark):
    captures = spark.createDataFrame([(1, "https://u@www.Bad.example.:8080/a/b?q#f", 10, "p"), (2, None, 5, "p"), (3, "nonsense", 5, "p"), (4, "http://bad.example/x", None, "p"), (5, "http://notbad.example/x", 10, "p"), (5, "http://bad.example", 20, "p")], "id long, url string, fetched_at long, pattern string")
    entries = spark.createDataFrame([("a", "domain", "bad.example", "add", 5), ("a", "domain", "bad.example", "add", 7), ("a", "domain", "bad.example", "remove", 20), ("b", "prefix", "www.bad.example/a/", "add", 10), ("b", "prefix", None, "add", 1)], "list_name string, kind string, pattern string, action string, effective_at long")
    got = {(r.id, r.url): (r.n_matches, r.blocked) for r in url_filters.judge(captures, entries).collect()}
    assert got[1, "https://u@www.Bad.example.:8080/a/b?q#f"] == (2, True)
    assert sum(n for n, _ in got.values()) == 2 and len(got) == 6
    assert url_filters.judge(captures.limit(0), entries).count() == 0
    assert url_filters.judge(captures, entries.limit(0)).where("blocked").count() == 0


def test_url_filters_by_letter_case_length_and_fraction(spark):
    when = lambda df: df.withColumn("at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    captures = when(spark.createDataFrame([(1, "http://Example.com/EN/x", 10.0), (2, "http://example.com/en/x", 10.0), (3, "http://b.example/abcd", 10.0), (4, "http://c.example/", 10.3), (5, "http://d.example/", 20.2)], "id long, url string, at double")).withColumnRenamed("at", "fetched_at")
    rows = [("prefix", "Example.com/EN/", "add", 1.0), ("prefix", "b.example/ab", "add", 1.0), ("host", "c.example", "add", 10.2), ("host", "c.example", "remove", 10.7), ("host", "d.example", "add", 11.0), ("host", "d.example", "remove", 20.5)]
    entries = when(spark.createDataFrame([("a", *r) for r in rows], "list_name string, kind string, pattern string, action string, at double")).withColumnRenamed("at", "effective_at")
    got = {r.id: r.blocked for r in url_filters.judge(captures, entries, part=2).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_url_filters_with_seconds_over_years(spark):
    rows = [(i, "http://a.example/x", i * 1000) for i in range(0, 100_000, 997)]
    captures = spark.createDataFrame([(i, u, t) for i, u, t in rows], "id long, url string, fetched_at long")
    entries = spark.createDataFrame([("l", "domain", "a.example", a, t) for a, t in (("add", 0), ("remove", 30_000_000), ("add", 60_000_001), ("remove", 94_000_000))] + [("m", "host", "a.example", "add", 50_000_000), ("m", "prefix", "a.example/X", "add", 0)], "list_name string, kind string, pattern string, action string, effective_at long")
    want = {i: int(t < 30_000_000 or 60_000_001 <= t < 94_000_000) + int(t >= 50_000_000) for i, _, t in rows}
    for part in (7, 50_000):
        assert {r.id: r.n_matches for r in url_filters.judge(captures, entries, part).collect()} == want
