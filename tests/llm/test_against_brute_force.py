"""Operators that SQL can't express, against brute force, the original libraries, or held-out labels."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, decontamination, language_id, line_dedup, nearest, quality, sentencepiece_codec, simhash, token_counts
from corpusloom.llm.common import tokenizer_path
from corpusloom.llm.queries import ORACLE_SQL, QUERIES

PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "'", "!", "##", "12", "é", "ß", "<|endoftext|>", "<|endof", "\x85", "\xa0", "　", "\x1c", "😀", "中", "S", " hello", "▁", "<s>", "<0x0A>"]
TEXTS = st.lists(st.sampled_from(PIECES) | st.text(max_size=3), max_size=8).map("".join)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(tokenizer_path(token_counts.MODEL))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(token_counts.MODEL))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_every_prefix_count(counter, library, text):
    want = [len(library.encode(text[:i], add_special_tokens=False)) for i in range(len(text) + 1)]
    assert token_counts.counts(counter.table(text)).tolist() == want


def test_budget_questions(spark):
    df = spark.createDataFrame([("one two three four",), ("",)], "text string").withColumn("d", token_counts.prefix_table(F.col("text")))
    rows = df.select("text", token_counts.truncation(F.col("d"), 2).alias("cut"), token_counts.count_at(F.col("d"), F.lit(7)).alias("at")).collect()
    assert [(r.cut, r.at) for r in rows] == [(len("one two"), 2), (0, 0)]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_sentencepiece_parity(codecs, text):
    own, other = codecs
    ids = own.encode([text])[0]
    assert ids.tolist() == other.encode(text) and own.decode(ids) == other.decode(ids.tolist())


@pytest.fixture(scope="module")
def codecs():
    import sentencepiece

    path = tokenizer_path(sentencepiece_codec.MODEL)
    return sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_sentencepiece_parity_on_documents(spark, small):
    assert sentencepiece_codec.parity(spark.read.parquet(f"{small}/documents.parquet")).where("not same").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x<|\n\\n"]), st.lists(st.sampled_from(["<", "|", chat_format.GUARD, "im_end", "<|im_start|>", "<|im_end|>\n", "a", "\n"]), max_size=7).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    out = chat_format.compile_template()([{"role": r, "text": t} for r, t in turns])
    assert chat_format.read_back(out.text) == turns
    assert [chat_format.unescape(out.text[s:e]) for s, e in out.spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    run = chat_format.compile_template("{% set a = 'x' ~ 1 %}{% for m in messages %}{% if loop.first and not loop.last %}[{% elif m.role in 'ab' %}({% else %}{{ a | upper }}{% endif %}{{ m['text'] | trim }}{% endfor %}")
    assert run([{"role": "q", "text": " 1 "}, {"role": "a", "text": "2"}, {"role": "q", "text": "3"}]).text == "[1(2X13"
    folded = chat_format.fold(chat_format.parse("{{ 'a' + 'b' }}c{% if false %}{{ x }}{% endif %}"))
    assert folded == [chat_format.Put(chat_format.Const("abc"))]
    for bad in ("{{ x.__class__() }}", "{% while x %}", "{{ 'a' | exec }}", "{% if x %}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits,hot", [(1, 200), (1, 3), (2, 200), (2, 3), (3, 3)])
def test_edit_links(spark, edits, hot):
    random.seed(edits)
    lines = {"".join(random.choice("abé😀 e") for _ in range(random.randint(20, 26))) for _ in range(15)}
    for base in list(lines) * 8:
        signs = list(base)
        for _ in range(random.randint(1, 3)):
            k, kind = random.randrange(len(signs)), random.random()
            signs[k : k + (kind > 0.3)] = [random.choice("abe")] * (kind < 0.7)
        lines.add("".join(signs))
    lines = sorted(x for x in lines if len(x) >= 20)
    df = line_dedup.measured(spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line"))
    got = {tuple(sorted((r.line, r.other))) for r in line_dedup.edit_links(df, edits, hot).collect()}
    assert got == {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if _distance(a, b) <= edits}


def test_template_lines_make_few_candidates(spark):
    """Lines that share half of their text, or all but some digits, meet in proportion to their number, not to its square."""
    random.seed(2)
    n = 3000
    lines = {f"{random.randrange(10**9, 10**10)} the package left the depot" for _ in range(n)} | {f"page {i:05d} of the yearly report of the office" for i in range(n)}
    lines |= {x + "s" for x in list(lines)[::3]}
    df = line_dedup.measured(spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line"))
    assert line_dedup.candidates(df).count() < 120 * len(lines)
    got = {tuple(sorted((r.line, r.other))) for r in line_dedup.edit_links(df).collect()}
    holes = {}
    for x in lines:
        for i in range(len(x)):
            holes.setdefault((x[:i], x[i + 1 :]), []).append(x)
    want = {(a, b) for group in holes.values() for a in group for b in group if a < b}
    want |= {tuple(sorted((x, a + b))) for x in lines for a, b in ((x[:i], x[i + 1 :]) for i in range(len(x))) if a + b in lines}
    assert got == want and len(want) > n


def test_golay_code():
    words = np.arange(0, 1 << 23, 997)
    own, keys = simhash.fuzzy_keys(words)
    assert {len(set(k)) for k in keys.tolist()} <= {1, 6}
    for bit in range(23):
        assert (simhash.decode(words ^ (1 << bit))[:, None] == keys).any(axis=1).all()


def test_simhash_components(spark):
    random.seed(5)
    prints = {0}
    for _ in range(60):
        x = random.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for _ in range(random.randint(1, 4)):
                x ^= 1 << random.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert got == {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if 1 <= bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}


def test_simhash_fingerprint():
    import xxhash

    text = "The the  CAT\tsat Éa on"
    words = ["the", "the", "cat", "sat", "Éa", "on"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert simhash.fingerprint("One") == xxhash.xxh64_intdigest("one", 42) and simhash.fingerprint(None) == 0


def test_decontamination_by_brute_force(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{x}.parquet") for x in ("documents", "benchmark"))
    rows = [(r.doc_id, r.raw) for r in decontamination.tokens(docs, "doc_id").select("doc_id", "raw").collect()]
    asked = [(r.item_id, r.raw) for r in decontamination.tokens(items, "item_id").select("item_id", "raw").collect()]

    def cut(raw):
        kind = [t[0] if t[0] in "\x02\x03\x04" else t for t in raw]
        wins = [tuple(raw[i : i + 5] if sum(len(k) == 1 and k in "\x02\x03\x04" for k in kind[i : i + 5]) > 3 else kind[i : i + 5]) for i in range(len(raw) - 4)]
        return set(wins) if len(raw) >= 5 else {tuple(raw)} if raw else set()

    docs_cut = [(i, cut(r)) for i, r in rows]
    want = {(i, j) for j, item in ((j, cut(r)) for j, r in asked) for i, d in docs_cut if item and len(item & d) >= 0.8 * len(item)}
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert got == want and want


def test_reparameterised_questions(spark):
    item = "In March the farmer John sold 25 apples and 13 pears to Mary for 7 dollars a week in Boston. How many apples did John sell?"
    same = item.replace("John", "Peter").replace("25", "31").replace("Mary", "Anna")
    mixed = "In March the farmer Peter sold 31 apples and 19 pears to Anna for 9 dollars a week in Denver. How many apples did Karl sell and when did Peter or John or Mary sell?"
    docs = spark.createDataFrame([(1, f"So. {same}"), (2, item), (3, "Nothing of that kind is in here at all."), (4, mixed)], "doc_id long, text string")
    found = {r.doc_id: r.kind for r in decontamination.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {1: "reparameterised", 2: "verbatim"}


def test_nearest_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    found = QUERIES["op9_nearest_neighbours"](spark, small).toPandas()
    hits = 0
    for q, g in found.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, [s[ids == v][0] for v in g.vec_id], atol=1e-12)
        hits += len(set(g.vec_id) & set(ids[np.lexsort((ids, -s))[:20]]))
    assert len(found) == 20 * 25 and hits >= 0.9 * len(found)


def test_held_out_accuracy(spark, small):
    sf = small.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet").toPandas() for x in ("documents", "labels"))
    lang = QUERIES["op5_language_id"](spark, sf).toPandas().merge(docs, on="doc_id")
    assert (lang.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in lang.doc_id]).all()
    assert (lang[lang.held_out].lang == lang[lang.held_out].lang_pred).mean() > 0.97
    good = QUERIES["op1_quality_classifier"](spark, sf).toPandas().merge(labels, on="doc_id")
    assert (good[good.held_out].quality == good[good.held_out].predicted).mean() > 0.93


def test_moments_are_shrunk():
    found = {k: quality.Moments(50.0, np.full(12, float(k)), np.zeros((12, 12))) for k in (0, 1)}
    model = quality.fit(found)  # a covariance of zeros still has a factor
    assert model.score(np.array([np.zeros(12), np.ones(12)])).round(6).tolist() == [0.0, 1.0]


def test_language_sample_is_bounded(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert language_id.training_sample(docs, 3).groupBy("lang").count().where("count > 3").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(cur.fetchall(), key=repr) == sorted((tuple(r[n] for n in names) for r in QUERIES[name](spark, small).collect()), key=repr)


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    step, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, small)
        rows = out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns
            step = spark.createDataFrame(rows, docs.schema)
        seen.append(len(rows))
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.8 * docs.count()
    assert corpus_pipeline.run(spark, small).count() == seen[-1]
