"""The stored index, question tables, vector shards, reloaded tables and staged streams against plain computations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lexical, questions as Q, retrieval as R
from corpusloom.sources import shards, versions
from corpusloom.streaming import staging

WORDS = [f"w{n}" for n in range(30)]


def _docs(rnd, n):
    return [(i, [rnd.choice(WORDS[: 3 + i % 28]) for _ in range(rnd.randrange(12))], rnd.choice([None, [], ["w1", None, "w2"]])) for i in range(n)]


def _bm25(docs, terms, weights=(1.0, 3.0)):
    tf, out = {}, {}
    for i, *fields in docs:
        own = {}
        for w, f in zip(weights, fields):
            for t in f or []:
                if t is not None:
                    own[t] = own.get(t, 0) + w
        if own:
            tf[i] = own
    mean = sum(sum(x.values()) for x in tf.values()) / len(tf)
    for t in {t for t in terms if t}:
        df = sum(t in x for x in tf.values())
        for i, x in tf.items():
            if t in x:
                idf = math.log(1 + (len(tf) - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0) + idf * x[t] * 2.5 / (x[t] + 1.5 * (0.25 + 0.75 * sum(x.values()) / mean))
    return sorted(((i, round(s, 9)) for i, s in out.items()), key=lambda r: (-r[1], r[0]))


def test_index_is_bm25_over_segments_and_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 40)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rnd, path = random.Random(4), f"file://{tmp_path}/index"
    docs = _docs(rnd, 300)
    for part in (docs[:170], docs[170:299], docs[299:]):
        lexical.add_documents(spark.createDataFrame(part, "id long, body array<string>, head array<string>"), "id", {"body": 1.0, "head": 3.0}, path)
    blocks = lexical.open_index(spark, path)
    asked = [(q, [rnd.choice([*WORDS, "absent", None]) for _ in range(rnd.randrange(6))]) for q in range(25)]
    frame = spark.createDataFrame(asked, "qid long, terms array<string>")
    for k in (1, 7, None):
        got = {}
        for r in lexical.search(blocks, frame, k).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.key, r.score))
        for q, terms in asked:
            want = _bm25(docs, terms)[:k]
            assert [i for i, _ in got.get(q, [])] == [i for i, _ in want]
            assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=2e-9)
    monkeypatch.setattr(lexical, "LISTED_TERMS", 2)  # terms joined instead of listed
    again = {(r.qid, r.key) for r in lexical.search(blocks, frame, 7).collect()}
    assert again == {(q, i) for q, t in asked for i, _ in _bm25(docs, t)[:7]}


def test_index_reads_few_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.range(400).select("id", F.array(*(F.concat(F.lit("t"), ((F.col("id") * k) % 97).cast("string")) for k in (1, 3, 7))).alias("w"))
    lexical.add_documents(docs, "id", {"w": 1.0}, path)
    asked = spark.range(1).select(F.lit(0).alias("qid"), F.array(F.lit("t5"), F.lit("t9")).alias("terms"))
    plan = lexical.search(lexical.open_index(spark, path), asked, 5)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan parquet" in x]
    assert scans and all("PartitionFilters: [bucket" in x and "In(term" in x for x in scans)


def test_vectors_of_many_questions(spark, monkeypatch):
    monkeypatch.setattr(Q, "QUESTIONS", 7)
    monkeypatch.setattr(Q, "VECTORS", 40)
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(60, 5)).round(2)
    rows = [(i, [float(x) for x in base[i % 60]]) for i in range(180)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5)]
    asked = [(q, [float(x) for x in rnd.normal(size=5)]) for q in range(20)] + [(50, None)]
    vectors = spark.createDataFrame(rows, "key long, embedding array<float>")
    frame = spark.createDataFrame(asked, "qid long, vector array<double>")
    exact = {i: [np.float32(x).item() for x in v] for i, v in rows if i < 900}
    got = {(r.qid, r["rank"]): r.key for r in Q.vector_topk(frame, vectors, 9).collect()}
    for q, v in asked[:-1]:
        order = sorted(exact, key=lambda i: (-round(float(np.dot(v, exact[i])), 9), i))[:9]
        assert [got[q, r] for r in range(1, 10)] == order
    assert len(got) == 180 and Q.vector_topk(frame, vectors.limit(0), 9).count() == 0


def test_router_options(spark):
    vectors = spark.createDataFrame([(i, [math.cos(i), math.sin(i)], "core" if i % 3 else "more") for i in range(30)], "key long, embedding array<double>, part string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], ["x"], "core", [7]), (2, [0.0, 1.0], [], "merged", None)], "qid long, vector array<double>, terms array<string>, branch string, hint_ids array<long>")
    plain = Q.routed(asked, vectors, None, R.SearchOptions(k=3, hybrid=False, hints=False, fetch_factor=2)).orderBy("qid", "rank").collect()
    cos = sorted((i for i in range(30) if i % 3), key=lambda i: -math.cos(i))
    assert [r.key for r in plain if r.qid == 1] == cos[:3] and [r.passes for r in plain if r.qid == 1] == [math.cos(i) >= 0.65 for i in cos[:3]]
    sin_core = sorted((i for i in range(30) if i % 3), key=lambda i: -math.sin(i))[:6]
    sin_more = sorted((i for i in range(30) if not i % 3), key=lambda i: -math.sin(i))[:3]
    for keep in (0, 2):
        lift = lambda i: math.sin(i) + (0.5 if i == sin_more[1] else 0)
        rest = sorted([*sin_core[keep:], *sin_more], key=lambda i: -lift(i))
        got = Q.routed(asked, vectors, None, R.SearchOptions(k=3, hybrid=False, hints=False, fetch_factor=2, keep_top=keep, priority=0.5, priority_ids=(sin_more[1],)))
        assert [r.key for r in got.where("qid = 2").orderBy("rank").collect()] == [*sin_core[:keep], *rest][:3]
    hinted = Q.routed(asked, vectors, None, R.SearchOptions(k=3, hybrid=False, fetch_factor=2, word_floor=-1.0)).where("qid = 1").collect()
    assert 7 in {r.key for r in hinted}  # a hint's rank fuses it in


def test_shards_resume(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    texts = spark.range(500).select(F.when(F.col("id") % 50 != 0, F.concat(F.lit("t"), (F.col("id") % 300).cast("string"))).alias("text"))
    distinct = texts.where("text is not null").distinct().count()
    embed = lambda t: F.array(F.length(t).cast("double"), F.crc32(t.cast("binary")).cast("double"))
    one = shards.embed_missing(texts, path, "m", embed, step_rows=40, steps=2)
    assert not one.complete and one.steps == 2 and 0 < one.embedded < distinct and one.embedded + one.missing == distinct == one.texts
    before = {r.key: r.vector for r in shards.vectors(spark, path).collect()}
    spark.range(3).select(F.lit("ab").alias("key"), F.lit(171).alias("unit"), F.array(F.lit(0.0)).alias("vector")).write.parquet(f"{path}/vectors/{'0' * 32}")  # a step that died before its line
    spark.range(1).select(F.lit("1" * 32).alias("shard"), F.lit(3).alias("unit"), F.lit(9).alias("n"), F.lit("embedded").alias("source"), F.current_timestamp().alias("at")).write.mode("append").json(f"{path}/log")  # a line whose shard is gone
    two = shards.embed_missing(texts, path, "m", embed, step_rows=40)
    assert two.complete and two.reused == one.embedded and two.embedded == distinct - one.embedded and two.missing == 0
    after = shards.vectors(spark, path).collect()
    assert len(after) == len({r.key for r in after}) == distinct and before.items() <= {r.key: r.vector for r in after}.items()
    assert shards.embed_missing(texts, path, "m", embed).embedded == 0
    held = shards.assembled(texts.where("text is not null"), path, "m")
    assert held.count() == texts.where("text is not null").count() and held.where(F.get("vector", F.lit(0)) != F.length("text")).count() == 0
    # a shard that lost rows isn't believed, and its texts are done again
    broken = shards.believed(spark, path)[0]
    spark.read.parquet(f"{path}/vectors/{broken}").limit(1).write.mode("append").parquet(f"{path}/vectors/{broken}")
    assert broken not in shards.believed(spark, path)
    three = shards.embed_missing(texts, path, "m", embed)
    assert three.complete and three.embedded > 0 and shards.vectors(spark, path).select("key").distinct().count() == distinct


def test_shards_are_seeded(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    earlier = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("b", [2.0]), (None, [3.0])], "text string, vector array<double>")
    assert shards.seed(earlier, path, "m", expected=5) == 0 and shards.seed(earlier, path, "m", expected=4) == 2 and shards.seed(earlier, path, "m", expected=4) == 0
    told = shards.embed_missing(spark.createDataFrame([("a",), ("c",)], "text string"), path, "m", lambda t: F.array(F.lit(9.0)))
    assert (told.reused, told.embedded) == (1, 1)


def test_reloaded_by_signature(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = versions.Reloaded(spark, (path,), lambda s, p: s.read.parquet(p), lambda f: None if "v" in f.columns else "no column v")
    assert table.get() is None and table.reason == "files are gone" and table.loads == 0
    spark.range(3).withColumn("v", F.lit(1)).write.parquet(path)
    assert table.get().count() == 3 and table.get().count() == 3 and table.loads == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert table.get() is None and table.get() is None and table.reason == "no column v" and table.loads == 2  # tried once
    spark.range(4).withColumn("v", F.lit(2)).write.mode("overwrite").parquet(path)
    assert table.get().count() == 4 and table.loads == 3 and table.reason is None


def test_reparse(spark):
    state = [("u1", "s", "p1", "changed", "d1", "r1"), ("u2", "s", "p2", "quarantined", "d2", "r2"), ("u3", "s", "p3", "new", "d3", "r3"), ("u4", "s", None, "new", "d4", "r4"), ("u5", "s", "p5", "new", "d5", "r5")]
    originals = [("p1", 1, "old"), ("p1", 2, "ONE  text"), ("p2", 1, "two text"), ("p3", 1, "one TEXT"), ("p5", 1, "x")]
    got = versions.reparsed(
        spark.createDataFrame(state, "url string, source string, original_url string, outcome string, fetched_at string, run_id string"),
        spark.createDataFrame(originals, "url string, saved_at int, content string"),
        lambda c: F.lower(F.regexp_replace(c, " +", " ")), lambda t: F.when(F.length(t) < 3, "near-empty"),
    )
    assert {r.url: (r.outcome, r.reason, r.fetched_at, r.record) for r in got.collect()} == {
        "u1": ("changed", None, "d1", "one text"), "u2": ("new", None, "d2", "two text"), "u3": ("quarantined", "same text as u1", "d3", None),
        "u4": ("error", "no original", "d4", None), "u5": ("quarantined", "near-empty", "d5", None),
    }


def _staged(rows, skip):
    """Plain run over fetched rows in order: state by url and by text."""
    last, holder, first, out = {}, {}, {}, []
    for r in sorted(rows, key=lambda r: (r["run"], r["seq"])):
        url, h = r["url"], r["hash"]
        if url in last and r["fetched_at"] - last[url][1] < skip:
            out.append((r["run"], r["seq"], "skipped_recent"))
            continue
        if r["error"]:
            out.append((r["run"], r["seq"], "error"))
            continue
        before = last[url][0] if url in last else None
        last[url] = h, r["fetched_at"]
        if before == h:
            out.append((r["run"], r["seq"], "unchanged"))
            continue
        if before is not None and holder.get(before) == url:
            del holder[before]
        if r["core"]:
            outcome = "already_held"
        elif h in first and first[h][0] == r["run"] and first[h][1] != url:
            outcome = "quarantined"
        elif h in holder and holder[h] != url:
            outcome = "already_held"
        else:
            first[h] = r["run"], url
            outcome = "quarantined" if r["problem"] else "changed" if before is not None else "new"
            if not r["problem"]:
                holder[h] = url
        out.append((r["run"], r["seq"], outcome))
    return sorted(out)


def test_staged_stream_over_restarts(spark, tmp_path):
    import datetime

    rnd, rows, seq = random.Random(8), [], itertools.count()
    start = datetime.datetime(2024, 1, 1)
    schema = staging.FETCHED
    for run in range(4):
        for url in rnd.sample(range(25), 18):
            at = start + datetime.timedelta(days=run, hours=rnd.choice([-30, 0, 5]) if run else 0)
            rows.append({"url": f"u{url}", "seq": next(seq), "run": f"r{run}", "source": f"s{url % 3}", "hash": f"h{rnd.randrange(14)}", "fetched_at": at, "core": rnd.random() < 0.05, "problem": rnd.choice([None] * 8 + ["short"]), "error": rnd.choice([None] * 9 + ["timeout"])})
    inbox, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for run in range(4):  # each run is a query of its own that goes on from the checkpoint
        spark.createDataFrame([r for r in rows if r["run"] == f"r{run}"], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = staging.staged(spark.readStream.schema(schema).parquet(inbox), skip_hours=20)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r.run, r.seq, r.outcome) for r in got.collect()) == _staged(rows, datetime.timedelta(hours=20))
    assert {r.outcome for r in got.collect()} >= {"new", "changed", "unchanged", "already_held", "quarantined", "skipped_recent", "error"}
    log = staging.run_log(got).collect()
    assert sum(r.new + r.changed + r.unchanged + r.already_held + r.quarantined + r.skipped_recent + r.error for r in log) == len(rows)


def test_chosen(spark):
    rows = [("r", "a", 1, n, f"u{n % 5}", n in (3, 4), 2.0) for n in range(8)] + [("r", "b", 2, n, f"v{n}", False, 2.0) for n in range(5)]
    listing = spark.createDataFrame(rows, "run string, source string, source_order int, seq int, url string, priority boolean, cost double")
    got = {(r.source, r.seq): r.status for r in staging.chosen(listing, F.lit(3), 5.0).collect()}
    # priority first: 3, 4, then 0; 5 to 7 repeat urls; the budget of five seconds is over after three documents
    assert [k for k, v in got.items() if v == "do"] and {k for k, v in got.items() if v == "do"} == {("a", 3), ("a", 4), ("a", 0)}
    assert {k for k, v in got.items() if v == "listed twice"} == {("a", 5), ("a", 6), ("a", 7)} and {k for k, v in got.items() if v == "over the cap"} == {("a", 1), ("a", 2), ("b", 3), ("b", 4)}
    assert {k for k, v in got.items() if v == "budget spent"} == {("b", 0), ("b", 1), ("b", 2)}


def test_terms_are_counted_by_the_batch(spark):
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from corpusloom.operators import lexical

    rnd = random.Random(5)
    some = lambda: rnd.choice([None, [], [rnd.choice(["a", "b", "é", "", None, "word"]) for _ in range(rnd.randrange(9))]])
    rows = [(i, some(), some()) for i in range(300)]
    docs = spark.createDataFrame(rows, "k long, x array<string>, y array<string>").repartition(3)
    counted = docs.select("k", lexical._counts([1.0, 2.5])(F.col("x"), F.col("y")).alias("c"))
    for r in counted.select("k", "c.len", "c.x").collect():
        want = Counter()
        for weight, tokens in zip((1.0, 2.5), rows[r.k][1:]):
            for token in tokens or []:
                if token is not None:
                    want[token] += weight
        assert r.len == sum(want.values())
        pairs = [(p.term, p.f) for p in r.x]
        assert sorted(pairs) == sorted([*want.items(), (lexical.EVERY, r.len)] if r.len else [])
