"""OCR repair, archives, table functions and the as-of join of streams against plain computations."""

import datetime
import random
import re
import zipfile
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.operators import chunking, repair
from corpusloom.sources.archives import Archives
from corpusloom.streaming import asof

WORDS = "council wife court declare declared wishes again the gain a in to section land lord landlord s see".split()


def _plain_repair(text, counts, least):
    while True:
        pieces = re.findall(r"[A-Za-z]+|[^A-Za-z]+", text)
        out = list(pieces)
        for i in range(1, len(pieces) - 1):
            if pieces[i] != " " or not (pieces[i - 1].isalpha() and pieces[i + 1].isalpha()):
                continue
            a, b = pieces[i - 1].lower(), pieces[i + 1].lower()
            dotted = b == "s" and i + 2 < len(pieces) and pieces[i + 2].startswith(".")
            ending = len(b) <= 2 and b not in repair.SHORT_WORDS and not dotted
            if counts[a + b] >= least and counts[a] < counts[a + b] and (ending or counts[b] < counts[a + b]):
                out[i] = ""
        if out == pieces:
            return text
        text = "".join(out)


def test_repair_is_the_plain_one(spark):
    rnd, texts = random.Random(11), [None, "", "a b"]
    for _ in range(120):
        words = [rnd.choice(WORDS) for _ in range(25)]
        torn = []
        for w in words:
            if len(w) > 3 and rnd.random() < 0.25:
                cuts = sorted(rnd.sample(range(1, len(w)), rnd.choice([1, 1, 2])))
                w = " ".join(w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)]))
            torn.append(w.capitalize() if rnd.random() < 0.1 else w)
        texts.append(rnd.choice([" ", "  ", "\n"]).join([" ".join(torn[:12]), " ".join(torn[12:])]).replace("see s ", "see s. "))
    counts = Counter(w.lower() for t in texts if t for w in re.findall("[A-Za-z]+", t))
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.text for r in repair.repaired(rows, "k", repair.vocabulary(rows), least=10).collect()}
    want = {i: None if t is None else _plain_repair(t, counts, 10) for i, t in enumerate(texts)}
    assert got == want and sum(want[i] != t for i, t in enumerate(texts)) > 40
    assert repair.repaired(rows.limit(0), "k", repair.vocabulary(rows)).count() == 0


def test_archives(spark, tmp_path):
    spark.dataSource.register(Archives)
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("d")
            for n in range(10):
                z.writestr(f"d/{n}.txt", f"archive {a} member {n} " * 50)
                z.writestr(f"d/{n}.bin", b"\0" * 10)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    read = spark.read.format("archives").option("pattern", "*.txt").option("partBytes", "3000")
    rows = read.load(str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 12  # one archive is read by several tasks
    got = {(r.archive.rsplit("/", 1)[1], r.member): r.content.decode() for r in rows.collect()}
    assert got == {(f"{a}.zip", f"d/{n}.txt"): f"archive {a} member {n} " * 50 for a in range(3) for n in range(10)}
    assert read.load(f"file://{tmp_path}/1.zip").where("size = length(content)").count() == 10
    assert read.load(str(tmp_path / "broken.zip")).count() == 0


def test_table_functions_are_the_functions(spark):
    tables.register(spark)
    law = "Preamble\nSection 1 - Title\nOne line.\nCHAPTER II\nanother line\nSection 2A: Second\n\nSection 3. Third\nlast"
    docs = spark.createDataFrame([(1, law), (2, None), (3, "none"), (4, law.replace("Third", "3rd"))], "law long, text string")
    docs.createOrReplaceTempView("laws_for_udtf")
    got = spark.sql("SELECT * FROM section_rows(TABLE(laws_for_udtf), 'law', 'text')")
    want = chunking.sections(docs, "law").select("law", F.col("seq").cast("long").alias("seq"), "section", "heading", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
    texts = spark.createDataFrame([("a", "short\n\n" + "long enough block " * 4 + "\n \n" + "another one\nof two lines here, and more"), ("b", None)], "doc string, body string")
    texts.createOrReplaceTempView("texts_for_udtf")
    rows = spark.sql("SELECT * FROM paragraph_rows(TABLE(texts_for_udtf), 'doc', 'body', 30)").collect()
    want = texts.select("doc", F.explode(chunking.paragraphs(F.col("body"), 30)).alias("p")).select("doc", F.col("p.n").cast("long").alias("n"), "p.text").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and len(rows) == 2
    import pytest

    with pytest.raises(Exception, match="is asked for"):
        spark.sql("SELECT * FROM section_rows(TABLE(laws_for_udtf), 'law', 'nothing')").collect()


def test_first_later_over_streams(spark, tmp_path):
    rnd, start = random.Random(12), datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    left = [(rnd.choice("ab"), f"l{i}", rnd.randrange(4000)) for i in range(150)]
    right = [(rnd.choice("ab"), rnd.randrange(4000), f"p{i}") for i in range(60)]
    rows = [("left", k, i, at(s), None, s) for k, i, s in left] + [("right", k, None, at(s), p, s) for k, s, p in right]
    rows.sort(key=lambda r: r[5] + rnd.randrange(-200, 200))  # out of order within the lateness
    rows += [("right", k, None, at(9000), "end", 9000) for k in "ab"] + [("left", "a", "far", at(20000), None, 20000)]
    schema = "side string, key string, id string, at timestamp, payload string, s long"
    inbox, mark, out = (f"{tmp_path}/{x}" for x in ("in", "mark", "out"))
    for n in range(4):  # four runs, each of which goes on where the last one ended
        part = rows[n * len(rows) // 4 : (n + 1) * len(rows) // 4]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        found = asof.first_later(stream.where("side = 'left'"), stream.where("side = 'right'"), "10 minutes")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.id: (r.right_at, r.payload) for r in spark.read.parquet(out).collect()}
    ends = [*right, ("a", 9000, "end"), ("b", 9000, "end")]
    want = {i: (lambda s, p: (at(s), p))(*min((t, p) for g, t, p in ends if g == k and t >= s)) for k, i, s in left}
    assert got == want


def test_pairs_of_a_text_are_made_once(spark, monkeypatch):
    from corpusloom.operators import repair

    written = []
    keep = repair.stored
    monkeypatch.setattr(repair, "stored", lambda df, name: (written.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("split("))), keep(df, name))[1])
    docs = spark.createDataFrame([(1, "the Coun cil met " + "council " * 12)], "k long, text string")
    assert repair.repaired(docs, "k", repair.vocabulary(docs)).first().text.startswith("the Council met")
    assert {n for n, cuts in written if cuts} == {"pairs-of-texts", "torn"}
