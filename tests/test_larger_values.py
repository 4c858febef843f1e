"""Cases that larger tables brought up: query and SQL state one rule."""

from pyspark.sql import functions as F

from corpusloom.functions import metadata as M, text as T
from corpusloom.operators import citations, filters


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_words_are_bounded_by_letters_of_any_script(spark):
    """Of "étreelleon" nothing is a word of a-z, whatever the Java version says about bounds."""
    assert one(spark, filters.index_exclusion, "Éon étreelleon tre on. Ouanç èment.") == "body under 40 characters"
    assert one(spark, filters.index_exclusion, "On treelleon tre on. Ouan ment.") is None


def test_prose_sql_states_the_marks_of_a_heading(spark, tmp_path):
    """A plain text with two marks of a heading is no prose for query and SQL."""
    import duckdb

    from corpusloom.plans import all_queries

    plain = "this is a plain sentence with many small words in it " * 5
    spark.createDataFrame([(1, plain), (2, "Heard for the petitioner " + plain), (3, "PLD CLC YLR SCMR PLD CLC " + plain)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries, sql = all_queries()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(sql["prose_paragraphs"]).fetchall())
    assert sorted(map(tuple, queries["prose_paragraphs"](spark, str(tmp_path)).collect())) == want == [(1, True), (2, False), (3, True)]
    assert not one(spark, M.prose, "Heard for the petitioner " + plain)


def test_section_reference_sql_knows_the_longest_number(spark, tmp_path):
    import duckdb

    from corpusloom.plans import all_queries

    spark.createDataFrame([(1, 1, 5, 7), (2, 1, 5, 9998), (3, 1, 5, 9999)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    queries, sql = all_queries()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(sql["section_references"]).fetchall())
    assert sorted(map(tuple, queries["section_references"](spark, str(tmp_path)).collect())) == want
    assert [r[2] for r in want] == ["6A,8", "6A,9999", "6A"]


def test_a_plus_in_a_title_is_no_space(spark):
    assert one(spark, T.title_key, "+1 (875) 555 And the Law%20Act") == "1875555andthelawact"


def test_numbers_of_reports_and_cases_have_any_length(spark):
    """A number of seven figures or more is checked like a shorter one."""
    said = "In Petition No. 12345678 of 1998 and Petition No. 7654321 of 1998 after F.I.R. No. 1000007 and FIR 2000008"
    items = spark.createDataFrame([(1, 1, said)], "id long, item int, text string")
    held = spark.createDataFrame([(1, "Order in No. 12345678 of 1998, FIR 2000008")], "id long, text string")
    assert citations.unsupported_mentions(items, held, "id").first()["missing"] == ["Petition No. 7654321 of 1998", "FIR 1000007"]


def test_a_text_of_many_fetches_gives_one_table(spark):
    """Rows of a key leave in one batch; a table for each row took most of the time."""
    import pandas as pd

    from corpusloom.streaming.staging import ByText

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = lambda self, v: setattr(self, "held", v)
        clear = lambda self: setattr(self, "held", None)

    by_text = ByText()
    by_text.holder, by_text.first = Value(), Value()
    rows = pd.DataFrame([("r1", "s", i, f"u{i}", "new", None) for i in range(50)], columns=["run", "source", "seq", "url", "kind", "reason"])
    (out,) = by_text.handleInputRows(("h",), iter([rows[25:], rows[:25]]), None)
    assert list(out["outcome"]) == ["new"] + ["quarantined"] * 49 and list(out["seq"]) == list(range(50)) and by_text.holder.get() == ("u0",)


def test_word_sets_far_apart_are_not_compared(spark):
    """Sets of one rare word and much in common, but under the ratio, leave before their words are shuffled; the result is exact."""
    import itertools
    import random

    from corpusloom.operators import dedupe

    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    sets = {i: sorted({"rare", *rng.sample(base, 300 if i % 3 else 40)}) for i in range(40)}
    sets |= {100 + i: sorted({*sets[i], *(f"x{j}" for j in range(k))}) for i, k in ((1, 50), (2, 54), (3, 7), (6, 8), (4, 0))}
    docs = spark.createDataFrame(list(sets.items()), "id long, words array<string>")
    found = dedupe.jaccard_pairs(docs, "id", F.col("words"))
    ratio = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] != sets[b] and ratio(sets[a], sets[b]) >= 0.85}
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) >= 2
    assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_is_built_with_one_shuffle(spark, tmp_path):
    """Documents are counted where they are; postings move once, to their bucket and shard."""
    from corpusloom.operators import lexical

    docs = spark.createDataFrame([(1, ["a", "b", "a", None], ["a"]), (2, None, ["b"]), (3, [], None)], "id long, words array<string>, head array<string>")
    lexical.add_documents(docs, "id", {"words": 1.0, "head": 3.0}, f"{tmp_path}/index")
    rows = lexical.open_index(spark, f"{tmp_path}/index").select("term", F.explode("postings").alias("p")).select("term", "p.*").collect()
    assert sorted(map(tuple, rows)) == [("", 1, 6.0, 6.0), ("", 2, 3.0, 3.0), ("a", 1, 5.0, 6.0), ("b", 1, 1.0, 6.0), ("b", 2, 3.0, 3.0)]
