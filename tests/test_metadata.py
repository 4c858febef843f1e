"""Metadata and answer operators on invented text."""

from pyspark.sql import functions as F

from corpusloom.functions import metadata as M
from corpusloom.functions import text as T
from corpusloom.operators import answers as A

JUDGMENT = "IN THE HIGH COURT OF SOMEWHERE\nCriminal Appeal No. 12-P/2011 of 2011\nAli Khan versus Bano Bibi\nPresent: Javed Iqbal Shah, J.\nBail was asked for. The bail was granted."


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_titles(spark):
    assert one(spark, M.clean_title, "12. THE LAW OF EVIDENCE ACT, 1990 (Repealed).pdf") == "The Law of Evidence Act, 1990"
    assert one(spark, M.short_title, "1. This Act may be called the Toy Safety Act, 2001. It") == "Toy Safety Act, 2001"
    assert one(spark, lambda c: M.year_of(c, F.lit("Act No. IX of 1988")), "Toy Act") == 1988 and one(spark, M.document_type, "Code of Toy Rules") == "Rules"
    assert one(spark, M.amendments, "Subs. by the Toy (Amendment) Act, 2003 and Ins. by Toy (Amendment) Act, 2003") == ["Toy (Amendment) Act, 2003"]


def test_judgments(spark):
    assert one(spark, M.parties, JUDGMENT.split("\n", 2)[2]) == "Ali Khan v. Bano Bibi" and one(spark, M.court, JUDGMENT) == "High Court"
    assert one(spark, M.case_number, JUDGMENT) == "Criminal Appeal No. 12-P/2011 of 2011" and one(spark, M.judges, JUDGMENT)[-1].endswith("Javed Iqbal Shah")
    assert one(spark, lambda c: M.topics(c, {"bail": "bail", "tax": "tax"}), JUDGMENT) == ["bail"]
    assert one(spark, lambda c: M.judgment_quality(c, F.lit(2), F.lit(0)), "short") == "near-empty"


def test_gates(spark):
    assert one(spark, M.foreign_only, "Divorce in India?") and not one(spark, M.foreign_only, "India and Pakistan")
    assert one(spark, M.prose, "this is a plain sentence with many small words in it " * 5) and not one(spark, M.prose, "PLD 1990 SC 1")
    assert one(spark, lambda c: M.labelled(c, ["issue", "findings"]), "**Issue:** a\nb\nFindings: c\nIssue: d") == {"issue": "a\nb", "findings": "c"}
    assert one(spark, M.preamble, "ACT\nWHEREAS it is good;\nand so\n1. Title") == "WHEREAS it is good;\nand so"


def test_answers(spark):
    hits = spark.createDataFrame([("a", 0.7), ("a", 0.56), ("a", 0.5), ("b", 0.61), ("b", 0.56)], "q string, relevance double")
    assert sorted((r.q, r.relevance) for r in A.chat_hits(hits, "q").collect()) == [("a", 0.56), ("a", 0.7), ("b", 0.61)]
    answers = spark.createDataFrame([(1, "Under section 5 of the Toy Act a fine of 300 rupees [2], see s. 9 [4] and [1]", 3)], "id long, text string, sources int")
    passages = spark.createDataFrame([(1, "5", "Toy Act, 2001", "a fine of 200 rupees")], "id long, number string, owner string, text string")
    r = A.citation_report(answers, passages, "id").first()
    assert (r.bad_markers, r.unbacked, [tuple(f) for f in r.unnamed_figures]) == ([4], ["9"], [(300, "rupee")])
    assert A.renumbered(answers, "id").first()["renumbered"].endswith("[1], see s. 9 [2] and [3]")


def test_merges(spark):
    parts = spark.createDataFrame([(1, 1, None, None, ["a", "b"]), (1, 2, "t", "x", ["b", "c"]), (1, 3, "u", None, [])], "id int, part int, type string, outcome string, points array<string>")
    r = A.merged_replies(parts, "id").first()
    assert (r.type, r.outcome, r.points) == ("t", "x", ["a", "b", "c"])
    hits = spark.createDataFrame([("q", "L", 2, None, 1)], "q string, law string, seq int, status string, rank int")
    sections = spark.createDataFrame([("L", i, "repealed" if i == 3 else None, f"t{i}") for i in range(1, 5)], "law string, seq int, status string, text string")
    assert [r.text for r in A.with_neighbours(hits, sections, "q").collect()] == ["t1"]


def test_problems_of_texts_by_counts(spark):
    import re

    texts = ["", " ", "a b c d e " * 60, "word " * 39, "word " * 50, " " * 900 + "word " * 50, "12 34 5x " * 60, "  é " * 300, "x" * 200, "x" * 199 + " " * 500]

    def want(t):
        solid = re.sub(r"[ \t\n\x0b\f\r]+", "", t)
        if len(solid) < 200:
            return "near-empty"
        letters, signs = sum(c.isalpha() for c in t), sum(not c.isspace() for c in t)
        if signs and letters / signs < 0.55:
            return "few letters"
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
        return "single letters" if sum(len(w) == 1 and w.isalpha() for w in words) / max(len(words), 1) > 0.35 else None

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.text_problem(F.col("t"), F.lit(1), F.lit(0)).alias("p"))
    assert {r.k: r.p for r in df.collect()} == {k: want(t) for k, t in enumerate(texts)}


def test_a_judgment_is_read_once_for_each_fact(spark):
    from corpusloom.operators import assembly

    rows = spark.createDataFrame([(1, "x", 1, 0, None, "s")], "k long, text string, pages int, empty_pages int, listing_title string, source string")
    records, aside = assembly.judgment_records(rows, "k", spark.createDataFrame([("s", "c")], "source string, court string"))
    assert "RegExp" not in "".join(d._jdf.queryExecution().optimizedPlan().toString() for d in (records, aside)) and [r.reason for r in aside.collect()] == ["near-empty"]
