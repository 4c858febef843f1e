"""Statutes are read where their rows are: each step is made once, and nothing is shuffled or written for it."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import assembly, statutes

CONTENTS = "THE RENT ACT CONTENTS SECTIONS: 1. Short title. 2. Rent due. ACT No. IV OF 1962 An Act to regulate rent. "
BEHIND = CONTENTS + "1. Short title.— It is the Rent Act. 2. Rent due.— On day 5 of 12 months. SCHEDULE 1. Old rents of land. 2. New rents of land. 3. Lost rents of land."
BEFORE = CONTENTS + "Short title 1. It is the law. Rent due 2. On day 5."
NUMBERED = "ACT 1. Short title.— It is the Rent Act. 2A. Rent due.— On day 5. 9. Not the next.— x"


def _docs(spark):
    return spark.createDataFrame([(1, BEHIND), (2, BEFORE), (3, NUMBERED), (4, None)], "law long, text string")


def test_sections_of_a_law_leave_its_row(spark):
    found = statutes.statute_sections(_docs(spark), "law")
    parts = statutes.schedule_items(statutes.schedules(_docs(spark), "law"), "law")
    counted = statutes.statute_detection(_docs(spark), None, "law")
    for df in (found, parts, counted):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "parquet" not in plan
        assert all(df._jdf.queryExecution().optimizedPlan().toString().count(f"ArrowEvalPython [{step}(") == 1 for step in ("_listed", "_places_of", "_dashed", "mark"))
    assert sorted((r.law, r.section, r.heading, r.text, r.method) for r in found.collect()) == [
        (1, "1", "Short title", "It is the Rent Act", "contents"), (1, "2", "Rent due", "On day 5 of 12 months", "contents"),
        (2, "1", "Short title", "It is the law", "contents, heading first"), (2, "2", "Rent due", "On day 5", "contents, heading first"),
        (3, "1", "Short title", "It is the Rent Act", "numbering"), (3, "2A", "Rent due", "On day 5. 9. Not the next.— x", "numbering"),
    ]
    assert sorted((r.law, r.section, r.text) for r in parts.collect()) == [(1, "Schedule item 1", "Old rents of land"), (1, "Schedule item 2", "New rents of land"), (1, "Schedule item 3", "Lost rents of land")]
    assert sorted((r.law, r.expected, r.found) for r in counted.collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 2), (4, 0, 0)]


def test_laws_are_read_once_for_records(spark):
    long_enough = " and so it goes on for goods of every kind" * 6
    laws = _docs(spark).select("law", F.concat("text", F.lit(long_enough)).alias("text"), F.lit(3).alias("pages"), F.lit(0).alias("empty_pages"), F.lit("Rent Act, 1962").alias("listing_title"), F.lit(None).cast("int").alias("listing_year"), F.lit(None).cast("string").alias("listing_status"), F.lit("s").alias("source"))
    records, aside = assembly.statute_records(laws, "law", spark.createDataFrame([], "title_key string"))
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "_places_of" not in plan and plan.count("Join") == 2  # held titles, for sections and for schedules
    assert sorted((r.law, r.section) for r in records.collect()) == [(1, "1"), (1, "2"), (1, "Schedule item 1"), (1, "Schedule item 2"), (1, "Schedule item 3"), (2, "1"), (2, "2"), (3, "1"), (3, "2A")]
    assert [(r.law, r.reason) for r in aside.collect()] == [(4, "near-empty")]


def test_white_space_of_any_script_is_one_space(spark):
    spaces = ["\t", "\n", "\x0b", "\x0c", "\r", "\x85", "\xa0", " ", " ", " ", " ", " ", " ", " ", " ", "　"]
    texts = [f"a{x}b {x}c{x} d  e " for x in spaces] + ["a b", " ", "​", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.one_space(F.col("t")).alias("x")).collect()]
    assert got == ["a b c d e"] * len(spaces) + ["a b", "", "​", ""]
