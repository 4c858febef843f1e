"""Statutes, citations and selections on invented text, with the results the semantics ask for, and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import citations, statutes, windows

LAW = (
    "THE RENT ACT, 1962 CONTENTS SECTIONS: 1. Short title. 2. Definitions. 2A. Forms. 3. Rent. 5-7. [Omitted.] 8. Saving. CHAPTER I GENERAL "
    "ACT No. IV OF 1962 An Act to regulate rent. 1. Short title.—(1) This is the Rent Act. 3[(2) It extends to all.] 1Subs. by Act V of 1970. Page 1 of 66 "
    "42. Definitions.—In this Act “rent” is money. 2-A. Forms.— As printed. Page 2 of 6622. None. 3. Rent due.—Rent falls due on day 5. "
    "8. [Saving of old law.] Repealed by Act X of 1981. THE SCHEDULE 1. Old rents. 2. Lost rents [including arrears. 3. Other rents, as agreed. PART II Forms of old."
)


def _rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_statute_of_all_kinds(spark):
    docs = spark.createDataFrame([(1, LAW), (2, None), (3, ""), (4, "No sections here at all.")], "law long, text string")
    found = statutes.statute_sections(docs, "law").orderBy("i")
    got = _rows(found.where("law = 1"), "section", "heading", "text")
    assert [g[0] for g in got] == ["1", "2", "2A", "3", "8"]
    assert got[0][1:] == ("Short title", "(1) This is the Rent Act. [(2) It extends to all.]")
    assert got[1][1:] == ("Definitions", "In this Act “rent” is money")
    assert got[2][2].startswith("As printed") and got[3][2] == "Rent falls due on day 5"
    assert got[4][2] == "Repealed by Act X of 1981"
    assert found.where("law > 1").count() == 0
    parts = statutes.schedule_items(statutes.schedules(docs, "law"), "law")
    assert sorted(_rows(parts, "section", "text")) == [("Schedule Part II", "Forms of old"), ("Schedule item 1", "Old rents"), ("Schedule item 2", "Lost rents [including arrears]"), ("Schedule item 3", "Other rents, as agreed")]
    shares = {r.law: (r.expected, r.found) for r in statutes.statute_detection(docs, found, "law").collect()}
    assert shares[1][1] == 5 and shares[1][0] >= 5 and shares[2] == (0, 0) and shares[4] == (0, 0)


@pytest.mark.parametrize(
    "wide,numbers,want",
    [(True, "1 2 4 10 3 5", "1 2 4 5"), (True, "1 2 30 31 32 33", "1 2 30 31 32 33"), (True, "1 2 200 3", "1 2 3"), (False, "1 2 30 31 3", "1 2 3"), (True, "2 1 2 3", "1 2 3"), (True, "1 2 5 3 4 5 6", "1 2 3 4 5 6"), (True, "", "")],
)
def test_rising_numbers(wide, numbers, want):
    n = list(map(int, numbers.split()))
    ok = statutes._chain(n, [""] * len(n), [False] * len(n), wide)
    assert " ".join(str(x) for x, k in zip(n, ok) if k) == want


def test_chain_is_worth_most():
    from itertools import combinations

    rnd = random.Random(3)
    for _ in range(60):
        found = [(rnd.choice([*range(1, 9), 30, 31, 32]), rnd.choice(["", "", "A"]), rnd.random() < 0.2) for _ in range(8)]

        def worth(chain):
            last, total = (0, ""), 0
            for n, letter, glued in chain:
                cost = statutes._step_cost(n - last[0], glued, True)
                if (n, letter) <= last or cost is None:
                    return -9
                total, last = total + 1 - cost, (n, letter)
            return total

        best = max(worth(c) for k in range(9) for c in combinations(found, k))
        ok = statutes._chain([f[0] for f in found], [f[1] for f in found], [f[2] for f in found])
        assert worth([f for f, k in zip(found, ok) if k]) == best


def test_glued_numbers_are_the_very_next():
    assert statutes._chain([1, 2, 38, 3, 8], ["", "", "", "", ""], [False, False, False, True, True]) == [True, True, False, True, False]
    assert statutes._chain([1, 1, 1, 2], ["", "A", "B", ""], [False] * 4) == [True] * 4


def test_every_footnote_word(spark):
    rows = [(w, f"Body of section. 1{w}{'x' if w[-1].isalpha() else ''} and the rest. Page 1 of 2 Next.") for w in statutes.FOOTNOTES]
    assert {"Deleted", "Modified", "Extended", "Sic", "Explanation", "Gaz"} <= set(statutes.FOOTNOTES)
    df = spark.createDataFrame(rows, "w string, t string")
    got = df.select("w", statutes.without_footnotes(statutes.with_page_breaks(F.col("t"))).alias("x")).collect()
    assert {r.x for r in got} == {"Body of section. Next."}


@pytest.mark.parametrize(
    "text,want",
    [
        ("Rule 3[(1) x]2 and ]3. y", "Rule [(1) x] and]3. y"), ("a 12 [b] (3[c] 4/5[d]", "a [b] (3[c] 4/5[d]"), ("x ____ y Uploaded on 12.3.2001 z", "x y z"), ("a , b ; c )", "a, b; c)"),
    ],
)
def test_marks_out(spark, text, want):
    assert spark.range(1).select(statutes.without_marks(F.lit(text)).alias("x")).first().x == want


def test_schedules_go_by_their_numbers(spark):
    text = "1. Title.—Short. FIRST SCHEDULE a FIRST SCHEDULE contd. b SCHEDULE 7 c SECOND SCHEDULE d"
    got = _rows(statutes.schedules(spark.createDataFrame([(1, text)], "law long, text string"), "law").orderBy("section"), "section", "text")
    assert got == [("Schedule 1", "a FIRST SCHEDULE contd. b SCHEDULE 7 c"), ("Schedule 2", "d")]


def test_page_totals_and_footnotes(spark):
    texts = ["a Page 1 of 12 b Page2of1222. c Page 3 of 12", "no pages 1Subs. by", "Rule.1 Subs. by Act. Page 1 of 2 More 1 For day. x. 1Ins. y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(statutes.with_page_breaks(F.col("t")).alias("t")).select(statutes.without_footnotes(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["a b 22. c", "no pages 1Subs. by", "Rule. More 1 For day. x."]


def test_unbacked_cases_go_with_their_sentence(spark):
    text = "One. See Amir Khan v. Bano Bibi, which is so. Two.\nPLD 1990 SC 12 says it. 1999 SCMR 7 too. End.\n| Ali Raza v. State Bank | x |\n| x | 1999 SCMR 7 | y |"
    answers = spark.createDataFrame([(1, text), (2, "Nothing."), (3, None)], "k long, text string")
    passages = spark.createDataFrame([(1, "as in PLD  1990 SC 12 and so"), (2, None)], "k long, text string")
    got = {r.k: r.text for r in citations.without_unbacked_cases(answers, passages, "k", mark="[x]").collect()}
    assert got[2] == "Nothing." and got[3] is None
    assert got[1] == "One. [x] Two.\nPLD 1990 SC 12 says it. [x] End.\n| [x] | |\n| x | [x] | y |"


@pytest.mark.parametrize("cite", ["PLD 1990 SC 12", "PLD (1990) Lah 7", "PLJ 2001 Kar. 5", "NLR 1999 SC 1", "KLR 2004 Pesh 9", "1999 SCMR 7", "2003 MLD 1", "1998 CLC 3", "2001 YLR 22", "1987 PCrLJ 5", "1987 P. Cr. L. J. 5",
    "2010 PLC (C.S.) 15", "2011 CLD 4", "2012 PTD 8", "1986 SCJ 2", "1991 MLR 3", "1990 CLJ 6"])
def test_every_report(spark, cite):
    assert [r.x for r in spark.range(1).select(F.explode(F.regexp_extract_all(F.lit(f"See {cite} for it, and 1999 SCMRX 7."), F.lit(citations.REPORTED), F.lit(0))).alias("x")).collect()] == [cite]


@pytest.mark.parametrize("cite,number", [("Civil Appeal No. 5 of 2001", "5"), ("C.P.L.A. 12/2020", "12"), ("Crl.A. No. 7-P of 1999", "7"), ("CRIMINAL PETITIONS NOS. 4657 TO 4659 OF 2022", "4657"), ("W.P. 3, 4 and 9/2010", "3"), ("C.A. 88 of 1987", "88")])
def test_every_case_number(spark, cite, number):
    row = spark.range(1).select(F.regexp_extract(F.lit(f"In {cite}, it"), citations.NUMBERED, 1).alias("n"), F.regexp_extract(F.lit(cite), citations.NUMBERED, 2).alias("y")).first()
    assert row.n == number and cite.endswith(row.y)


def test_several_numbers_name_a_case(spark):
    mentions = citations.case_mentions(spark.createDataFrame([(1, "Petitions Nos. 3, 4 and 9 of 2010; Petition 5 of 2010.")], "k long, text string"), "k")
    cases = spark.createDataFrame([(1, "a", "", ["9"], "2010", 1)], "k long, case_id string, name string, numbers array<string>, year string, paragraph int")
    assert [r.cite for r in citations.retrieved_cases(mentions, cases, "k").collect()] == ["Petitions Nos. 3, 4 and 9 of 2010"]


def test_abbreviations_end_no_sentence(spark):
    text = "One. Held for Mst. Amna by Mr. A. Khan and Co. Ltd. in 1999 SCMR 7 at p. 9, cf. s. 5. Two."
    answers = spark.createDataFrame([(1, text)], "k long, text string")
    assert citations.without_unbacked_cases(answers, answers.limit(0), "k", mark="[x]").first().text == "One. [x] Two."


def test_paragraph_of_the_nearest_case(spark):
    answers = spark.createDataFrame([(1, "Amir Khan v. Bano Bibi, para 4; Civil Appeal No. 5 of 2001 at paras 7, 8.\npara 99 alone")], "k long, text string")
    cases = spark.createDataFrame([(1, "a", "Amir Khan and another v. Mst. Bano Bibi", [], "", 3), (1, "b", "", ["5"], "2001", 8)], "k long, case_id string, name string, numbers array<string>, year string, paragraph int")
    assert sorted((r.case_id, r.wrong) for r in citations.wrong_paragraphs(answers, cases, "k").collect()) == [("a", [4]), ("b", [7])]


def test_pilot_against_brute_force(spark):
    random.seed(4)
    rows = [(i, random.choice([0, 0, 0, 1, 2]), random.randrange(1990, 1996), random.sample("abcdefghijkl", random.randrange(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, weight int, group int, names array<string>")
    for n in (20, 90, 400):
        picked = [r[0] for r in sorted((r for r in rows if r[1] > 0), key=lambda r: (-r[1], r[0]))[:n]]
        seen = {x for r in rows if r[0] in picked for x in r[3]}
        pools = {}
        for r in rows:
            if not r[1]:
                pools.setdefault(r[2], []).append(r)
        while len(picked) < n and any(pools.values()):
            for g in sorted(pools):
                if pools[g] and len(picked) < n:
                    r = next((r for r in pools[g] if not set(r[3]) <= seen), pools[g][0])
                    pools[g].remove(r)
                    picked.append(r[0])
                    seen |= set(r[3])
        assert [r.k for r in windows.pilot(df, "k", n).orderBy("place").collect()] == picked


def test_next_as_of_far_ahead_and_at_the_same_time(spark):
    left = spark.createDataFrame([(1, 0), (2, 50), (3, 60), (4, 10**7), (5, None), (1, 0)], "id long, at_s long").withColumn("at", F.timestamp_seconds("at_s"))
    right = spark.createDataFrame([(60, "c"), (60, "b"), (20 * 86400, "far")], "s long, name string").select(F.timestamp_seconds("s").alias("run_at"), F.struct("name").alias("payload"))
    found = windows.next_as_of(left.drop("at_s"), right, "at", "run_at", 40)
    got = sorted((r.id, r.next.payload.name if r.next else None) for r in found.collect())
    assert got == [(1, "b"), (1, "b"), (2, "b"), (3, "b"), (4, None), (5, None)]
    twenty = windows.next_as_of(spark.createDataFrame([(1, 100)], "id long, s long").select("id", F.timestamp_seconds("s").alias("at")), right, "at", "run_at", 3600)
    assert twenty.first()["next"]["payload"]["name"] == "far"


def test_places_stay_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "é1. A 22. B"), (2, ""), (3, None)], "k long, t string")
    found = statutes.places(docs, "k", "t", r"\d{1,2}\.")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(_rows(found.where("k = 1"), "n", "at", "piece")) == [(0, 0, "é"), (1, 1, "1. A "), (2, 6, "2"), (3, 7, "2. B")]
    assert _rows(found.where("k = 2"), "n", "at", "piece") == [(0, 0, "")]


def test_both_layouts_are_one_pass(spark):
    laws = statutes.read_laws(spark.createDataFrame([(1, LAW), (2, "CONTENTS 1. Old rents. 2. New rents. ACT No. V OF 1962 Old rents 1. Rent is low. New rents 2. Rent is high.")], "law long, text string"), "law")
    found = statutes.located(*laws, "law")
    assert {(r.law, r.heading_first) for r in found.where("confirmed").collect()} >= {(1, False), (2, True)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(transform(") == 1


def test_numbered_places_carry_no_surroundings(spark):
    entries, places = statutes._numbered(spark.createDataFrame([(1, None, "ACT 1. Short title.— One. 2A. Long [title].— Two.")], "law long, contents string, body string"), "law")
    assert "ahead" not in entries._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(entries.orderBy("i"), "number", "letters", "heading") == [(1, "", "Short title"), (2, "A", "Long [title]")]
    assert _rows(places.orderBy("i"), "start", "text_at") == [(4, 20), (26, 44)]


def test_schedules_are_cut_in_their_rows(spark):
    """Items and schedules come from one pass over the rows; nothing is shuffled for them."""
    rows = spark.createDataFrame([(1, "Schedule 1", "1. Old rents of land. 2. Lost [rents. 3. Other rents. PART II Other"), (2, "Schedule 1", "1. A. 3. B."), (3, "Schedule", None), (4, "Schedule", "")], "law long, section string, text string")
    parts = statutes.schedule_items(rows, "law")
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    assert sorted(_rows(parts, "law", "section", "text"), key=str) == [(1, "Schedule 1 Part II", "Other"), (1, "Schedule 1 item 1", "Old rents of land"), (1, "Schedule 1 item 2", "Lost [rents]"), (1, "Schedule 1 item 3", "Other rents"), (2, "Schedule 1", "1. A. 3. B."), (3, "Schedule", None), (4, "Schedule", "")]


def test_laws_with_sections_by_their_first_place(spark):
    texts = [LAW, "CONTENTS 1. Old rents. ACT No. V OF 1962 Old rents 1. Rent is low.", "CONTENTS 1. Old. ACT No. V OF 1962 Nothing. 7. At all.", "ACT 1. Title.— One.", "CONTENTS 2. Old. ACT No. V OF 1962 An Act. 2. Else.", "Words.", None, ""]
    parts, entries = statutes.read_laws(spark.createDataFrame(list(enumerate(texts)), "law long, text string"), "law")
    found = {r.law for r in statutes.section_places(parts, entries, "law").collect()}
    assert {r.law for r in statutes.with_sections(parts, entries, "law").collect()} == found == {0, 1, 3, 4}
    assert not statutes.with_sections(parts, entries, "law")._jdf.queryExecution().optimizedPlan().toString().count("Window")


def test_texts_without_marks_of_pages_stay(spark):
    texts = ["RENT ACT " * 6 + "1 x", "".join(f"THE RENT ACT {n}25A. Goods. " for n in range(1, 6)), "Page ٣ of 4 x", "a Page 1 of 2 b", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(statutes.with_page_breaks(F.col("t")).alias("x")).collect()]
    assert got == [None if t is None else statutes._page_breaks(t, 5) for t in texts]
