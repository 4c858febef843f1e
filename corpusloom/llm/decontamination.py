"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders that keep their values beside them. A window is five tokens in a
row with placeholders for values; a window with fewer than two plain words keeps its values, so that columns of
figures match only themselves. A window is held where it stands with placeholders or as plain lower-case words, so a
copy in other letter case counts. An item is found in a document that holds at least 0.8 of its distinct windows. To find such pairs without meeting common windows, only an item's rarest windows are looked up first: a document that
holds 0.8 of n windows holds one of any n - ceil(0.8 n) + 1. Pairs found are verified on all windows. Then values are compared:
where an item's value recurs, the document must put one value of its own in its places; different values may become the same. Each
alignment is judged by itself, and the best ones that together hold 0.8 of the windows decide: a pair of whose recurring values' places under
SLOTS keep to that mapping is no copy, unless 0.8 of the windows are there word for word. A pair is ``verbatim`` if all values of
these alignments are the same, else ``reparameterised``.

Defined results: null and empty texts have no windows and never match; texts and items of fewer than five tokens have
one window of all their tokens; rows of different texts are documents of their own, also where they share an id or have
none (the query gives a row for each); items with a null item_id are one item; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, table

WORDS, SHARE, PLAIN = 5, 0.8, 2
#: Share of the places of an item's recurring values that must keep to one value of the document for each value of the item.
SLOTS = 0.8
#: Rows up to which a benchmark-sized table (about 40 bytes a row) is broadcast; beyond that joins shuffle.
BROADCAST_ROWS = 1_000_000
NUMBER, NAME, UNIT = "\x02", "\x03", "\x04"
#: Words that count as units after a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs ounce ounces pound pounds ton tons tonne tonnes l ml "
    "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros rupee rupees percent degree degrees mph kph"
)


def tagged(text: Column) -> Column:
    """Tokens of a text without the signs of kinds, one space apart; a value is a token that starts with the sign of its kind."""
    joined = F.regexp_replace(text, r"(?<=\d)[.,:/](?=\d)", "_")
    numbers = F.regexp_replace(joined, r"(?<![\p{L}\p{N}_])(\d[\d_]*)(?![\p{L}\p{N}_])", f" {NUMBER}$1 ")
    units = F.regexp_replace(numbers, rf"({NUMBER}[\d_]+) +(?i:({'|'.join(sorted(UNITS.split(), key=len, reverse=True))}))(?![\p{{L}}\p{{N}}_])", f"$1 {UNIT}$2")
    with_numbers = F.when(text.rlike(r"\d"), units).otherwise(text)
    names = F.regexp_replace(with_numbers, r"(?<=[\p{Ll},;])([\s\p{Z}\x85]+)(\p{Lu}\p{Ll}\p{L}*)", f"$1{NAME}$2")
    return F.trim(F.lower(F.regexp_replace(names, rf"[^\p{{L}}\p{{M}}\p{{N}}_{NUMBER}-{UNIT}]+", " ")))


def _is_value(token: Column) -> Column:
    return F.ascii(token).between(2, 4)


def tokens(df: DataFrame, key: str) -> DataFrame:
    """key, raw (tokens with values), kind (placeholders), plain (no signs) and whether there are values, of each text.

    Each step is a projection of its own, as what a later step reads more than once is then computed once.
    """
    clean = df.select(key, F.translate(F.coalesce("text", F.lit("")), NUMBER + NAME + UNIT, "   ").alias("text"))
    words = clean.select(key, tagged(F.col("text")).alias("words"))
    split = words.select(key, F.filter(F.split("words", " "), lambda t: t != "").alias("raw"), F.col("words").rlike(f"[{NUMBER}-{UNIT}]").alias("has_values"))
    kinds = F.transform("raw", lambda t: F.when(_is_value(t), F.left(t, F.lit(1))).otherwise(t))
    plain = F.transform("raw", lambda t: F.when(_is_value(t), F.substr(t, F.lit(2))).otherwise(t))
    return split.select(key, "raw", "has_values", *(F.when(F.col("has_values"), c).otherwise(F.col("raw")).alias(name) for c, name in ((kinds, "kind"), (plain, "plain"))))


def windows() -> Column:
    """Hashes of the windows over the columns of ``tokens``, in order; where there are values, plain ones come after them.

    A plain hash is over the words alone, whatever is taken for a value; it is null where it is the same as the other.
    """
    n = F.size("kind")
    at = F.sequence(F.lit(0), n - WORDS)
    of = lambda c, i: F.xxhash64(*(F.get(c, i + k) for k in range(WORDS)))
    values = lambda i: sum((F.when(F.length(F.get("kind", i + k)) == 1, _is_value(F.get("kind", i + k)).cast("int")).otherwise(0) for k in range(1, WORDS)), F.when(_is_value(F.get("kind", i)), 1).otherwise(0))
    mixed = F.transform(at, lambda i: F.when(values(i) > WORDS - PLAIN, of("raw", i)).otherwise(of("kind", i)))
    words = F.transform(at, lambda i: F.when(values(i) > 0, of("plain", i)))
    same = F.transform(at, lambda i: of("raw", i))
    short = F.array(F.xxhash64(F.array_join("raw", " ")), F.when(F.col("has_values"), F.xxhash64(F.array_join("plain", " "))))
    return F.when(n == 0, F.array().cast("array<long>")).when(n < WORDS, short).when(F.col("has_values"), F.concat(mixed, words)).otherwise(same)


def _places(df: DataFrame, key: str, at: str) -> DataFrame:
    """key, place (named ``at``) and hash h of every window over the columns of ``tokens``, and its plain hash as one more row."""
    each = df.select(key, F.greatest(F.size("kind") - (WORDS - 1), F.lit(1)).alias("n_places"), F.posexplode(windows()).alias("pos", "h"))
    return each.where("h is not null").select(key, (F.col("pos") % F.col("n_places")).alias(at), "h", (F.col("pos") >= F.col("n_places")).alias("plain"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row_key (hash of the text), item_id, n_windows, n_found, containment, consistency and kind of every leaked item."""
    docs = docs.select(F.struct("doc_id", F.xxhash64("text").alias("row_key")).alias("doc"), "text")
    items = benchmark.select("item_id", "text")
    item_tokens = tokens(items, "item_id")
    both_ways = _places(item_tokens, "item_id", "item_at")
    # words: whether the hash stands for the words themselves, as it does for plain hashes and windows that have no other.
    two = both_ways.where("plain").select(F.col("item_id").alias("i2"), F.col("item_at").alias("a2"))
    both_ways = both_ways.join(two, F.col("item_id").eqNullSafe(F.col("i2")) & (F.col("item_at") == F.col("a2")), "left").withColumn("words", F.col("plain") | F.col("a2").isNull())
    template = both_ways.where("not plain").select(F.col("item_id").alias("i"), F.col("item_at").alias("a"), F.col("h").alias("w"))
    places, _ = materialise(both_ways.join(template, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_at") == F.col("a"))).select("item_id", "item_at", "w", "h", "words"), "item-windows")
    item_windows = places.select("item_id", "w", "h", "words").distinct()
    n_rows = places.count()
    known = _small(item_windows.select("h").distinct(), n_rows)
    every = _places(tokens(docs, "doc"), "doc", "doc_at").select("doc", "doc_at", "h")
    hits, _ = materialise(every.join(known, "h", "left_semi"), "window-hits")

    # The rarest windows of each item; rarity is counted over all documents, under both hashes of a window.
    often = hits.groupBy("h").agg(F.count("*").alias("often"))
    of_item = Window.partitionBy("item_id")
    rarity = item_windows.join(often, "h", "left").groupBy("item_id", "w").agg(F.sum(F.coalesce("often", F.lit(0))).alias("often"))
    ranked = rarity.select("item_id", "w", F.count("*").over(of_item).alias("n"), F.row_number().over(of_item.orderBy("often", "w")).alias("r"))
    rarest = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * SHARE) + 1)
    anchors = rarest.alias("r").join(item_windows.alias("w"), F.expr("r.item_id <=> w.item_id AND r.w = w.w")).select("r.item_id", "w.h", "r.n")
    found = hits.select("doc", "h").distinct()
    candidates = found.join(_small(anchors, n_rows), "h").select("doc", "item_id", "n").distinct()

    # All windows of the candidates; a window is held under either of its hashes.
    wanted = candidates.alias("c").join(_small(item_windows, n_rows).alias("w"), F.expr("c.item_id <=> w.item_id")).select("c.doc", "c.item_id", "c.n", "w.w", "w.h", "w.words")
    either = wanted.alias("a").join(found.alias("f"), F.expr("a.h = f.h AND a.doc <=> f.doc")).groupBy("a.doc", "a.item_id", "a.n", "a.w").agg(F.bool_or("words").alias("words"))
    held = either.groupBy("doc", "item_id", "n").agg(F.count("*").alias("n_found"), F.count_if("words").alias("n_same"))
    pairs, _ = materialise(held.where(F.col("n_found") >= F.ceil(F.col("n") * SHARE)), "leak-pairs")
    n_pairs = pairs.count()

    # Values at the places where windows of a pair meet; documents without leaks aren't tokenised again.
    in_docs = _small(pairs.select("doc").distinct(), n_pairs)
    texts = docs.alias("d").join(in_docs.alias("p"), F.expr("d.doc <=> p.doc"), "left_semi")
    doc_tokens = tokens(texts, "doc").where("has_values").select("doc", F.posexplode("raw").alias("at", "value")).where(_is_value(F.col("value"))).distinct()
    slots = item_tokens.where("has_values").select("item_id", F.posexplode("raw").alias("at", "value")).where(_is_value(F.col("value"))).distinct()
    met = hits.alias("x").join(_small(pairs, n_pairs).alias("p"), F.expr("x.doc <=> p.doc")).join(_small(places, n_rows).alias("i"), F.expr("i.item_id <=> p.item_id AND i.h = x.h"))
    aligned, _ = materialise(met.select("x.doc", "i.item_id", "p.n", (F.col("x.doc_at") - F.col("i.item_at")).alias("shift"), "i.item_at", "i.w").distinct(), "alignments")
    shifts = aligned.select("doc", "item_id", "shift", F.explode(F.sequence("item_at", F.col("item_at") + WORDS - 1)).alias("at")).distinct()
    both = (
        shifts.alias("s")
        .join(_small(slots, n_rows).alias("i"), F.expr("i.item_id <=> s.item_id AND i.at = s.at"))
        .join(doc_tokens.alias("d"), F.expr("d.doc <=> s.doc AND d.at = s.at + s.shift"))
        .where("left(i.value, 1) = left(d.value, 1)")
    )
    values = both.select("s.doc", "s.item_id", "s.shift", F.col("i.value").alias("asked"), F.col("d.value").alias("put"))
    # Each value of the item is put as the document's value that stands in most of its places; places with another one break the mapping.
    counted = values.groupBy("doc", "item_id", "shift", "asked", "put").agg(F.count("*").alias("places"))
    by_value = counted.groupBy("doc", "item_id", "shift", "asked").agg(F.sum("places").alias("of"), F.max("places").alias("most"), F.bool_and(F.col("put") == F.col("asked")).alias("equal"))
    judged = by_value.groupBy("doc", "item_id", "shift").agg(F.sum(F.when(F.col("of") > 1, F.col("of"))).alias("asked"), F.sum(F.when(F.col("of") > 1, F.col("most"))).alias("kept"), F.bool_and("equal").alias("equal"))

    # The best alignments first, as many as hold the share of the windows; only their values decide.
    each = aligned.groupBy("doc", "item_id", "n", "shift").agg(F.count_distinct("w").alias("windows"))
    known_values = each.alias("e").join(judged.alias("j"), F.expr("e.doc <=> j.doc AND e.item_id <=> j.item_id AND e.shift = j.shift"), "left")
    scored = known_values.select("e.*", F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("equal", F.lit(True)).alias("equal"))
    of_pair = Window.partitionBy("doc", "item_id")
    share = F.coalesce(F.try_divide("kept", "asked"), F.lit(1.0))
    ordered, _ = materialise(scored.withColumn("r", F.row_number().over(of_pair.orderBy(F.desc(share), F.desc("equal"), F.desc("windows"), "shift"))), "ranked-alignments")
    rank_of = ordered.select("doc", "item_id", "shift", "r")
    first = aligned.alias("a").join(rank_of.alias("o"), F.expr("a.doc <=> o.doc AND a.item_id <=> o.item_id AND a.shift = o.shift")).groupBy("a.doc", "a.item_id", "a.w").agg(F.min("r").alias("r"))
    fresh = first.groupBy("doc", "item_id", "r").agg(F.count("*").alias("fresh"))
    counted = ordered.alias("o").join(fresh.alias("f"), F.expr("o.doc <=> f.doc AND o.item_id <=> f.item_id AND o.r = f.r"), "left").select("o.*", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    before = F.coalesce(F.sum("fresh").over(of_pair.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = counted.withColumn("before", before).where(F.col("before") < F.ceil(F.col("n") * SHARE))
    verdict = best.groupBy("doc", "item_id").agg(F.coalesce(F.try_divide(F.sum("kept"), F.sum("asked")), F.lit(1.0)).alias("consistency"), F.bool_and("equal").alias("equal"))
    out = pairs.alias("p").join(verdict.alias("j"), F.expr("p.doc <=> j.doc AND p.item_id <=> j.item_id"))
    word_for_word = F.col("n_same") >= F.ceil(F.col("p.n") * SHARE)
    return out.where((F.col("consistency") >= SLOTS) | word_for_word).select(
        "p.doc.doc_id", "p.doc.row_key", "p.item_id", F.col("p.n").cast("long").alias("n_windows"), "p.n_found", (F.col("p.n_found") / F.col("p.n")).alias("containment"),
        "j.consistency", F.when(F.col("equal"), "verbatim").otherwise("reparameterised").alias("kind"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bad = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "row_key").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["row_key"]), "left_anti")
