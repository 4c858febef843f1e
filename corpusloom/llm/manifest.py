"""Merkle manifest of a dataset: leaves placed by bitmap ranks, runs of 16 hashed level by level, proofs read back from the runs.

Each source has a bitmap of its doc_ids in blocks of 1,024 ids: 16 words that partial aggregates merge by OR, kept without their
empty words, each with the number of leaves before it. Directories count the leaves before a block within 2^16 blocks, and so on
upwards, so no level ever orders more than 2^16 entries in one task. A leaf's place in its source is then base + words before +
bits before: nothing is sorted. Places are keys from there on: place / 16 names a run, the rest the slot in its array.

Defined results: null source comes first, apart from the empty one. A null doc_id comes before all others of its source. Rows of
one source that share a doc_id (or have none) stand in the order of their leaves; repeats of a whole row take places of their own.
Such crowded ids are placed by the leaf's first digits, counted, so that one id may hold any number of rows. Tampering leaves rows
with a null doc_id or text as they are. No documents give no rows. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, release, table

RUN_BITS = 4  # runs of 16
BLOCK_BITS = 10  # ids of a block of a bitmap
DIRECTORY_BITS = 16  # entries of a directory
COPIES = 1_000  # repeats of one row that a task lays out at a time
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256."""
    return F.sha2(text, 256)


def leaf(text: Column) -> Column:
    """Digest of a document's five fields, each with its length in bytes."""
    fields = (F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text)
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields)))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, key (orders as the source, null first), leaf and, where a row is tampered with, the leaf it then has."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("."), F.col("source")), F.lit("")).alias("key"), leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(lowered)).alias("tampered"))


def _word() -> Column:
    return F.shiftright("doc_id", 6).bitwiseAND((1 << BLOCK_BITS - 6) - 1)


def blocks(rows: DataFrame) -> DataFrame:
    """key, block, n (leaves) and words: the block's bitmap without empty words, each word with the leaves before it (``before``).

    A word has ``more`` for ids that several rows share: bit and further rows. rows: key and doc_id, not null.
    """
    slots = range(1 << BLOCK_BITS - 6)
    word, one = _word(), F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    merged = rows.groupBy("key", F.shiftright("doc_id", BLOCK_BITS).alias("block")).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.bit_or(F.when(word == w, one)), F.lit(0).cast("long")).alias(f"w{w}") for w in slots))
    counted, before = [], F.lit(0)
    for w in slots:
        counted.append(F.struct(F.lit(w).alias("word"), F.col(f"w{w}").alias("bits"), before.alias("before")))
        before = before + F.bit_count(f"w{w}")
    plain = F.filter(F.array(*counted), lambda x: x["bits"] != 0)
    return merged.select("key", "block", "n", before.alias("ids"), plain.alias("words"))


def directories(sizes: DataFrame) -> DataFrame:
    """key, block and base: leaves of the same key in smaller blocks (sizes: key, block, n), by directories of bounded length."""
    levels = range(DIRECTORY_BITS, 64 - BLOCK_BITS, DIRECTORY_BITS)
    out, level = None, sizes.select("key", F.col("block").alias("at"), "n")
    tables = []
    for shift in [*levels, None]:
        own = ["key"] if shift is None else ["key", F.shiftright("at", DIRECTORY_BITS).alias("above")]
        named = level.select("at", "n", *own)
        w = Window.partitionBy(*(["key"] if shift is None else ["key", "above"])).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        tables.append(named.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))))
        if shift is not None:
            level = named.groupBy("key", F.col("above").alias("at")).agg(F.sum("n").alias("n"))
    out = tables[-1].select("key", "at", F.col("before").alias("base"))
    for below in reversed(tables[:-1]):
        up = out.select("key", F.col("at").alias("above"), F.col("base").alias("up"))
        out = below.join(up, ["key", "above"]).select("key", "at", (F.col("before") + F.col("up")).alias("base"))
    return out.select("key", F.col("at").alias("block"), "base")


def rank_index(rows: DataFrame) -> DataFrame:
    """The bitmap index of ``rows`` (key, doc_id): key, block, base, words; ids may repeat."""
    made, path = materialise(blocks(rows), "bitmaps")
    repeats = made.where("n > ids").select("key", "block")
    if not repeats.isEmpty():
        made = _with_repeats(made, rows.join(repeats, [rows["key"] == repeats["key"], F.shiftright(rows["doc_id"], BLOCK_BITS) == repeats["block"]], "left_semi"))
    else:
        made = made.select("key", "block", "n", F.transform("words", lambda x: F.struct(x["word"], x["bits"], x["before"].cast("long").alias("before"), F.array().cast("array<struct<bit:int,rows:bigint>>").alias("more"))).alias("words"))
    return made.join(directories(made), ["key", "block"])


def _with_repeats(made: DataFrame, rows: DataFrame) -> DataFrame:
    """``made`` with the further rows of repeated ids counted in (``rows``: all rows of the blocks that have such ids)."""
    several = rows.groupBy("key", "doc_id").agg((F.count(F.lit(1)) - 1).alias("rows")).where("rows > 0")
    entry = F.struct(_word().cast("int").alias("word"), F.col("doc_id").bitwiseAND(63).cast("int").alias("bit"), "rows")
    listed = several.groupBy("key", F.shiftright("doc_id", BLOCK_BITS).alias("block")).agg(F.collect_list(entry).alias("extra"))  # 1,024 ids at most

    def widened(x: Column) -> Column:
        own = F.filter("extra", lambda e: e["word"] == x["word"])
        earlier = F.aggregate(F.filter("extra", lambda e: e["word"] < x["word"]), F.lit(0).cast("long"), lambda s, e: s + e["rows"])
        more = F.transform(own, lambda e: F.struct(e["bit"], e["rows"]))
        return F.struct(x["word"], x["bits"], (x["before"] + earlier).alias("before"), more.alias("more"))

    both = made.join(listed, ["key", "block"], "left").withColumn("extra", F.coalesce("extra", F.array().cast("array<struct<word:int,bit:int,rows:bigint>>")))
    return both.select("key", "block", "n", F.transform("words", widened).alias("words"))


def ranked(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (key, doc_id not null, others) with place: leaves of the key with a smaller doc_id."""
    found = F.element_at(F.filter("words", lambda x: x["word"] == _word()), 1)
    bit = F.col("doc_id").bitwiseAND(63).cast("int")
    smaller = F.bit_count(F.expr("__w.bits & ~shiftleft(-1L, cast(doc_id & 63 as int))"))
    more = F.aggregate(F.filter("__w.more", lambda e: e["bit"] < bit), F.lit(0).cast("long"), lambda s, e: s + e["rows"])
    also = F.exists("__w.more", lambda e: e["bit"] == bit)
    joined = rows.withColumn("block", F.shiftright("doc_id", BLOCK_BITS)).join(index.select("key", "block", "base", "words"), ["key", "block"])
    return joined.withColumn("__w", found).withColumn("place", F.col("base") + F.col("__w.before") + smaller + more).withColumn("crowded", also).drop("words", "__w", "base", "block")


def within_crowds(rows: DataFrame) -> DataFrame:
    """``rows`` that share (key, doc_id), with place moved on by their order among each other; equal rows take one place each.

    Equal rows are counted first. The order is by the leaf: counts by its first four digits, then the few rows that share those.
    """
    same = ["key", "doc_id"]
    once = rows.groupBy(*same, "place", "leaf", "tampered").agg(F.count(F.lit(1)).alias("__n")).withColumn("__head", F.left("leaf", F.lit(4)))
    heads = once.groupBy(*same, "__head").agg(F.sum("__n").alias("__n"))
    before = Window.partitionBy(*same).orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*(F.col(c).alias(f"h_{c}") for c in same), F.col("__head").alias("h_head"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*same, "__head").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    placed = placed.join(heads, [F.col("key") == F.col("h_key"), F.col("doc_id").eqNullSafe(F.col("h_doc_id")), F.col("__head") == F.col("h_head")])
    first = F.col("place") + F.col("__base") + F.col("__in")
    chunks = placed.select(*same, "leaf", "tampered", first.alias("__first"), "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))).alias("__from"))
    chunks = chunks.repartition("leaf", "__from")
    each = F.explode(F.sequence("__from", F.least(F.col("__from") + COPIES, F.col("__n")) - 1))
    return chunks.select(*same, "leaf", "tampered", "__first", each.alias("__i")).select(*same, "leaf", "tampered", (F.col("__first") + F.col("__i")).alias("place"))


def placed_leaves(rows: DataFrame) -> DataFrame:
    """doc_id, key, leaf, tampered and place (from 0 in each key) of the rows of ``leaves``."""
    known, unknown = rows.where("doc_id is not null"), rows.where("doc_id is null")
    some = not unknown.isEmpty()
    index, _ = materialise(rank_index(known.select("key", "doc_id")), "ranks")
    at = ranked(known, index)
    if some:
        ahead = unknown.groupBy("key").agg(F.count(F.lit(1)).alias("__ahead"))
        at = at.join(ahead, "key", "left").withColumn("place", F.col("place") + F.coalesce("__ahead", F.lit(0))).drop("__ahead")
    names = ["doc_id", "key", "leaf", "tampered", "place"]
    shared = not index.where(F.exists("words", lambda x: F.size(x["more"]) > 0)).isEmpty()
    if not shared and not some:
        return at.select(*names)
    crowd = at.where("crowded").select(*names).unionByName(unknown.withColumn("place", F.lit(0).cast("long")).select(*names))
    return at.where("not crowded").select(*names).unionByName(within_crowds(crowd).select(*names))


def reduced(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of runs of trees, and their tops. nodes: key, place, value; a level: key, run, members (values by slot), value, left.

    A key leaves the loop when one node of it remains; left counts the nodes of the level, so that a lone leaf is seen. The loop
    ends when no key has more: as many rounds as the largest tree is high.
    """
    levels, tops, first = [], None, True
    width = 1 << RUN_BITS
    while True:
        slot = F.struct((F.col("place") % width).cast("int").alias("slot"), "value")
        runs = nodes.groupBy("key", F.shiftright("place", RUN_BITS).alias("run")).agg(F.transform(F.array_sort(F.collect_list(slot)), lambda x: x["value"]).alias("members"))
        runs = runs.withColumn("value", digest(F.array_join("members", "")))
        level, _ = materialise(runs, f"{name}-{len(levels)}")
        levels.append(level)
        counts = level.groupBy("key").agg(F.count(F.lit(1)).alias("runs"), F.max(F.size("members")).alias("most"))
        if first:  # a lone leaf is its own top
            lone = counts.where("runs = 1 and most = 1").select("key")
            tops = level.join(lone, "key", "left_semi").select("key", F.element_at("members", 1).alias("value"), F.lit(-1).alias("height"))
        ended = counts.where("runs = 1 and most > 1") if first else counts.where("runs = 1")
        tops = tops.unionByName(level.join(ended.select("key"), "key", "left_semi").select("key", "value", F.lit(len(levels) - 1).alias("height")))
        going = counts.where("runs > 1").select("key")
        if going.isEmpty():
            return levels, tops
        nodes = level.join(going, "key", "left_semi").select("key", F.col("run").alias("place"), "value")
        first = False


def _left() -> Column:
    return F.array_join(F.slice("members", F.lit(1), F.col("slot")), "")


def _right() -> Column:
    return F.array_join(F.slice("members", F.col("slot") + 2, F.greatest(F.size("members") - F.col("slot") - 1, F.lit(0))), "")


def _extended() -> Column:
    """The path of a run's member: its own siblings first, but a lone leaf has none."""
    return F.when(F.col("height") == -1, F.col("path")).otherwise(F.concat(F.array(F.struct("left", "right")), "path"))


def members_with_siblings(runs: DataFrame, *others: str) -> DataFrame:
    """A row for each member of each run: key, place, what stands left and right of it in its run, and ``others``."""
    each = runs.select("key", "run", "members", *others, F.posexplode("members").alias("slot", "value"))
    return each.select("key", (F.shiftleft("run", RUN_BITS) + F.col("slot")).alias("place"), "slot", "value", _left().alias("left"), _right().alias("right"), *others)


def paths(levels: list[DataFrame], tops: DataFrame, above: DataFrame) -> DataFrame:
    """key, run, path, height of the tree: from each run of the lowest level up. above: key, the path of its top, others to keep."""
    more = ["height", *(c for c in above.columns if c not in ("key", "path"))]
    start = tops.join(above, "key").select("key", "path", *more)
    down = None
    for h in range(len(levels) - 1, -1, -1):
        own = start.where((F.col("height") == h) | ((F.col("height") == -1) & F.lit(h == 0))).select("key", F.lit(0).cast("long").alias("run"), "path", *more)
        if down is not None:
            each = members_with_siblings(levels[h + 1].join(down, ["key", "run"]), "path", *more)
            step = F.array(F.struct("left", "right"))
            own = own.unionByName(each.select("key", F.col("place").alias("run"), F.concat(step, "path").alias("path"), *more))
        down = own
    return down


def _ordered(keys: DataFrame) -> DataFrame:
    """``keys`` (key, value) with place, their order by key: a range for each task, then the ranges' counts."""
    parts, _ = materialise(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "base")
    inside = Window.partitionBy("part").orderBy("key")
    return parts.withColumn("i", F.row_number().over(inside) - 1).join(bases, "part").select("key", "value", (F.col("base") + F.col("i")).cast("long").alias("place"))


def fold(start: Column, path: Column) -> Column:
    """The root that a node's digest and its path give."""
    return F.aggregate(path, start, lambda h, x: digest(F.concat(x["left"], h, x["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    rows, leaf_path = materialise(leaves(docs), "leaves")
    placed, placed_path = materialise(placed_leaves(rows), "places")
    release(docs.sparkSession, leaf_path)
    levels, tops = reduced(placed.select("key", "place", F.col("leaf").alias("value")), "level")
    tops, _ = materialise(tops, "tops")
    sources, _ = materialise(_ordered(tops.select("key", "value")).select(F.lit("").alias("tree"), F.col("key").alias("name"), "place", "value"), "sources")
    upper, root = reduced(sources.select(F.col("tree").alias("key"), "place", "value"), "source-level")
    empty = F.array().cast(_PATH)
    from_root = paths(upper, root, root.select("key", empty.alias("path"), F.col("value").alias("root")))
    source_paths = members_with_siblings(upper[0].join(from_root, ["key", "run"]), "path", "root", "height").withColumnRenamed("key", "tree").withColumn("path", _extended())
    above = sources.join(source_paths.select("tree", "place", "path", "root"), ["tree", "place"]).select(F.col("name").alias("key"), "path", "root", F.col("value").alias("subroot"))
    above, _ = materialise(above, "source-paths")
    down = paths(levels, tops, above)
    runs = levels[0].join(down, ["key", "run"]).select("key", "run", "members", "path", "root", "subroot", "height")
    ids = placed.select("key", F.shiftright("place", RUN_BITS).alias("run"), (F.col("place") % (1 << RUN_BITS)).cast("int").alias("slot"), "doc_id", "leaf", "tampered")
    each = ids.join(runs, ["key", "run"])
    proof = F.array_join(F.transform("__path", lambda x: F.concat(x["left"], x["right"])), "")
    out = each.withColumns({"left": _left(), "right": _right()}).withColumn("__path", _extended()).select(
        "doc_id", F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).alias("source"), "leaf", "subroot", "root",
        digest(proof).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("__path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).drop("source")
