"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines that hold a letter or a figure take part; blank ones, brackets and rules are never touched. Equal lines are grouped
first, and repeats of a line go whatever its length. Lines of MIN_CHARS characters or more are also compared. Each is split into MAX_EDITS + 1 even segments, which are indexed by
(length, segment number, content); by the pigeonhole principle a line within MAX_EDITS edits holds one of them unchanged,
near its place. So each line probes the index for all lengths down to MAX_EDITS less, with just the substrings at
which such a segment can stand (multi-match-aware selection). What meets must agree in its counts of common letters (an
edit changes two of them by one), which the join itself tests, and is verified with a banded bit-parallel edit distance: bit
b of a word stands for the b-th diagonal, there is a word for each number of edits, and a column takes a few operations on
whole words. Lines of a segment that very many share are told apart by the segments of what is left of them without it,
and so on (``candidates``); that loses no link and keeps such groups from meeting as a whole.

A line's class is kept where it comes first: an occurrence is removed unless it is the first one of its text (by
document id, then line number) and no line within MAX_EDITS edits comes before it (by document id, then by text).

Defined results: lines end at U+000A; null and empty texts have no lines to remove; a null doc_id comes after all others;
rows that repeat an id and a text count as one document; lines of one document that repeat go, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, table

MIN_CHARS, MAX_EDITS = 20, 1
#: Letters counted by the filter; any would be right, common ones sort out most.
LETTERS = "etanioshr"[:8]
#: Pairs for each line of a group that shares a segment, beyond which its lines are told apart by their rests.
HOT = 50
#: Line hashes (8 bytes each) up to which they are broadcast to fetch texts; beyond that the join shuffles.
BROADCAST_ROWS = 2_000_000
LAST = (1 << 63) - 1


def _row_key() -> Column:
    return F.xxhash64("text").alias("row_key")


def occurrences(docs: DataFrame) -> DataFrame:
    """doc (id, null last), row_key, at (line number from 0) and line of all lines that take part."""
    lines = docs.where(F.length("text") > 0).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), _row_key(), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.where((F.length("line") >= MIN_CHARS) | F.col("line").rlike(r"[\p{L}\p{N}]"))


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th (from 0) of the even segments of n characters; shorter ones come first."""
    size = lambda j: F.floor((n + j) / parts).cast("int")
    return reduce(lambda a, b: a + b, (size(j) for j in range(i)), F.lit(1)), size(i)


def measured(lines: DataFrame) -> DataFrame:
    """``lines`` with chars, and sig: the counts of LETTERS, each modulo 256, in one long."""
    count = lambda c: F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c), F.lit("")))
    one = lambda k, c: F.shiftleft(count(c).cast("long").bitwiseAND(255), 8 * k)
    sig = reduce(lambda x, y: x.bitwiseOR(y), (one(k, c) for k, c in enumerate(LETTERS)))
    return lines.withColumns({"chars": F.length("line"), "sig": sig})


def _letters_agree(a: Column, b: Column, edits: int) -> Column:
    def apart(k: int) -> Column:
        d = F.abs(F.shiftright(a, 8 * k).bitwiseAND(255) - F.shiftright(b, 8 * k).bitwiseAND(255))
        return F.least(d, 256 - d)  # the counts are modulo 256

    return reduce(lambda x, y: x + y, map(apart, range(len(LETTERS)))) <= 2 * edits


def distance(xs: Column, ys: Column, edits: int) -> Column:
    """Edit distance of two arrays of signs where it is at most ``edits``, else null; xs isn't longer than ys.

    Bit b of word e after column j says that the first j + b - edits signs of xs are within e edits of the first j of ys.
    """
    width = 2 * edits + 1
    hit = lambda c, j, b: F.when(F.get(xs, j + (b - edits)) == c, 1 << b).otherwise(0)
    columns = F.transform(ys, lambda c, j: reduce(lambda p, q: p + q, (hit(c, j, b) for b in range(width))))
    start = F.struct(*(F.lit(sum(1 << (edits + i) for i in range(e + 1))).alias(f"e{e}") for e in range(edits + 1)))

    def step(state: Column, match: Column) -> Column:
        words: list[Column] = []
        for e in range(edits + 1):
            word = state[f"e{e}"].bitwiseAND(match)
            if e:
                before = state[f"e{e - 1}"]
                word = word.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(words[-1], 1)).bitwiseAND((1 << width) - 1)
            words.append(word)
        return F.struct(*(w.alias(f"e{e}") for e, w in enumerate(words)))

    def read(state: Column) -> Column:
        place = F.size(xs) - F.size(ys) + edits
        found = [F.when(F.getbit(state[f"e{e}"], place) == 1, F.lit(e)) for e in range(edits + 1)]
        return F.coalesce(*found)

    return F.aggregate(columns, start, step, read)


def _places(n: Column, edits: int) -> list[tuple[int, Column, Column]]:
    """(number, start, length) of the segments of n characters."""
    return [(i, *_segment(n, i, edits + 1)) for i in range(edits + 1)]


def _shifts(i: int, less: int, edits: int) -> range:
    """Places, from that of the i-th segment, at which a line longer by ``less`` can hold it (multi-match-aware selection)."""
    return range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)


def _piece(text: Column, context: list[Column], size: Column, i: int, start: Column, length: Column, place: bool) -> Column:
    """Key of one segment; with its ``place``, so that the rest of the text can be told later."""
    key = F.xxhash64(*context, size, F.lit(i), F.substring(text, start, length))
    return F.struct(key.alias("key"), start.alias("start"), length.alias("length")) if place else key


def _own(text: Column, context: list[Column], n: Column, edits: int, place: bool) -> Column:
    """The segments under which a text is indexed."""
    return F.array(*(_piece(text, context, n, i, start, length, place) for i, start, length in _places(n, edits)))


def _asked(text: Column, context: list[Column], n: Column, less: int, edits: int, unmoved: bool, place: bool) -> Column:
    """What a text of n characters looks for among texts shorter by ``less``; ``unmoved``: at their own places, too."""
    size, out = n - less, []
    for i, start, length in _places(size, edits):
        out += [_piece(text, context, size, i, start + shift, length, place) for shift in _shifts(i, less, edits) if less or shift or unmoved]
    return F.array(*out)


def _without(text: Column, start: Column, length: Column) -> Column:
    """The text without one segment."""
    return F.concat(F.substring(text, F.lit(1), start - 1), F.substr(text, start + length))


def _meeting(x: DataFrame, y: DataFrame, edits: int) -> DataFrame:
    """Candidates (a, b) under equal keys: of equally long lines each pair once, letter counts as near as edits allow."""
    met = (F.col("x.key") == F.col("y.key")) & _letters_agree(F.col("x.sig"), F.col("y.sig"), edits)
    once = (F.col("y.less") > 0) | (F.col("x.h") < F.col("y.h"))
    return x.alias("x").join(y.alias("y"), met & once).select(F.col("x.h").alias("a"), F.col("y.h").alias("b"))


def _crowded(sides: DataFrame, hot: int) -> tuple[DataFrame, int]:
    """Keys whose rows would make over ``hot`` pairs each, and their number. sides: key, x (indexed rows), n (indexed and looking)."""
    sizes = sides.groupBy("key").agg(F.sum("x").alias("nx"), F.sum("n").alias("n"))
    found, _ = materialise(sizes.where(F.col("nx") * (F.col("n") - F.col("nx")) > hot * F.col("n")).select("key"), "crowded-segments")
    return found, found.count()


def _finer(x: DataFrame, y: DataFrame, edits: int) -> list[DataFrame]:
    """Both sides of crowded keys under the segments of ``text``, which is what is left of a line, and without them."""
    text, key = F.col("text"), [F.col("key")]
    asked = F.lit(None)
    for less in range(edits, -1, -1):
        asked = F.when(F.col("less") == less, _asked(text, key, F.length(text), less, edits, True, True)).otherwise(asked)
    out = []
    for side, pieces in ((x, _own(text, key, F.length(text), edits, True)), (y, asked)):
        each = side.select("h", "sig", "less", "text", F.explode(pieces).alias("p"))
        rest = _without(F.col("text"), F.col("p.start"), F.col("p.length"))
        out.append(materialise(each.select("h", "sig", "less", "p.key", rest.alias("text")), "finer-segments")[0])
    return out


def candidates(lines: DataFrame, edits: int = MAX_EDITS, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of line hashes that share a segment, and where it is crowded segments of the rest as well.

    lines: as ``measured`` gives them, distinct. A key is crowded if its lines would make more than ``hot`` pairs each.
    Two lines that share a segment are within ``edits`` edits only if what is left of them without it is, so a crowded
    key's lines are split by the segments of their rests, and those again as long as they are crowded; each step leaves
    a smaller rest. Lines that still meet when ``edits`` characters are left agree in all others.
    """
    text, n = F.col("line"), F.col("chars")
    longer_by = range(0 if edits > 1 else 1, edits + 1)  # with one edit, equally long lines share an unmoved segment

    def sides_of(place: bool) -> tuple[DataFrame, DataFrame]:
        """Rows (h, sig, less, p) of the lines' own segments, and of those that they look for elsewhere; p: key, or struct with its place."""
        mark = lambda less: F.transform(_asked(text, [], n, less, edits, False, place), lambda p: F.struct(F.lit(less).cast("byte").alias("less"), p.alias("p")))
        keep = ["h", "sig", *(["line"] if place else [])]
        own = lines.select(*keep, F.lit(0).cast("byte").alias("less"), F.explode(_own(text, [], n, edits, place)).alias("p"))
        other = lines.select(*keep, F.explode(F.concat(*map(mark, longer_by))).alias("q")).select(*keep, "q.less", "q.p")
        return own, other

    x, moved = (df.withColumnRenamed("p", "key") for df in sides_of(False))
    # A line's own segments are both indexed and looked for.
    side = lambda df, x, n: df.select("key", F.lit(x).alias("x"), F.lit(n).alias("n"))
    crowded, n_crowded = _crowded(side(x, 1, 2).union(side(moved, 0, 1)), hot)
    marks = F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded
    kept = (lambda df: df.join(marks, "key", "left_anti")) if n_crowded else (lambda df: df)
    found = [_meeting(kept(x), kept(x), edits), _meeting(kept(x), kept(moved), edits)]
    own, other = (df.select("h", "sig", "less", "p.key", "line", "p.start", "p.length").join(marks, "key", "left_semi") for df in sides_of(True))
    rest = _without(F.col("line"), F.col("start"), F.col("length")).alias("text")
    x, y = own.select("h", "sig", "less", "key", rest), own.unionByName(other).select("h", "sig", "less", "key", rest)
    while n_crowded:
        x, y = _finer(x, y, edits)
        open_ended = F.length("text") - F.col("less") > edits
        crowded, n_crowded = _crowded(side(x.where(open_ended), 1, 1).union(side(y.where(open_ended), 0, 1)), hot)
        marks = F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded
        found.append(_meeting(x.join(marks, "key", "left_anti"), y.join(marks, "key", "left_anti"), edits))
        x, y = x.join(marks, "key", "left_semi"), y.join(marks, "key", "left_semi")
    return reduce(DataFrame.union, found).distinct()


def edit_links(lines: DataFrame, edits: int = MAX_EDITS, hot: int = HOT) -> DataFrame:
    """Pairs (h, line, other_h, other) of lines within ``edits`` edits. lines: as ``measured`` gives them, distinct."""
    pairs, _ = materialise(candidates(lines, edits, hot), "line-candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    n_ids = 2 * pairs.count()
    texts, _ = materialise(lines.select("h", "line").join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, "h", "left_semi"), "candidate-lines")
    line_a, line_b = texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), texts.select(F.col("h").alias("b"), F.col("line").alias("line_b"))
    both = pairs.join(line_a, "a").join(line_b, "b")
    swap = F.length("line_a") > F.length("line_b")
    first = [F.when(swap, F.col(other)).otherwise(F.col(own)).alias(own) for own, other in (("a", "b"), ("line_a", "line_b"))]
    second = [F.when(swap, F.col(own)).otherwise(F.col(other)).alias(other) for own, other in (("a", "b"), ("line_a", "line_b"))]
    ordered = both.select(*first, *second).distinct()
    signs = ordered.withColumns({"xs": F.split("line_a", ""), "ys": F.split("line_b", "")})  # a projection of its own: each is read many times
    # A generator rather than a filter, which would be pushed below the projection and split the lines for each sign.
    within = F.filter(F.array(distance(F.col("xs"), F.col("ys"), edits)), lambda d: d > 0)
    near = signs.select("a", "line_a", "b", "line_b", F.explode(within).alias("d"))
    return near.select(F.col("a").alias("h"), F.col("line_a").alias("line"), F.col("b").alias("other_h"), F.col("line_b").alias("other"))


def verdicts(docs: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """doc, row_key, at, gone and degree (links of the line) for every line that repeats or has a link."""
    grouped = occurrences(docs).groupBy("line").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).select(F.xxhash64("line").alias("h"), "line", "first_doc", "n")
    lines, _ = materialise(measured(grouped), "lines")
    links, _ = materialise(edit_links(lines.where(F.col("chars") >= MIN_CHARS), edits), "line-links")
    n_links = links.count()
    linked = links.select("h").union(links.select(F.col("other_h").alias("h"))).distinct()
    starts, _ = materialise(lines.join(F.broadcast(linked) if 2 * n_links <= BROADCAST_ROWS else linked, "h", "left_semi").select(F.col("line").alias("t"), "first_doc"), "linked-lines")
    a, b = starts.select(F.col("t").alias("line"), F.col("first_doc").alias("doc_a")), starts.select(F.col("t").alias("other"), F.col("first_doc").alias("doc_b"))
    ordered = links.join(a, "line").join(b, "other").withColumn("forward", F.struct("doc_a", "line") < F.struct("doc_b", "other"))
    ends = ordered.select(F.explode(F.array(F.struct(F.col("line").alias("t"), (~F.col("forward")).alias("later")), F.struct(F.col("other").alias("t"), F.col("forward").alias("later")))).alias("e")).select("e.*")
    judged = ends.groupBy("t").agg(F.bool_or("later").alias("later"), F.count("*").alias("degree"))
    marked = lines.where("n > 1").select("h", F.col("line").alias("t"), "first_doc").unionByName(starts.join(lines.where("n = 1").select("h", F.col("line").alias("t")), "t").select("h", "t", "first_doc"))
    # Two 64-bit hashes stand for a line from here on, so that no text is shuffled again.
    both_hashes = lambda c: (F.xxhash64(c).alias("h"), F.xxhash64(F.lit(7), c).alias("g"))
    told, _ = materialise(marked.join(judged, "t", "left").select(*both_hashes("t"), "first_doc", F.coalesce("later", F.lit(False)).alias("later"), F.coalesce("degree", F.lit(0)).alias("degree")), "line-verdicts")
    seen = occurrences(docs).select("doc", "row_key", "at", *both_hashes("line")).join(told, ["h", "g"]).repartition("doc", "row_key")
    again = F.dense_rank().over(Window.partitionBy("doc", "row_key", "h", "g").orderBy("at")) > 1
    return seen.select("doc", "row_key", "at", (F.col("later") | (F.col("doc") != F.col("first_doc")) | again).alias("gone"), "degree")


def removed_lines(docs: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """doc, row_key, removed (sorted line numbers) and n_links of documents with a line that repeats or has a link."""
    each = verdicts(docs, edits).distinct()
    return each.groupBy("doc", "row_key").agg(F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("at")))).alias("removed"), F.sum("degree").alias("n_links"))


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """The documents without repeated lines; one that had text and keeps no line of it is dropped. Other columns stay."""
    found = removed_lines(docs, edits)
    rows = docs.select(F.struct(*docs.columns).alias("kept"), F.col("text").alias("whole"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"), _row_key())
    rest = F.filter(F.split("whole", "\n"), lambda x, i: ~F.coalesce(F.array_contains("removed", i), F.lit(False)))
    fewer = F.size("removed") > 0
    joined = rows.join(found, ["doc", "row_key"], "left").withColumn("left_over", F.when(fewer, F.array_join(rest, "\n")).otherwise(F.col("whole")))
    emptied = F.coalesce(fewer & (F.length(F.trim(F.regexp_replace("left_over", r"\s+", " "))) == 0), F.lit(False))
    return joined.where(~emptied).select(*((F.col("left_over") if c == "text" else F.col("kept")[c]).alias(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers that go, and links of its lines, for every document."""
    docs = table(spark, sf_dir, "documents")
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), _row_key(), F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"))
    found = removed_lines(docs)
    joined = base.join(found, ["doc", "row_key"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed, ",").alias("removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS doc, md5(text) AS row_key, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS ls FROM documents),
o AS (SELECT DISTINCT doc, row_key, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
occ AS (SELECT * FROM o WHERE length(line) >= 20 OR regexp_matches(line, '[\p{L}\p{N}]')),
l AS (SELECT line, min(doc) AS first_doc, length(line) AS n FROM occ GROUP BY 1),
far AS (SELECT * FROM l WHERE n >= 20),
cut AS (SELECT line, n, p, md5(left(line, p - 1) || '|' || substr(line, p + 1)) AS k, md5(left(line, p - 1) || substr(line, p + 1)) AS w FROM far, (SELECT unnest(range(1, (SELECT max(n) + 1 FROM far))) AS p) WHERE p <= n),
links AS (
  SELECT DISTINCT x.line AS a, y.line AS b FROM cut x JOIN cut y ON x.k = y.k AND x.n = y.n AND x.p = y.p AND x.line < y.line
  UNION SELECT DISTINCT x.line, y.line FROM far x JOIN cut y ON md5(x.line) = y.w AND y.n = x.n + 1),
ends AS (SELECT a AS t, b AS u FROM links UNION ALL SELECT b, a FROM links),
judged AS (SELECT t, bool_or((y.first_doc, y.line) < (x.first_doc, x.line)) AS later, count(*) AS degree FROM ends JOIN l x ON x.line = t JOIN l y ON y.line = u GROUP BY 1),
seen AS (
  SELECT occ.doc, row_key, pos, coalesce(later, false) OR doc <> first_doc OR row_number() OVER (PARTITION BY doc, row_key, occ.line ORDER BY pos) > 1 AS gone, coalesce(degree, 0) AS degree
  FROM occ JOIN l ON l.line = occ.line LEFT JOIN judged ON judged.t = occ.line),
r AS (SELECT doc, row_key, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (gone), '') AS removed, sum(degree)::BIGINT AS n_links FROM seen GROUP BY ALL)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN r USING (doc, row_key)
"""
