"""Category listings: the categories of an index page with their counts, and the laws of accordion pages with what stands behind each.

Pages are cut at their tags; a running sum of opening and closing divs gives every piece its depth, so that a link finds the block it
stands in, whatever is nested there, and a block the one that follows it under the same parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

_MARK = "\x1e"
# Signs that stand for others in HTML.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def plain(html: Column) -> Column:
    """Text of a piece of HTML: tags out, common entities resolved, white space as one space."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return T.one_space(out)


def _attribute(tag: Column, name: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(tag, rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*'([^']*)'", 1))


def pieces(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, n, tag, piece (the tag and the text behind it) and depth (divs that are open once the tag is read). Comments are left out."""
    clean = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    cut = pages.select(key, F.posexplode(F.split(F.regexp_replace(clean, "<", _MARK + "<"), _MARK)).alias("n", "piece"))
    tag = F.regexp_extract("piece", r"(?s)^(<[^>]*>)", 1)
    step = F.when(F.lower("piece").rlike(r"^<div[\s>]"), 1).when(F.lower("piece").rlike(r"^</div[\s>]"), -1).otherwise(0)
    so_far = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumns({"tag": tag, "step": step}).withColumn("depth", F.sum("step").over(so_far)).drop("step")


def accordion(pages: DataFrame, key: str, title: str = "accordion-section-title", content: str = "accordion-section-content", html: str = "html") -> DataFrame:
    """key, nth, title, target, act_number and promulgated of the laws of accordion pages.

    A law is a block of class ``title`` that holds a link: the first link's text and target. The block of class ``content`` that comes
    next, under the same parent, tells the rest in parts between strokes: the second part is the act's number if it has "of" in it. A
    title without such a block has neither. Titles inside of titles aren't expected. Null pages have no rows.
    """
    named = lambda c: F.col("tag").rlike(r"(?i)^<div\b") & F.contains(_attribute(F.col("tag"), "class"), F.lit(c))
    each = pieces(pages, key, html).withColumn("kind", F.when(named(title), "title").when(named(content), "content"))
    so_far = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("kind").isNotNull(), F.struct(F.col("n").alias("block"), "kind", F.col("depth").alias("level")))
    inside = each.withColumn("b", F.last(opened, ignorenulls=True).over(so_far)).where("b is not null").select(key, "n", "tag", "piece", "depth", "b.*")
    within = Window.partitionBy(key, "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    low = inside.withColumn("low", F.min("depth").over(within))
    own = F.col("low") >= F.col("level")
    # The link's text ends at its closing tag: pieces of the block are numbered by the links that have begun and ended before.
    links = F.col("tag").rlike(r"(?i)^<a\b")
    in_link = low.withColumns({"links": F.count_if(links & own).over(within), "ends": F.count_if(F.lower("piece").startswith("</a") & own).over(within)})
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("n", "piece")))), lambda x: x["piece"]), "")
    blocks = in_link.groupBy(key, "block", "kind", "level").agg(
        joined(own & (F.col("links") == 1) & (F.col("ends") == 0)).alias("link"), joined(own).alias("all"), F.first(F.when(links & own & (F.col("links") == 1), F.col("tag")), ignorenulls=True).alias("anchor"), F.min("depth").alias("lowest")
    )
    after = Window.partitionBy(key).orderBy("block")
    follower = F.lead(F.struct("kind", "level", "all")).over(after)
    near = blocks.withColumn("f", follower).where((F.col("kind") == "title") & F.col("anchor").isNotNull())
    # The parent stays open between both: nothing up to the next block goes below the level around the title.
    sibling = (F.col("f.kind") == "content") & (F.col("f.level") == F.col("level")) & (F.col("lowest") >= F.col("level") - 1)
    rows = near.withColumn("meta", F.when(sibling, plain(F.col("f.all"))).otherwise("")).withColumn("parts", F.transform(F.split("meta", r"\|"), lambda p: F.trim(p)))
    number = F.get("parts", F.lit(1))
    date = F.nullif(F.trim(F.regexp_extract("meta", r"Promulgation Date:\s*(.+)$", 1)), F.lit(""))
    nth = F.row_number().over(after)
    return rows.select(key, nth.alias("nth"), plain(F.col("link")).alias("title"), F.trim(_attribute(F.col("anchor"), "href")).alias("target"), F.when(number.rlike(r"\bof\b"), number).alias("act_number"), date.alias("promulgated"))


def categories(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, catid, name, target and badge (the count in brackets behind the name in the page's text, or null) of an index page's links.

    The first link of each catid counts.
    """
    cut = pieces(pages, key, html)
    links = F.col("tag").rlike(r"(?i)^<a\b")
    so_far = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    whole = cut.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("whole"))
    ended = cut.withColumns({"link": F.count_if(links).over(so_far), "close": F.lower("piece").startswith("</a")})
    closed = F.count_if("close").over(Window.partitionBy(key, "link").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    inner = ended.withColumn("closed", closed).where("link > 0 and closed = 0").groupBy(key, "link").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("a"))
    found = inner.select(key, "link", plain(F.col("a")).alias("name"), F.trim(_attribute(F.regexp_extract("a", r"(?s)^(<[^>]*>)", 1), "href")).alias("target"))
    told = found.withColumn("catid", F.regexp_extract("target", r"catid=(\d+)", 1).try_cast("long")).where("catid is not null")
    first = told.withColumn("__n", F.row_number().over(Window.partitionBy(key, "catid").orderBy("link"))).where("__n = 1")
    badge = F.regexp_substr(plain(F.col("whole")), F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E\s*\(\d+\)")))
    return first.join(whole, key).select(key, "catid", "name", "target", F.regexp_extract(badge, r"\((\d+)\)$", 1).try_cast("long").alias("badge"))
