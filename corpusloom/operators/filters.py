"""Row filters with explicit rules for missing metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def permissive(predicate: Column) -> Column:
    """A row whose metadata is missing passes."""
    return F.coalesce(predicate, F.lit(True))


def strict(predicate: Column) -> Column:
    """A row whose metadata is missing fails."""
    return F.coalesce(predicate, F.lit(False))


def year_between(year: Column, low: int | None, high: int | None) -> Column:
    """Year bounds; a bound of 0 or none is no bound."""
    out = F.lit(True)
    if low:
        out = out & (year >= low)
    if high:
        out = out & (year <= high)
    return out


def all_words_in(text: Column, words: list[str]) -> Column:
    """Every word is somewhere in the text, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(True)
    for w in words:
        out = out & F.contains(low, F.lit(w.lower()))
    return out


def index_exclusion(text: Column, is_item: Column | None = None, least: int = 40) -> Column:
    """Why a section stays out of the index: next to no body, or a note that it was removed; list items only for the latter."""
    body = F.trim(text)
    bare = F.regexp_replace(body, r"^(\s*[\[(]\s*)+", "")
    removal = bare.rlike(r"^(?i:omitted|repealed|rep\. by)") & (F.length(bare) < 250)
    # Bounds of words are stated by letters of any script: what \b means for them depends on the Java version.
    words = F.regexp_count(body, F.lit(r"(?<![\p{L}\p{M}\p{N}_])[a-z]{2,}(?![\p{L}\p{M}\p{N}_])"))
    short = (F.length(body) < least) & (words < 3)
    if is_item is not None:
        short = short & ~is_item
    return F.when(short, "body under 40 characters").when(removal, "removal note")


def problems(rules: list[tuple[Column, str]]) -> Column:
    """Names of the rules that a record breaks, in their order."""
    return F.filter(F.array(*(F.when(broken, F.lit(name)) for broken, name in rules)), lambda x: x.isNotNull())


def filter_after_limit(ranked: DataFrame, predicate: Column, fetch: int, k: int, order: list[Column]) -> DataFrame:
    """The best ``fetch`` rows, then the filter, then the best ``k``: fewer than k may be left, and that is meant."""
    return ranked.orderBy(*order).limit(fetch).where(predicate).orderBy(*order).limit(k)


def audience_gate(hits: DataFrame, question: str, terms: dict[str, list[str]]) -> DataFrame:
    """Hits for everyone, and those for an audience that the question names by one of its terms or by their title."""
    asked = question.lower()
    named = [a for a, words in terms.items() if any(w.lower() in asked for w in words)]
    return hits.where((F.coalesce("audience", F.lit("general")) == "general") | F.col("audience").isin(named or [""]) | F.contains(F.lit(asked), F.lower("title")))


def visible_rows(rows: DataFrame, role: str, user: int, shared: DataFrame | None = None, owner: str = "owner_id", assignee: str = "assignee_id", key: str = "id") -> DataFrame:
    """Rows a user may see: lawyers those assigned to or shared with them, clients their own, others none."""
    if role == "client":
        return rows.where(F.col(owner) == user)
    if role != "lawyer":
        return rows.where(F.lit(False))
    mine = rows.where(F.col(assignee) == user)
    if shared is None:
        return mine
    others = rows.where(~F.col(assignee).eqNullSafe(F.lit(user))).join(shared.where(F.col("user_id") == user).select(key).distinct(), key, "left_semi")
    return mine.unionByName(others)
