"""Staged runs as a stream: what was fetched becomes new, changed, unchanged, already held or quarantined, by keyed state.

A run's listing is cut to what it may do (``chosen``), fetched, and put in a stream of files. State is kept by url (last text, time)
and by text (who holds it), in the state store: a batch reads the keys it meets and nothing else, however many runs came before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FETCHED = "url string, seq long, run string, source string, hash string, fetched_at timestamp, core boolean, problem string, error string"
_STEP = "hash string, seq long, url string, run string, source string, kind string, reason string"
OUTCOME = "run string, source string, seq long, url string, hash string, outcome string, reason string"


def chosen(listing: DataFrame, caps: Column, seconds: float | None = None) -> DataFrame:
    """``listing`` cut to what a run does, with status "do" or why not.

    listing: run, source, source_order, seq, url, priority (boolean), cost (seconds). Priority items come first, a url once; a source
    does ``caps`` of them; where the seconds of all sources so far, in their order, are over ``seconds``, the run ends.
    """
    once = Window.partitionBy("run", "source", "url").orderBy(F.desc("priority"), "seq")
    order = Window.partitionBy("run", "source").orderBy(F.desc("priority"), "seq")
    rows = listing.withColumn("__copy", F.row_number().over(once)).withColumn("nth", F.when(F.col("__copy") == 1, F.count_if(F.col("__copy") == 1).over(order)))
    rows = rows.withColumn("status", F.when(F.col("__copy") > 1, "listed twice").when(F.col("nth") > caps, "over the cap").otherwise("do"))
    if seconds is not None:
        # Only rows within the caps are summed: a run's own bounded list, not its listing.
        within = rows.where("status = 'do'")
        so_far = Window.partitionBy("run").orderBy("source_order", F.desc("priority"), "seq").rowsBetween(Window.unboundedPreceding, -1)
        spent = within.withColumn("status", F.when(F.coalesce(F.sum("cost").over(so_far), F.lit(0.0)) > seconds, "budget spent").otherwise("do"))
        rows = spent.unionByName(rows.where("status <> 'do'"))
    return rows.drop("__copy")


class ByUrl(StatefulProcessor):
    """Last text and time of each url: passes on what is new to it, and tells the text it had before that it has left."""

    def __init__(self, skip_hours: float):
        self.skip = pd.Timedelta(hours=skip_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, at timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.last.get() if self.last.exists() else None
        digest, at = (held[0], held[1]) if held else (None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["run", "seq"]).itertuples(index=False):  # a url's fetches of one batch
            row = [r.hash, r.seq, key[0], r.run, r.source]
            if at is not None and pd.notna(r.fetched_at) and r.fetched_at - at < self.skip:
                out.append([*row, "skipped_recent", None])
            elif isinstance(r.error, str):
                out.append([*row, "error", r.error])
            else:
                if digest == r.hash:
                    out.append([*row, "unchanged", None])
                else:
                    if digest is not None:
                        out.append([digest, *row[1:], "left", None])
                    kind = "core" if r.core else "bad" if isinstance(r.problem, str) else "changed" if digest is not None else "new"
                    out.append([*row, kind, r.problem if isinstance(r.problem, str) else None])
                digest, at = r.hash, r.fetched_at
        if digest is not None:
            self.last.update((digest, at))
        if out:
            yield pd.DataFrame(out, columns=["hash", "seq", "url", "run", "source", "kind", "reason"])

    def close(self) -> None:
        pass


class ByText(StatefulProcessor):
    """Who holds each text, and who had it first in the run: one value for a text, however many urls ask for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "url string")
        self.first = handle.getValueState("first", "run string, url string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        holder = self.holder.get()[0] if self.holder.exists() else None
        run, first = tuple(self.first.get()) if self.first.exists() else (None, None)
        parts, out = pd.concat(list(rows)), []
        for r in parts.sort_values(["run", "seq"]).itertuples(index=False):
            outcome, reason = r.kind, r.reason if isinstance(r.reason, str) else None
            if r.kind == "left":
                holder = None if holder == r.url else holder
                continue
            if r.kind == "core":
                outcome, reason = "already_held", "a core law"
            elif r.kind in ("new", "changed", "bad"):
                if r.run == run and first != r.url:
                    outcome, reason = "quarantined", f"same text as {first}"
                elif holder is not None and holder != r.url:
                    outcome, reason = "already_held", f"same text as {holder}"
                else:
                    run, first = r.run, r.url
                    if r.kind == "bad":
                        outcome = "quarantined"
                    else:
                        holder = r.url
            out.append((r.run, r.source, r.seq, r.url, key[0], outcome, reason))
        if holder is None:
            self.holder.clear()
        else:
            self.holder.update((holder,))
        if run is not None:
            self.first.update((run, first))
        if out:  # one table for a key: one for each row costs more than all else
            yield pd.DataFrame(out, columns=["run", "source", "seq", "url", "hash", "outcome", "reason"])

    def close(self) -> None:
        pass


def staged(fetched: DataFrame, skip_hours: float = 20.0) -> DataFrame:
    """Outcome of every fetched document of a stream (columns of FETCHED): run, source, seq, url, hash, outcome and reason.

    Runs sort by name and, within a batch, seq gives the order. A text that several urls bring in one run is the first one's; one that
    a url holds from an earlier run is already held; a url that brings another text gives its old one up.
    """
    fetched.sparkSession.streams  # a batch needs the coordinator of state stores, too, and this starts it
    rows = fetched.select([f.strip().split(" ")[0] for f in FETCHED.split(",")])
    by_url = rows.groupBy("url").transformWithStateInPandas(ByUrl(skip_hours), outputStructType=_STEP, outputMode="Append", timeMode="None")
    return by_url.groupBy("hash").transformWithStateInPandas(ByText(), outputStructType=OUTCOME, outputMode="Append", timeMode="None")


def run_log(outcomes: DataFrame) -> DataFrame:
    """A row for each run and source: counts of each outcome, and whether all went well."""
    kinds = ("new", "changed", "unchanged", "already_held", "quarantined", "skipped_recent", "error")
    return outcomes.groupBy("run", "source").agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in kinds)).withColumn("complete", F.col("error") == 0)
