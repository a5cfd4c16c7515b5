"""Keyed state of a crawl as Structured Streaming: politeness gate, repair budget, redesign detector, seen set, windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(urls: DataFrame, key: str = "canonical_key", time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each key once, in the order of arrival; the state is one entry a key. With ``time`` an entry is let go ``late`` after its
    key was last due, so the state does not grow for ever; a key that comes again later than that counts anew."""
    if time is None:
        return urls.dropDuplicates([key])
    return urls.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per window and key; rows later than ``late`` are let go, and a window comes out once it is over."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def in_order(batches: Iterator[pd.DataFrame], *marks: str) -> list[np.ndarray]:
    """seq and the boolean columns ``marks`` of a key's rows in a micro-batch, by seq. Nine bytes a row are all that is kept of
    them; how many there are is up to the source's own limit for a micro-batch."""
    parts = [(b["seq"].to_numpy(dtype="int64"), *(b[m].fillna(False).to_numpy(dtype=bool) for m in marks)) for b in batches]
    columns = [np.concatenate(c) for c in zip(*parts)] or [np.empty(0, dtype="int64")] * (1 + len(marks))
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def streaks(requests: DataFrame) -> DataFrame:
    """origin, seq, streak, cooldown_ms of ``requests`` (origin, seq, failed): the state of an origin is its current streak.
    Within a micro-batch rows are taken by seq."""

    def each(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (streak,) = state.get if state.exists else (0,)
        for seqs, marks in [in_order(batches, "failed")]:
            rows = []
            for seq, failed in zip(seqs, marks, strict=True):
                streak = streak + 1 if failed else 0
                rows.append((key[0], int(seq), streak, min(60_000, 1000 * 2 ** (streak - 1)) if streak else 0))
            yield pd.DataFrame(rows, columns=["origin", "seq", "streak", "cooldown_ms"])
        state.update((streak,))

    return requests.groupBy("origin").applyInPandasWithState(each, "origin string, seq long, streak long, cooldown_ms long", "streak long", "append", GroupStateTimeout.NoTimeout)


def budget(attempts: DataFrame, limit: int) -> DataFrame:
    """run_id, seq, outcome of ``attempts`` (run_id, seq): the state of a run is how much it has used."""

    def each(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (used,) = state.get if state.exists else (0,)
        rows = []
        for seq in in_order(batches)[0]:
            rows.append((key[0], int(seq), "attempt" if used < limit else "budget-exhausted"))
            used = min(limit, used + 1)
        state.update((used,))
        yield pd.DataFrame(rows, columns=["run_id", "seq", "outcome"])

    return attempts.groupBy("run_id").applyInPandasWithState(each, "run_id string, seq long, outcome string", "used long", "append", GroupStateTimeout.NoTimeout)


def redesigns(pages: DataFrame, least: int = 4, share: float = 0.5) -> DataFrame:
    """run_id, seq, pages, failing_pages of the page at which a run first looks like a redesign; said once a run."""

    def each(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, bad, told = state.get if state.exists else (0, 0, False)
        rows = []
        for seq, failing in zip(*in_order(batches, "failing"), strict=True):
            n, bad = n + 1, bad + bool(failing)
            if not told and n >= least and bad >= share * n:
                told = True
                rows.append((key[0], int(seq), n, bad))
        state.update((n, bad, told))
        yield pd.DataFrame(rows, columns=["run_id", "seq", "pages", "failing_pages"])

    return pages.groupBy("run_id").applyInPandasWithState(each, "run_id string, seq long, pages long, failing_pages long", "n long, bad long, told boolean", "append", GroupStateTimeout.NoTimeout)
