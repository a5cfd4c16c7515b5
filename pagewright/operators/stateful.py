"""Keyed state of a crawl in its batch form: politeness, streaks, budgets, redesign. The streaming forms are in
``pagewright.streaming.keyed``; both give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.scalars import backoff_ms
from pagewright.operators.prefix import running


def earliest_start(requests: DataFrame, key: str, finished: str, gap_ms: int, order: list[str]) -> DataFrame:
    """When each request may start at the earliest: the one before has finished and the gap has passed (``finished`` in ms)."""
    return running(requests, [key], order, {}, {"_before": finished}).withColumn("earliest_ms", F.col("_before") + gap_ms).drop("_before")


def failure_streaks(requests: DataFrame, key: str, failed: str, order: list[str], base: int = 1000, most: int = 60_000) -> DataFrame:
    """Consecutive failures up to each request and the cool-down that follows; a success starts anew. Failures between two
    successes are an island; both its number and the place in it come from running sums."""
    bad = F.coalesce(failed, F.lit(False))
    d = running(requests, [key], order, {"_island": (~bad).cast("long")})
    d = running(d, [key, "_island"], order, {"streak": bad.cast("long")}).drop("_island")
    return d.withColumn("cooldown_ms", F.when(F.col("streak") > 0, backoff_ms(F.col("streak"), base, most)).otherwise(F.lit(0)))


def within_budget(attempts: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` attempts of a run use the budget, the others find it exhausted."""
    d = running(attempts, [key], order, {"_place": F.lit(1).cast("long")})
    return d.withColumn("outcome", F.when(F.col("_place") <= limit, "attempt").otherwise("budget-exhausted")).drop("_place")


def redesign(pages: DataFrame, key: str, failing: str, order: list[str], least: int = 4, share: float = 0.5) -> DataFrame:
    """Running share of failing pages and whether it looks like a redesign: at least ``least`` pages, half of them failing."""
    d = running(pages, [key], order, {"pages": F.lit(1).cast("long"), "failing_pages": F.coalesce(failing, F.lit(False)).cast("long")})
    return d.withColumn("likely_redesign", (F.col("pages") >= least) & (F.col("failing_pages") >= share * F.col("pages")))


class Gate:
    """The politeness gate of one origin, over a clock that it moves itself: requests are asked for one after another."""

    def __init__(self, gap_ms: int = 200, slots: int = 2, base_ms: int = 1000, most_ms: int = 60_000):
        self.gap, self.slots, self.base, self.most = gap_ms, slots, base_ms, most_ms
        self.running: list[tuple[int, int | None, int | None]] = []  # end, status, Retry-After of what is under way
        self.now, self.last_end, self.cooldown, self.failures = 0, None, 0, 0

    def _end(self, request: tuple) -> None:
        end, status, retry = request
        self.running.remove(request)
        self.now = max(self.now, end)
        self.last_end = end
        if status is None or status in (429, 503):
            self.failures += 1
            self.cooldown = end + (min(self.most, self.base * 2 ** (self.failures - 1)) if retry is None else max(0, int(retry)))
        else:
            self.failures = self.cooldown = 0

    def go(self, ms: float, status: float | None, retry_ms: float | None = None, delay_ms: float = 0) -> tuple[int, int]:
        """(start, end) of the next request, which takes ``ms`` and is answered with ``status`` (None: not at all)."""
        gap = max(self.gap, int(delay_ms))
        while True:
            for r in sorted((x for x in self.running if x[0] <= self.now), key=lambda x: x[0]):
                self._end(r)
            earliest = max(self.cooldown, 0 if self.last_end is None else self.last_end + gap)
            if len(self.running) >= self.slots:
                self.now = min(x[0] for x in self.running)
            elif self.now < earliest:
                # What ends before then may put the time off further.
                self.now = min([earliest, *(x[0] for x in self.running)])
            else:
                request = (self.now + int(ms), None if status is None else int(status), retry_ms)
                self.running.append(request)
                return self.now, request[0]
