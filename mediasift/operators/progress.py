"""Throughput and time left from progress samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Throughput
from ..ship import ship


class Rate:
    """WIN-05: smoothed rate of one run. A new stage starts over; samples closer than the interval only move the counts; a count that fell moves the anchor but tells no rate."""

    def __init__(self, c: Throughput = Throughput()):
        self.c = c
        self.stage = self.anchor = self.rate = None
        self.samples = 0

    def add(self, stage: str, completed: float, elapsed: float) -> None:
        if elapsed < 0:
            return
        if stage != self.stage:
            self.stage, self.anchor, self.rate, self.samples = stage, (elapsed, completed), None, 0
            return
        at, done = self.anchor
        if elapsed - at < self.c.min_interval_s:
            return
        if completed >= done:
            seen = (completed - done) / (elapsed - at)
            self.rate = seen if self.rate is None else self.c.alpha * seen + (1 - self.c.alpha) * self.rate
            self.samples += 1
        self.anchor = (elapsed, completed)


def rates(samples: DataFrame, config: Throughput = Throughput()) -> DataFrame:
    """WIN-05: ``run, stage, completed, total, rate, samples`` after the last sample of each run.

    ``samples`` has ``run, stage, completed, total, elapsed``. Runs are folded in order of time as a stream over sorted
    partitions: one row and one small state are held at a time, however long a run is. Null times are left out.
    """
    ship(samples.sparkSession)
    ordered = samples.select("run", F.col("elapsed").cast("double").alias("elapsed"), "stage", F.col("completed").cast("double").alias("completed"), F.col("total").cast("double").alias("total")).where("elapsed IS NOT NULL AND run IS NOT NULL").repartition("run").sortWithinPartitions("run", "elapsed", "completed")
    kind = ordered.schema["run"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = state = last = None
        names = ["run", "stage", "completed", "total", "rate", "samples"]
        for pdf in batches:
            out = []
            for r, elapsed, stage, completed, total in pdf.itertuples(index=False, name=None):
                if r != run:
                    if state:
                        out.append((run, *last, state.rate, state.samples))
                    run, state = r, Rate(config)
                state.add(stage, completed, elapsed)
                last = (stage, completed, total)
            yield pd.DataFrame(out, columns=names)
        if state:
            yield pd.DataFrame([(run, *last, state.rate, state.samples)], columns=names)

    return ordered.mapInPandas(fold, f"run {kind}, stage string, completed double, total double, rate double, samples int")


def review_log(events: DataFrame, session: list[str], item: str, order: list[str], decision: str) -> DataFrame:
    """WIN-09: ``session..., item, decision`` after a log of decisions and undos (null ``decision``).

    An undo takes back the latest decision that still stands, and its item has the decision from before again, if any; with nothing left to
    undo it changes nothing. As balanced brackets: a decision stands if the height after it is never gone below later, which running sums and
    minima tell in one pass each way over the sorted session. Rows of a null session are left out.
    """
    rows = events.where(F.concat(*[F.col(c).cast("string") for c in session]).isNotNull())
    forth = Window.partitionBy(*session).orderBy(*order)
    back = Window.partitionBy(*session).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col(decision).isNull(), -1).otherwise(1)
    # Undos with nothing to undo do not count: heights are taken from the lowest sum so far.
    level = rows.withColumn("_sum", F.sum(step).over(forth)).withColumn("_level", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(forth)))
    stands = level.withColumn("_low", F.min("_level").over(back)).where(F.col(decision).isNotNull() & (F.col("_low").isNull() | (F.col("_low") >= F.col("_level"))))
    return stands.groupBy(*session, item).agg(F.max_by(decision, F.struct(*order)).alias("decision"))


def estimate(c: Throughput = Throughput()) -> tuple[Column, Column]:
    """WIN-06: state and whole seconds left from ``completed, total, rate, samples``."""
    left = F.col("total") - F.col("completed")
    seconds = left / F.col("rate")
    known = F.coalesce((F.col("rate") > 0) & (F.col("samples") >= c.min_samples), F.lit(False))
    state = F.when(F.col("stage").isNull(), "calculating").when(F.coalesce(F.col("total") <= 0, F.lit(True)), "indeterminate").when(~known, "calculating").when((left <= 0) | (seconds < c.finishing_s), "finishing").otherwise("remaining")
    return state, F.when(state == "remaining", F.round(seconds).cast("bigint"))


def remaining_text(seconds: Column) -> Column:
    """FMT-01: seconds below a minute, then minutes, then hours and minutes."""
    minutes = F.round(seconds / 60).cast("bigint")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min")))
