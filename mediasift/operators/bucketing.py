"""Candidate buckets: assets of one shape taken close together, at most a few dozen in each.

Ordering work is done in slices of one global range partitioning, so an aspect
ratio or a burst that holds a large part of all rows is spread like any other.
Only one row for each key and slice crosses between slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Bucketing
from ..scratch import Scratch
from ..ship import ship
from .catalog import aspect_key, duration_key, eligibility, first_rows

#: Order value of a null date: before every date.
OLDEST = -(1 << 62)


def micros(ts: str = "created") -> Column:
    return F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(OLDEST))


def _slices(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Rows (with ``t`` and ``id``) written in order of key, time and identifier, with the number of their range partition."""
    return scratch.write(rows.repartitionByRange(*keys, "t", "id").withColumn("slice", F.spark_partition_id()))


def _before(slices: DataFrame, keys: list[str], totals: list[Column], carried: dict[str, Column]) -> DataFrame:
    """For each key and slice what the key's earlier slices leave: one row a slice, so the window is small."""
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.groupBy(*keys, "slice").agg(*totals).select(*keys, "slice", *[c.over(earlier).alias(n) for n, c in carried.items()])


def chains(rows: DataFrame, keys: list[str], scratch: Scratch, max_gap_s: float = Bucketing.max_gap_s) -> DataFrame:
    """WIN-01: ``rows`` with ``t``, ``ord`` and ``chain``, both counted from 0 within the key.

    A chain ends where the next row is more than ``max_gap_s`` later. Null dates are one chain before all others.
    """
    sliced = _slices(rows.withColumn("t", micros()), keys, scratch)
    last = _before(sliced, keys, [F.max("t").alias("last"), F.count("*").alias("n")], {"t_before": F.max("last"), "rows_before": F.sum("n")})
    inside = Window.partitionBy(*keys, "slice").orderBy("t", "id")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    lagged = sliced.join(last, [*keys, "slice"]).withColumn("prev", F.coalesce(F.lag("t").over(inside), "t_before"))
    gap = F.when(F.col("prev") == OLDEST, F.col("t") != OLDEST).otherwise(F.col("t") - F.col("prev") > int(max_gap_s * 1_000_000))
    flagged = scratch.write(lagged.withColumn("starts", F.coalesce(gap, F.lit(False)).cast("bigint")).withColumn("ord", F.row_number().over(inside) - 1 + F.coalesce("rows_before", F.lit(0))).drop("prev", "t_before", "rows_before"))
    offset = _before(flagged, keys, [F.sum("starts").alias("n")], {"chains_before": F.sum("n")})
    return flagged.join(offset, [*keys, "slice"]).withColumn("chain", F.sum("starts").over(upto) + F.coalesce("chains_before", F.lit(0))).drop("starts", "chains_before")


class _Cutter:
    """Cuts one chain, fed row by row; holds at most two buckets of rows."""

    def __init__(self, n: int, cap: int):
        self.left, self.cap, self.held, self.done = n, cap, [], []

    def feed(self, row: tuple) -> None:
        self.held.append(row)
        while self.left > 2 * self.cap and len(self.held) > self.cap:
            self._cut(1, self.cap)
        if self.left <= 2 * self.cap and len(self.held) == self.left:
            if self.left > self.cap:
                self._cut(self.left - self.cap, self.cap)
            self._cut_at(len(self.held))

    def _cut(self, low: int, high: int) -> None:
        gaps = {i: self.held[i][0] - self.held[i - 1][0] for i in range(low, high + 1)}
        widest, middle = max(gaps.values()), self.left // 2
        at = min((i for i in gaps if gaps[i] == widest), key=lambda i: (abs(i - middle), i)) if widest > 0 else min(max(middle, low), high)
        self._cut_at(at)

    def _cut_at(self, at: int) -> None:
        self.done.append(self.held[:at])
        self.held = self.held[at:]
        self.left -= at


def split_chains(chained: DataFrame, keys: list[str], scratch: Scratch, cap: int = Bucketing.max_bucket) -> DataFrame:
    """WIN-02: ``chained`` with ``piece``, so that no piece of a chain has more than ``cap`` rows.

    A full piece is cut off the front at the widest gap that keeps it within the cap; the last cut keeps both sides
    within it; equal gaps are cut nearest the middle. Only longer chains pass through Python, in order and with two pieces held at a time.
    """
    ship(chained.sparkSession)
    sized = scratch.write(chained.groupBy(*keys, "chain").agg(F.count("*").alias("n")).where(F.col("n") > cap))
    short = chained.join(sized, [*keys, "chain"], "left_anti").withColumn("piece", F.lit(0))
    long = chained.join(sized, [*keys, "chain"]).select(*keys, "chain", "n", "t", "id").repartition(*keys, "chain").sortWithinPartitions(*keys, "chain", "t", "id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in long.select(*keys, "chain", "id").schema)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cutter, piece = None, None, 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                head, (n, t, id_) = row[: len(keys) + 1], row[len(keys) + 1 :]
                if head != at:
                    at, cutter, piece = head, _Cutter(n, cap), 0
                cutter.feed((t, id_))
                for rows in cutter.done:
                    out += [(*head, r[1], piece) for r in rows]
                    piece += 1
                cutter.done = []
            yield pd.DataFrame(out, columns=[*keys, "chain", "id", "piece"])

    pieces = long.mapInPandas(cut, f"{fields}, piece int")
    return short.unionByName(chained.join(pieces, [*keys, "chain", "id"]))


def buckets(assets: DataFrame, scratch: Scratch, config: Bucketing = Bucketing()) -> DataFrame:
    """WIN-03/04: ``bucket_id, kind, id`` and the asset's columns for every asset that takes part.

    Photos are put together by aspect and time, videos also by duration. Of repeated identifiers one row takes part.
    """
    routed = first_rows(assets).withColumn("route", eligibility(config)).where(F.col("route").isin("image", "video"))
    keyed = routed.withColumn("aspect", aspect_key(config.aspect_tolerance)).withColumn("span", F.when(F.col("route") == "video", F.coalesce(duration_key(config.duration_tolerance), F.lit(0))).otherwise(F.lit(-1)))
    keys = ["route", "aspect", "span"]
    cut = scratch.write(split_chains(chains(keyed, keys, scratch, config.max_gap_s), keys, scratch, config.max_bucket))
    heads = cut.groupBy(*keys, "chain", "piece").agg(F.count("*").alias("bucket_rows"), F.min("ord").alias("first_ord"), F.min_by("id", F.struct("t", "id")).alias("first_id"))
    name = F.concat(F.when(F.col("route") == "video", "v").otherwise("a"), F.col("aspect").cast("string"), F.when(F.col("route") == "video", F.concat(F.lit("-d"), F.col("span").cast("string"))).otherwise(""), F.lit("-"), F.col("bucket_rows").cast("string"), F.lit("-"), "first_id")
    return cut.join(heads, [*keys, "chain", "piece"]).withColumn("bucket_id", name)


def pair_bound(bucketed: DataFrame) -> DataFrame:
    """AGG-11: pairs within buckets, and pairs without any."""
    sizes = bucketed.groupBy("bucket_id").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    return sizes.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).cast("bigint").alias("pairs"), F.coalesce(pairs(F.sum("n")), F.lit(0)).cast("bigint").alias("all_pairs"), F.count("*").alias("buckets"), F.max("n").alias("largest"))
