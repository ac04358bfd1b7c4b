"""Pairs within buckets, in Arrow batches: rows are sorted by bucket and compared as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..ship import ship

#: Rows of a bucket that are compared with all of it at once, and the size from which a bucket is compared that way.
BLOCK_ROWS, DENSE = 256, 32

#: Tells, for two arrays of items as unsigned numbers (or any shapes that broadcast), which pairs to keep.
Accept = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pairs_in_buckets(keyed: DataFrame, accept: Accept, a: str = "a", b: str = "b", prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(a, b)``, ``a < b``: items (bigint) of ``keyed`` (``bucket, item``) that share a bucket and that ``accept`` keeps.

    ``prepare`` makes of all items what ``accept`` compares. A pair that shares several buckets comes several times. A task holds one
    bucket and one batch at a time; buckets must be bounded by the caller.
    """
    ship(keyed.sparkSession)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, item = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for pdf in batches:
            if pdf.empty:
                continue
            bucket, item = np.concatenate([bucket, pdf["bucket"].to_numpy()]), np.concatenate([item, pdf["item"].to_numpy()])
            # The last bucket may go on in the next batch.
            whole = len(bucket) - int(np.argmax(bucket[::-1] != bucket[-1])) if bucket[0] != bucket[-1] else 0
            yield from _named(_pairs(bucket[:whole], item[:whole].view(np.uint64), accept, prepare), a, b)
            bucket, item = bucket[whole:], item[whole:]
        yield from _named(_pairs(bucket, item.view(np.uint64), accept, prepare), a, b)

    return keyed.select("bucket", "item").repartition("bucket").sortWithinPartitions("bucket").mapInPandas(meet, f"{a} bigint, {b} bigint")


def _named(pairs: Iterator[tuple[np.ndarray, np.ndarray]], a: str, b: str) -> Iterator[pd.DataFrame]:
    for x, y in pairs:
        x, y = x.view(np.int64), y.view(np.int64)
        apart = x != y
        if apart.any():
            yield pd.DataFrame({a: np.minimum(x, y)[apart], b: np.maximum(x, y)[apart]})


def _pairs(bucket: np.ndarray, item: np.ndarray, accept: Accept, prepare: Callable | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within runs of equal ``bucket``: small runs together, step by step; large ones in blocks of rows."""
    if not len(item):
        return
    seen = prepare(item) if prepare else item
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(bucket)]
    sizes = ends - starts
    last = np.repeat(ends, sizes)
    at = np.flatnonzero(np.repeat(sizes <= DENSE, sizes))
    step = 1
    while True:
        at = at[at + step < last[at]]
        if not len(at):
            break
        keep = np.flatnonzero(accept(seen[at], seen[at + step]))
        if len(keep):
            yield item[at[keep]], item[at[keep] + step]
        step += 1
    for s, e in zip(starts[sizes > DENSE], ends[sizes > DENSE], strict=True):
        run, of = item[s:e], seen[s:e]
        for i in range(0, len(run), BLOCK_ROWS):
            x, y = np.nonzero(accept(of[i : i + BLOCK_ROWS, None], of[None, i:]))
            keep = x < y
            if keep.any():
                yield run[i + x[keep]], run[i + y[keep]]
