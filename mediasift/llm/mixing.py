"""Mixing sources to target weights.

Capped water-filling: a source that cannot reach its share even when each of
its documents is used the most times allowed is clamped there, and what it
leaves is spread over the other sources in proportion to their targets, until
nobody is over the cap. The repetitions of a source are a whole number for every document
and a seeded fraction of the documents once more.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The target table is read to the driver; more rows than this are refused.
MAX_SOURCES = 100_000


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_sent: set[tuple[str, str]] = set()


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text; null and empty texts have none. The vocabulary file is sent to the executors with the job."""
    spark = SparkSession.active()
    ship(spark)
    name = tokenizer.rsplit("/", 1)[-1]
    if (spark.sparkContext.applicationId, tokenizer) not in _sent:
        spark.sparkContext.addFile(tokenizer)
        _sent.add((spark.sparkContext.applicationId, tokenizer))

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


@dataclass(frozen=True)
class Fill:
    share: float
    epochs: float
    clamped: bool
    reachable: bool


def water_fill(tokens: dict[str, int], target: dict[str, float], cap: dict[str, int], total: int) -> dict[str, Fill]:
    """Share of ``total`` and epochs for each source.

    The first pass of the filling pours each source its own target; who is over the cap there is not
    ``reachable``. ``clamped`` tells whether a source ended at its cap, which may also come
    from taking over what others left in later passes. If all
    sources together cannot fill ``total``, all are clamped and the mix is smaller. Targets that do not
    sum to one leave the rest, or what is too much, to the later passes.
    """
    most = {s: tokens.get(s, 0) * cap[s] / total if total else 0.0 for s in target}
    given: dict[str, float] = {}
    first = {s for s in target if target[s] > most[s]} if total else set()
    left = 1.0 - sum(most[s] for s in first)
    given |= {s: most[s] for s in first}
    free = set(target) - first
    while free:
        weight = sum(target[s] for s in free)
        over = {s for s in free if weight <= 0 or target[s] / weight * left > most[s]}
        if not over:
            given |= {s: target[s] / weight * left for s in free}
            break
        given |= {s: most[s] if weight > 0 else 0.0 for s in over}
        left -= sum(given[s] for s in over)
        free -= over
    out = {}
    for s in target:
        n = tokens.get(s, 0)
        epochs = given[s] * total / n if n else 0.0
        out[s] = Fill(given[s], min(epochs, float(cap[s])), given[s] >= most[s], s not in first)
    return out


def plan_mix(documents: DataFrame, targets: DataFrame, size: str = "n_tokens") -> DataFrame:
    """``source, target_share, max_repeats, tokens, planned_share, epochs, clamped, reachable``, one row a source of ``targets``.

    ``documents`` has ``source`` and ``size``. The mix has as many tokens as
    all of ``documents``, null sources and sources without a target included. A target row with a null
    source or share is left out, repeated rows of a source count once (the largest), negative shares count as 0,
    a null ``max_repeats`` as 1.
    """
    spark = documents.sparkSession
    wanted = targets.where("source IS NOT NULL AND target_share IS NOT NULL").groupBy("source").agg(F.max(F.greatest("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    named = F.broadcast(wanted.select("source", F.lit(True).alias("wanted")))
    sums = documents.select("source", size).join(named, "source", "left").groupBy(F.when(F.col("wanted"), F.col("source")).alias("source")).agg(F.sum(size).alias("n")).collect()
    tokens = {r["source"]: int(r["n"] or 0) for r in sums}
    total = sum(tokens.values())
    fills = water_fill({k: v for k, v in tokens.items() if k is not None}, {r["source"]: r["share"] for r in rows}, {r["source"]: r["cap"] for r in rows}, total)
    data = [(r["source"], float(r["share"]), int(r["cap"]), tokens.get(r["source"], 0), f.share, f.epochs, f.clamped, f.reachable) for r in rows for f in [fills[r["source"]]]]
    return spark.createDataFrame(data, "source string, target_share double, max_repeats int, tokens bigint, planned_share double, epochs double, clamped boolean, reachable boolean")


def draw_mix(documents: DataFrame, plan: DataFrame, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """``documents`` rows that are in the mix with ``copies``: the whole epochs, and one more for a seeded part of the documents.

    The draw is a hash of seed and identifier, the same on every run and any
    cluster. Documents without a planned source are left out; a column ``copies`` of their own is replaced.
    """
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = F.broadcast(plan.select("source", F.col("epochs").alias("_mix_epochs")))  # at most MAX_SOURCES rows, see plan_mix
    whole = F.floor("_mix_epochs")
    drawn = documents.join(rates, "source").withColumn("copies", whole + (part < F.col("_mix_epochs") - whole).cast("bigint"))
    return drawn.where("copies > 0").drop("_mix_epochs")


def mix_report(documents: DataFrame, plan: DataFrame, size: str = "n_tokens", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """The plan with ``mixed_tokens`` and the ``actual_share`` reached by the draw."""
    got = draw_mix(documents, plan, id_col, seed).groupBy("source").agg(F.sum(F.col(size) * F.col("copies")).alias("mixed_tokens"))
    mix = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # over the plan, at most MAX_SOURCES rows
    return plan.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0))).withColumn("actual_share", F.when(mix > 0, F.col("mixed_tokens") / mix).otherwise(0.0))
