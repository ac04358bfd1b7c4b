import random

import pytest
from pyspark.sql import functions as F

from mediasift.llm import mixing

TARGET = "source string, target_share double, max_repeats int"


def test_water_filling_is_feasible_and_proportional():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 7)
        tokens = {f"s{i}": rng.randint(0, 1000) for i in range(n)}
        weights = [rng.random() for _ in range(n)]
        target = {f"s{i}": w / sum(weights) for i, w in enumerate(weights)}
        cap = {s: rng.randint(1, 4) for s in target}
        total = sum(tokens.values())
        fill = mixing.water_fill(tokens, target, cap, total)
        assert all(f.share * total <= tokens[s] * cap[s] + 1e-6 for s, f in fill.items())
        free = [s for s, f in fill.items() if f.share * total < tokens[s] * cap[s] - 1e-6]
        if free:
            assert sum(f.share for f in fill.values()) == pytest.approx(1)
            ratios = [fill[s].share / target[s] for s in free]
            assert max(ratios) == pytest.approx(min(ratios))
        assert all(f.reachable == (target[s] * total <= tokens[s] * cap[s]) for s, f in fill.items())


def test_report_and_draw(spark, rows):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 10 < 9, "big").alias("source"), F.lit(10).alias("n_tokens")).withColumn("copies", F.lit("x")).withColumn("wanted", F.lit(1)).withColumn("epochs", F.lit(2))
    targets = spark.createDataFrame([("small", 0.5, 2), ("small", 0.5, 2), ("big", 0.5, 1), ("absent", 0.0, 1), (None, 0.3, 1)], TARGET).withColumn("tokens", F.lit(0))
    plan = mixing.plan_mix(docs, targets)
    got = {r.source: r for r in plan.collect()}
    assert not got["small"].reachable and got["small"].epochs == pytest.approx(2) and got["big"].reachable and got["absent"].reachable
    # 400 documents twice; the rest of 4000 from 3200 others, which is all of them.
    assert got["big"].clamped and got["big"].epochs == pytest.approx(1)
    drawn = {(r.source, r.copies): r["count"] for r in mixing.draw_mix(docs, plan).groupBy("source", "copies").count().collect()}
    assert drawn == {("small", 2): 400, ("big", 1): 3200}
    report = {r.source: r.actual_share for r in mixing.mix_report(docs, plan).collect()}
    assert report["small"] == pytest.approx(0.2) and sum(report.values()) == pytest.approx(1)


def test_fractions_are_seeded(spark, rows):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10_000, "a").otherwise("b").alias("source"), F.lit(1).alias("n_tokens"))
    plan = mixing.plan_mix(docs, spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 1)], TARGET))
    one, same, other = (rows(mixing.draw_mix(docs, plan, seed=s), "doc_id", "copies") for s in (1, 1, 2))
    assert one == same != other
    assert sum(c for d, c in one if d < 10_000) == pytest.approx(14_000, rel=0.02)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    assert mixing.plan_mix(none, spark.createDataFrame([("a", 1.0, None)], TARGET)).collect()[0].tokens == 0
    assert mixing.plan_mix(none, spark.createDataFrame([], TARGET)).count() == 0


def test_tokens(spark, rows):
    texts = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 100_000), (5, "<|endoftext|>")], "i int, t string")
    got = {r.i: r.n for r in texts.select("i", mixing.token_count(F.col("t")).alias("n")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000 and got[5] > 1
