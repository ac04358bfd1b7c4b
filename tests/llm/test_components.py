import random

from pyspark.sql import functions as F

from mediasift.llm import components
from mediasift.llm.components import group_pairs, link_contacts
from mediasift.scratch import Scratch


def union_find(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return sorted((x, root(x)) for x in up)


def test_random_graph_chain_star_and_ties(spark, rows):
    rng = random.Random(3)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    rng.shuffle(chain)
    star = [("s-hub", f"s{i}") for i in range(80)]
    loose = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)]
    pairs = chain + star + loose + loose[:10] + [(b, a) for a, b in chain[:7]] + [("self", "self")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("u", F.lit(1)).withColumn("n", F.lit("clash"))
    assert rows(group_pairs(df), "id", "group_id") == union_find(pairs)


def test_nulls_and_empty(spark, rows):
    df = spark.createDataFrame([(None, "x"), ("y", None), (None, None), ("p", "q")], "a string, b string")
    assert rows(group_pairs(df), "id", "group_id") == [("p", "p"), ("q", "p")]
    assert group_pairs(df.where("a = 'none'")).count() == 0


def test_number_identifiers(spark, rows):
    df = spark.createDataFrame([(10, 9), (9, 100)], "a bigint, b bigint")
    assert set(rows(group_pairs(df), "id", "group_id")) == {(9, 9), (10, 9), (100, 9)}


def test_contacts_are_compared_without_case_and_blanks(spark, rows):
    matches = spark.createDataFrame([(" b-1", "A-1 "), ("B-1", "c-1"), ("  ", "z"), ("A-1", "a-1")], "a string, b string")
    contacts = spark.createDataFrame([("A-1",), ("b-1",), ("C-1",), ("C-1",), (None,)], "id string")
    assert rows(link_contacts(matches, contacts), "group_id", "id") == [("A-1", "C-1"), ("A-1", "b-1")]


def test_plans_stay_small_over_many_rounds(spark, rows, monkeypatch):
    """Twenty levels of a forest: no written plan has more joins than any other."""
    joins = []
    scratch = Scratch(spark, "levels")
    write = scratch.write

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return write(df)

    monkeypatch.setattr(scratch, "write", counted)
    forest = [spark.createDataFrame([(r * 10 + i, (r + 1) * 10 + i % 3) for i in range(3)], "u int, parent int") for r in range(20)]
    labels = components._flow_down(forest, scratch)
    assert rows(labels) == sorted([(r * 10 + i, 200 + i) for r in range(20) for i in range(3)], key=str)
    assert len(joins) == 20 and max(joins) <= 3
    assert labels._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_long_path_and_large_star(spark):
    n = 100_000
    path = spark.range(n - 1).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    groups = group_pairs(path)
    least = spark.range(n).agg(F.min(F.xxhash64("id"))).first()[0]
    assert groups.agg(F.count("*"), F.min("group_id"), F.max("group_id")).first() == (n, least, least)
    star = spark.range(1, 1_000_001).select(F.lit(500_000).cast("bigint").alias("a"), F.col("id").alias("b"))
    assert group_pairs(star).agg(F.count("*"), F.min("group_id"), F.max("group_id")).first() == (1_000_000, 1, 1)
