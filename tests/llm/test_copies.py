import random
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mediasift.llm import copies

COPIES = {"fields": ["kind", "label"], "split": {"value": r"[;|/]"}}


def norm(x):
    return "".join(str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else c for c in (x or "").lower() if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


def brute(data):
    groups = defaultdict(list)
    for i, kind, label, value in data:
        parts = sorted(p for p in map(norm, re.split("[;|/]", value or "")) if p)
        if parts and i is not None:
            groups[norm(kind), norm(label), tuple(parts)].append(i)
    return sorted((min(g), i) for g in groups.values() for i in set(g) if i != min(g))


DATA = [
    (5, "phone", "Home", "+1 (555) 010"), (1, "phone", "home:", "+1555-010"), (9, "Phone", "_$!<HOME>!$_", "+१५५५०१०"), (2, "phone", None, "1;2"), (3, "phone", "", "2 / 1"), (4, "phone", "-", "2|1|"), (6, "phone", "home", "1;1;2"), (7, "phone", "home", "1;2;2"),
    (8, "phone", "home", "12"), (10, "email", "home", "+1555010"), (11, "phone", "home", "--"), (12, "phone", "home", None), (13, "phone", "home", ""), (14, None, None, "1;2"), (15, "phone", None, "1;2"), (16, "phone", "home", "2;1;1"), (None, "phone", "home", "12"),
]


@pytest.mark.parametrize("bits", [61, 3, 1])
def test_same_as_sorting_also_when_hashes_collide(spark, rows, bits):
    rng = random.Random(1)
    more = [(100 + i, "phone", rng.choice(["a", "A ", "b", None]), "; ".join(rng.choice(["1", "2", "x", ""]) for _ in range(rng.randint(0, 4)))) for i in range(120)]
    df = spark.createDataFrame(DATA + more, "value_id bigint, kind string, label string, value string").withColumn("first_id", F.lit(1)).withColumn("pairs", F.lit("clash"))
    assert rows(copies.link_copies(df, "value_id", hash_bits=bits, **COPIES), "first_id", "id") == sorted(brute(DATA + more), key=str)


def test_records_and_counts(spark, rows):
    df = spark.createDataFrame(DATA, "value_id bigint, kind string, label string, value string")
    got = dict(rows(copies.collapse_copies(df, "value_id", **COPIES)))
    links = brute(DATA)
    assert sum(got.values()) == sum(1 for i, _, _, v in DATA if i is not None and any(map(norm, v or "")))
    assert all(got[f] == 1 + sum(1 for a, _ in links if a == f) for f in got)


def test_hot_value_repeated_rows_and_long_texts(spark, rows):
    hot = spark.range(3000).select(F.col("id").alias("value_id"), F.lit("phone").alias("kind"), F.lit("x").alias("label"), F.when(F.col("id") % 2 == 0, F.lit("a;b")).otherwise(F.lit("B / A.")).alias("value"))
    long = spark.createDataFrame([(9001, "k", "l", "word;" * 30_000), (9002, "k", "l", ";".join(["WORD"] * 30_000))], hot.schema)
    got = copies.link_copies(hot.unionByName(hot).unionByName(long), "value_id", **COPIES)
    assert got.count() == 2999 + 1 and rows(got.select("first_id").distinct()) == [(0,), (9001,)]


def test_empty(spark):
    assert copies.link_copies(spark.createDataFrame([], "value_id bigint, kind string, label string, value string"), "value_id", **COPIES).count() == 0
