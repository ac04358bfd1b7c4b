import random

import pytest
from pyspark.sql import functions as F

from mediasift.llm import hamming


def patterns(n, seed=5):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 3)]
    more = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 9))) for b in base for _ in range(2)]
    return [hamming.signed(x) for x in base + more]


def brute(rows, d=6):
    return sorted({(min(a, b), max(a, b)) for a, x in rows for b, y in rows if a != b and ((x ^ y) & (2**64 - 1)).bit_count() <= d})


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_all_pairs_also_in_crowded_buckets(spark, rows, bucket_rows):
    bits = patterns(300)
    expected = sorted({(min(x, y), max(x, y)) for x in bits for y in bits if x != y and ((x ^ y) & (2**64 - 1)).bit_count() <= 6}, key=str)
    df = spark.createDataFrame([(b,) for b in [*bits, *bits[:20], None]], "bits bigint")
    assert rows(hamming.near_patterns(df, bucket_rows=bucket_rows)) == expected


@pytest.mark.parametrize("d", [0, 2, 6])
def test_other_distances(spark, rows, d):
    bits = patterns(60, 9)
    expected = sorted({(min(x, y), max(x, y)) for x in bits for y in bits if x != y and ((x ^ y) & (2**64 - 1)).bit_count() <= d}, key=str)
    assert rows(hamming.near_patterns(spark.createDataFrame([(b,) for b in bits], "bits bigint"), d)) == expected


def test_assets_nulls_copies_and_clashes(spark, rows):
    data = [(f"a{i % 50}", b) for i, b in enumerate(patterns(90, 2))] + [("same1", 0), ("same2", 0), ("same2", 0), ("neg", -1), ("top", 2**63 - 1), (None, 0), ("nul", None)]
    df = spark.createDataFrame(data, "asset_id string, bits bigint").withColumn("x", F.lit(1)).withColumn("key", F.lit(2))
    assert rows(hamming.near_assets(df)) == sorted(brute([(a, b) for a, b in data if a and b is not None]), key=str)
    links = {r[1]: r[2] for r in rows(hamming.near_classes(df))}
    assert links[0] == sum(1 for b in {b for _, b in data if b is not None} if b != 0 and (b & (2**64 - 1)).bit_count() <= 6)


def test_empty(spark):
    assert hamming.near_assets(spark.createDataFrame([], "asset_id string, bits bigint")).count() == 0


def test_fragments_cover_all_positions():
    order = hamming.global_order([i * 3 % 50 for i in range(64)], 50)
    for k in range(7, 11):
        masks = hamming.cut_order(order, k)
        assert sum(masks) == 2**64 - 1 and all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])


def test_keys_of_more_fragments_for_larger_collections():
    agree = [hamming.agree_for(n, 6) for n in (1, 10**5, 10**7, 10**9)]
    assert agree == sorted(agree) and agree[0] == 1 and agree[-1] > 2


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_a_hot_bucket_is_cut_again_and_again(spark, rows, agree, monkeypatch):
    """A third of all patterns agree in 40 positions: several levels, all pairs."""
    monkeypatch.setattr(hamming, "agree_for", lambda n, d: agree)
    rng = random.Random(1)
    bits = patterns(200, 3) + [hamming.signed(0xFFFFFFFFFF | rng.getrandbits(24) << 40) for _ in range(150)]
    expected = sorted({(min(x, y), max(x, y)) for x in bits for y in bits if x != y and ((x ^ y) & (2**64 - 1)).bit_count() <= 6}, key=str)
    assert rows(hamming.near_patterns(spark.createDataFrame([(b,) for b in bits], "bits bigint"), bucket_rows=10)) == expected


def jaccard_pairs(sets, t):
    return sorted(((a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and len(x & y) >= t * len(x | y) - 1e-9), key=str)


@pytest.mark.parametrize("t", [0.5, 0.8, 1.0])
def test_ngram_sets_against_brute_force(spark, rows, t):
    rng = random.Random(8)
    sets = {}
    for i in range(60):
        base = {f"t{int(rng.paretovariate(0.4)) % 300}" for _ in range(rng.randint(1, 40))}
        sets[i] = base
        sets[i + 100] = {x for x in base if rng.random() > 0.1} | {f"n{rng.randrange(400)}" for _ in range(rng.randint(0, 3))}
    df = spark.createDataFrame([(k, [*v, *list(v)[:2]]) for k, v in sets.items()] + [(None, ["t1"]), (999, []), (998, None)], "rec int, tokens array<string>").withColumn("size", F.lit(1)).withColumn("df", F.lit(1))
    got = rows(hamming.near_sets(df, t, fragments=4))
    assert sorted(((r[0], r[1]) for r in got), key=str) == jaccard_pairs(sets, t)
    assert all(r[2] == len(sets[r[0]] & sets[r[1]]) for r in got)


def test_texts(spark, rows):
    long = [f"w{i}" for i in range(80)]
    edited = [*long[:40], "new", *long[40:]]
    docs = [(1, " ".join(long)), (2, " ".join(long).upper() + "!"), (3, " ".join(edited)), (4, "alone"), (5, "Alone."), (6, ""), (7, None), (None, "alone"), (4, "alone")]
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("key", F.lit(1)).withColumn("class_id", F.lit(2))
    assert rows(hamming.near_texts(df)) == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 0), (5, 4, 0)]
    assert hamming.near_texts(df.where("doc_id > 99")).count() == 0
