import random
from datetime import datetime, timedelta

import pytest

from mediasift.operators import bucketing as B
from mediasift.operators import similarity as M
from mediasift.scratch import Scratch
from mediasift.sources.readers import ASSET

START = datetime(2023, 11, 14)


def asset(i, seconds, w=4032, h=3024, kind="image", **more):
    row = {"id": i, "media_type": kind, "subtype_mask": 0, "width": w, "height": h, "created": None if seconds is None else START + timedelta(seconds=seconds), "modified": None, "duration": 0.0, "is_favorite": False, "is_hidden": False, "source_mask": 1, "has_adjustments": False, "represents_burst": False, "burst_id": None, "size_bytes": None}
    row.update(more)
    return tuple(row[f.name] for f in ASSET)


def split(spark, offsets, cap, gap=100_000.0):
    from mediasift.config import Bucketing

    df = spark.createDataFrame([asset(f"r{i:02}", s) for i, s in enumerate(offsets)], ASSET)
    got = B.buckets(df, Scratch(spark, "t"), Bucketing(max_gap_s=gap, max_bucket=cap)).select("bucket_id", "id", "ord").collect()
    out = {}
    for r in sorted(got, key=lambda r: r.ord):
        out.setdefault(r.bucket_id, []).append(r.id)
    return list(out.values())


def test_widest_gap_is_cut(spark):
    got = split(spark, [0, 1, 2, 3, 4, 5, 1006, 1007, 1008, 1009], 4)
    assert [len(g) for g in got] == [4, 2, 4] and not any("r05" in g and "r06" in g for g in got)


def test_identical_times_split_and_stay_complete(spark):
    got = split(spark, [7] * 10, 4)
    assert [len(g) for g in got] == [4, 3, 3] and sum(got, []) == [f"r{i:02}" for i in range(10)]


def test_gap_is_strict_and_null_dates_are_oldest(spark):
    df = spark.createDataFrame([asset("a", 0), asset("b", 600), asset("c", 1201), asset("n1", None), asset("n2", None), asset("n1", None)], ASSET)
    rows = B.chains(df.dropDuplicates(["id"]).selectExpr("*", "1 AS k"), ["k"], Scratch(spark, "t")).select("id", "chain", "ord").collect()
    assert {r.id: (r.chain, r.ord) for r in rows} == {"n1": (0, 0), "n2": (0, 1), "a": (1, 2), "b": (1, 3), "c": (2, 4)}


def sequential(times, cap, gap):
    """Chains and pieces by walking through the sorted rows."""
    rows = sorted(times, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    chains, last = [], None
    for i, t in rows:
        if last is None or (last[1] is None) != (t is None) or (t is not None and t - last[1] > gap):
            chains.append([])
        chains[-1].append((i, t or 0))
        last = (i, t)
    out = []
    for c in chains:
        while len(c) > cap:
            low, high = (1, cap) if len(c) > 2 * cap else (len(c) - cap, cap)
            gaps = {k: c[k][1] - c[k - 1][1] for k in range(low, high + 1)}
            widest = max(gaps.values())
            at = min((k for k in gaps if gaps[k] == widest), key=lambda k: (abs(k - len(c) // 2), k)) if widest > 0 else min(max(len(c) // 2, low), high)
            out.append([i for i, _ in c[:at]])
            c = c[at:]
        out.append([i for i, _ in c])
    return sorted(sorted(p) for p in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_as_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    times = [(f"i{k:03}", rng.choice([None, *[rng.randrange(3000) for _ in range(8)]])) for k in range(250)]
    df = spark.createDataFrame([asset(i, t) for i, t in times], ASSET)
    from mediasift.config import Bucketing

    got = {}
    for r in B.buckets(df, Scratch(spark, "t"), Bucketing(max_gap_s=15, max_bucket=5)).select("bucket_id", "id").collect():
        got.setdefault(r.bucket_id, []).append(r.id)
    assert sorted(sorted(g) for g in got.values()) == sequential(times, 5, 15)


def test_invalid_and_empty(spark):
    df = spark.createDataFrame([asset("a", 0, w=0), asset("b", 0, kind="audio"), asset("v", 0, kind="video", w=0), asset(None, 0)], ASSET)
    assert [r.id for r in B.buckets(df, Scratch(spark, "t")).collect()] == ["v"]
    assert B.buckets(df.where("id = 'none'"), Scratch(spark, "t")).count() == 0


def test_pair_bound(spark):
    df = spark.createDataFrame([asset(f"p{i:04}", 12 * i) for i in range(3000)], ASSET)
    r = B.pair_bound(B.buckets(df, Scratch(spark, "t"))).first()
    assert r.largest <= 64 and r.pairs <= 3000 * 64 and r.pairs < 0.05 * r.all_pairs


def groups(spark, relations):
    df = spark.createDataFrame([("k", a, b, d) for a, b, d in relations], "bucket_id string, a string, b string, distance double")
    return sorted((r.member_ids, r.min_distance, r.max_distance) for r in M.link_groups(df).collect())


def test_complete_linkage(spark):
    assert groups(spark, [("a", "b", 0.1), ("b", "c", 0.1)]) == [(["a", "b"], 0.1, 0.1)]
    assert groups(spark, [("a", "b", 0.1), ("b", "c", 0.12), ("a", "c", 0.15)]) == [(["a", "b", "c"], 0.1, 0.15)]
    assert groups(spark, [("m", "n", 0.09), ("a", "b", 0.05)]) == [(["a", "b"], 0.05, 0.05), (["m", "n"], 0.09, 0.09)]


def test_best_photo_order(spark):
    from mediasift.operators.catalog import best_of

    def best(*rows):
        return best_of(spark.createDataFrame(list(rows), ASSET).selectExpr("*", "1 AS g"), ["g"]).first().best_id

    assert best(asset("a", 0), asset("b", 0, w=1, is_favorite=True)) == "b"
    assert best(asset("a", 0, represents_burst=True), asset("b", 0, w=10)) == "b"
    assert best(asset("a", 0, w=10), asset("b", 0)) == "b"
    assert best(asset("a", 0), asset("b", 0, has_adjustments=True)) == "b"
    assert best(asset("a", None), asset("b", -9)) == "b" and best(asset("b", 5), asset("a", 5)) == "a"
