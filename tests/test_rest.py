import random
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.config import Sharpness
from mediasift.operators import catalog as C
from mediasift.operators import identity as I
from mediasift.operators import progress as P
from mediasift.operators import selection as S
from mediasift.operators import sharpness as K
from mediasift.operators import similarity as M
from mediasift.scratch import Scratch
from mediasift.skew import join_on_hot_key
from mediasift.sources import sinks
from mediasift.streaming.evidence import EvidenceStream, accept_newer, reconcile


def test_rate_and_time_left(spark):
    def last(samples):
        rate = P.Rate()
        for s in samples:
            rate.add(*s)
        return rate

    steady = last([("s", 100 * i // 10, i * 0.1) for i in range(31)])
    assert steady.samples >= 2 and steady.rate == pytest.approx(100, rel=0.05)
    assert last([("s", 100, 1), ("s", 200, 2), ("s", 1100, 3)]).rate == pytest.approx(0.35 * 900 + 0.65 * 100)
    assert last([("s", 0, 0), ("s", 9, 2), ("t", 0, 3)]).rate is None
    df = spark.createDataFrame([(1, "s", c, 10_000, float(t)) for t, c in enumerate([0, 100, 200, 1100])] + [(2, "s", 0, 0, 0.0), (None, "s", 1, 1, 1.0)], "run int, stage string, completed int, total int, elapsed double")
    state, seconds = P.estimate()
    assert {r[0]: (r[1], r[2]) for r in P.rates(df).select("run", state, seconds).collect()} == {1: ("remaining", 23), 2: ("indeterminate", None)}


def test_verdict_gates(spark):
    c = Sharpness()
    rows = [(c.sharp, 0.0, 0.5, 0.5), (c.blurry_laplacian, c.blurry_tenengrad, 0.5, 0.5), (np.nextafter(c.blurry_laplacian, 1), 0.0, 0.5, 0.5), (1.0, 1.0, np.nextafter(c.dark, 0), 0.5), (1.0, 1.0, c.dark, c.flat), (1.0, 1.0, 0.5, np.nextafter(c.flat, 0)), (None, None, None, None)]
    df = spark.createDataFrame([(i, *(None if x is None else float(x) for x in r)) for i, r in enumerate(rows)], "i int, laplacian double, tenengrad double, luma_mean double, luma_std double")
    assert [r[0] for r in df.orderBy("i").select(K.verdict()).collect()] == ["sharp", "likelyBlurry", "borderline", "insufficientInformation", "sharp", "insufficientInformation", "insufficientInformation"]


def test_measures_of_known_grids(spark):
    flat, checker = np.full((32, 32), 0.5), np.indices((32, 32)).sum(axis=0) % 2
    assert K.measure(flat)[:4] == (0, 0, 0, 0) and K.measure(flat)[4] == 0.5
    assert K.measure(checker)[0] > 1 and K.measure(np.tile(np.linspace(0, 1, 32), (32, 1)))[0] < 1e-3
    df = spark.createDataFrame([(1, [0.5] * 1024), (2, [0.5]), (3, None)], "id int, luma array<float>")
    assert [r.luma_mean for r in K.sharpness(df, 32).orderBy("id").collect()] == [0.5, None, None]


def test_difference_hash_layout(spark):
    grays = [[float(c) for _ in range(8) for c in range(9)], [float(-c) for _ in range(8) for c in range(9)], [0.0, 1.0] + [0.0] * 70, [1.0]]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grays)], "i int, g array<double>")
    assert [r[0] for r in df.orderBy("i").select(K.difference_hash(F.col("g"))).collect()] == [-1, 0, 1, None]
    d = K.grid_descriptor(np.random.default_rng(1).random(768))
    assert len(d) == 771 and np.linalg.norm(d) == pytest.approx(1, abs=1e-5)


def test_freed_space_and_unknown_sizes(spark, rows):
    plan = spark.createDataFrame([("a", "video", 10, "exact"), ("b", "image", None, "near"), ("b", "image", None, "near"), ("c", "image", 5, None), ("d", "image", 7, "exact")], "id string, media_type string, size_bytes bigint, category string")
    left = spark.createDataFrame([("d",), ("z",)], "id string")
    r = S.freed(plan, left).first().asDict()
    assert r == {"confirmed": 3, "measured_bytes": 15, "measured": 2, "unresolved": 1, "not_removed": 1, "videos": 1, "exact": 0, "similar": 1, "photos": 1}
    assert S.freed(plan, plan.select("id")).count() == 0


def test_protected_everywhere_and_toggled(spark, rows):
    m = spark.createDataFrame([("g1", "exact", "a", "a"), ("g1", "exact", "b", "a"), ("g2", "near", "b", "b"), ("g2", "near", "c", "b")], "group_id string, kind string, id string, best_id string")
    assert rows(S.default_selection(m)) == [("c",)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(S.toggled(ids("a", "b"), ids("b", "c", None))) == [("a",), ("c",)]
    assert rows(S.group_states(m, ids("c"))) == [("g1", 0, 2, "none"), ("g2", 1, 2, "some")]


def test_snapshots_replace_and_mismatch_reads_as_none(spark, rows):
    folder = sinks.scratch_folder(spark, "t")
    store = sinks.SnapshotStore(spark, folder, 1)
    assert store.load_latest() is None
    store.save(spark.range(3))
    store.save(store.load_latest().where("id > 0"))
    assert rows(store.load_latest()) == [(1,), (2,)] and sinks.SnapshotStore(spark, folder, 2).load_latest() is None
    reader = store.load_latest()
    store.save(spark.range(5))
    assert reader.count() == 2 and store.load_latest().count() == 5  # a reader of the former snapshot goes on
    broken = Path(store.folder.removeprefix("file://")) / "marker-000000000009.json"
    broken.write_text("{")
    assert store.load_latest().count() == 5
    store.save(spark.range(6))
    assert store.load_latest().count() == 6 and store._markers()[0][0] == 10
    store.clear()
    assert store.load_latest() is None


def test_appended_parts_are_folded_as_they_grow(spark, rows):
    store = sinks.SnapshotStore(spark, sinks.scratch_folder(spark, "t"), 1)
    fold = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
    expected, written = {}, 0
    for i in range(24):
        part = [(k, i) for k in range(i * 10, i * 10 + 12)]
        expected |= dict(part)
        store.append(spark.createDataFrame(part, "k int, v int"), fold)
        written += sum(p["rows"] for p in store._parts()[-1:])
    assert rows(fold(store.load_latest())) == sorted(expected.items(), key=str)
    assert len(store._parts()) <= 6 and written < 12 * 24 * 6


def test_review_log_as_a_stack(spark, rows):
    rng = random.Random(4)
    log, expected = [], []
    for user in range(8):
        stack = []
        for n in range(60):
            decision = None if rng.random() < 0.4 else rng.choice(["keep", "delete"])
            item = f"i{rng.randrange(9)}"
            log.append((user, item, n, decision))
            if decision:
                stack.append((item, decision))
            elif stack:
                stack.pop()
        expected += [(user, i, d) for i, d in dict(stack).items()]
    df = spark.createDataFrame([*log, (None, "i", 1, "keep")], "user int, item string, n int, decision string")
    assert rows(P.review_log(df, ["user"], "item", ["n"], "decision")) == sorted(expected, key=str)


def test_numbers_and_chunks(spark, rows):
    df = spark.range(1300).select((F.col("id") * 7919 % 1300).alias("v"))
    got = C.numbered(df, [F.desc("v")], Scratch(spark, "t"))
    assert got.where("number <> 1299 - v").isEmpty() and got.count() == 1300
    assert rows(C.chunks(df, [F.asc("v")], Scratch(spark, "t"), 512)) == [(0, 512, 512, 1300), (1, 512, 1024, 1300), (2, 276, 1300, 1300)]
    assert C.chunks(df.where("v < 0"), [F.asc("v")], Scratch(spark, "t")).count() == 0


def test_near_pairs_need_descriptors_of_one_kind(spark, rows):
    data = [("vision", "vision", [0.0, 0.19]), ("vision", "vision", [0.0, 0.21]), ("cpuGrid", "cpuGrid", [0.0, 0.16]), ("cpuGrid", "cpuGrid", [0.1, 0.1]), ("vision", "cpuGrid", [0.0, 0.0]), ("vision", "vision", []), (None, "vision", [0.0, 0.0])]
    df = spark.createDataFrame([(i, a, b, [0.0, 0.0], v) for i, (a, b, v) in enumerate(data)], "i int, kind_a string, kind_b string, vector_a array<double>, vector_b array<double>")
    assert [r.i for r in df.where(M.near_enough().isNotNull()).collect()] == [0, 3]
    content = spark.createDataFrame([("a", b"xy"), ("b", b"xy"), ("c", b"xz"), ("d", b"xyz"), ("e", None)], "id string, content binary")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "gone")], "a string, b string")
    assert rows(M.confirmed_copies(pairs, content), "a", "b") == [("a", "b")]


def test_stream_resumes_and_ignores_other_runs(spark, rows):
    root = sinks.scratch_folder(spark, "t")
    schema = "id string, modified timestamp_ntz, bits bigint, run_id int"
    old, new = datetime(2024, 1, 1), datetime(2024, 1, 2)
    put = lambda data: spark.createDataFrame(data, schema).write.mode("append").parquet(f"{root}/in")
    put([("a", old, 1, 5), ("b", None, 2, 5), ("c", old, 3, 4)])
    run = EvidenceStream(spark, f"{root}/in", f"{root}/out", f"{root}/cp", spark.createDataFrame([], schema).schema, run_id=5)
    assert rows(run.run(), "id", "bits") == [("a", 1), ("b", 2)]
    put([("a", new, 9, 5), ("b", old, 7, 5), ("b", None, 8, 5)])
    assert rows(run.run(), "id", "bits") == [("a", 9), ("b", 7)]


def test_evidence_rules(spark, rows):
    e = spark.createDataFrame([("a", None, 1), ("a", datetime(2024, 1, 1), 2), ("b", datetime(2024, 1, 1), 3), (None, None, 4)], "id string, modified timestamp_ntz, bits int")
    live = spark.createDataFrame([("a", None), ("b", datetime(2024, 1, 2))], "id string, modified timestamp_ntz")
    assert rows(reconcile(e, live), "bits") == [(1,)]
    now = spark.createDataFrame([("k", 5, "x")], "kind string, seq int, body string")
    offered = spark.createDataFrame([("k", 4, "old"), ("n", 2, "no"), ("n", 3, "yes")], now.schema)
    assert rows(accept_newer(now, offered, ["kind"], ["seq"], blocked=2)) == [("k", 5, "x"), ("n", 3, "yes")]


def test_hot_keys_are_salted_without_loss(spark):
    rows_ = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id")
    unique = rows_.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = join_on_hot_key(rows_, unique, ["k"], "n", 5000, "id", salts=8, least=100)
    assert got.count() == 5000 and got.where("k = 1").select("least").distinct().count() == 1


def test_queries_have_callables_and_sql_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 155


def test_aspect_fill_and_sharpness_at_full_size(spark):
    rng = np.random.default_rng(3)
    image = rng.random((6, 10), dtype=np.float32)
    shrunk = K.aspect_fill(image, 3)  # boxes of two by two from the middle six columns
    assert shrunk == pytest.approx(image[:, 2:8].reshape(3, 2, 3, 2).mean(axis=(1, 3)), abs=1e-6)
    assert K.aspect_fill(image, 6) == pytest.approx(image[:, 2:8], abs=1e-6)
    assert K.aspect_fill(np.full((2, 3), 0.4), 256) == pytest.approx(np.full((256, 256), 0.4), abs=1e-6)
    marked = np.zeros((4, 4), dtype=np.float32)
    marked[0, 0] = 1
    corners = {o: tuple(int(x) for x in np.argwhere(K.aspect_fill(marked, 4, o) > 0.5)[0]) for o in range(1, 9)}
    assert corners == {1: (0, 0), 2: (0, 3), 3: (3, 3), 4: (3, 0), 5: (0, 0), 6: (0, 3), 7: (3, 3), 8: (3, 0)}
    checks = (np.indices((300, 400)).sum(axis=0) // 4 % 2).astype(float)
    rows = [("sharp", checks.ravel().tolist(), 400, 300, 1), ("flat", [0.5] * 120, 12, 10, None), ("short", [0.5] * 7, 3, 3, 1), ("turned", [0.5] * 9, 3, 3, 11), ("none", None, 3, 3, 1)]
    df = spark.createDataFrame(rows, "id string, luma array<double>, width int, height int, orientation int")
    made = K.thumbnails(df)
    assert {r.id: r.reason for r in made.collect()} == {"sharp": None, "flat": None, "short": "thumbnailFailed", "turned": "thumbnailFailed", "none": "imageUnavailable"}
    verdicts = {r.id: r.v for r in K.sharpness(made).select("id", K.verdict().alias("v")).collect()}
    assert verdicts["sharp"] == "sharp" and verdicts["flat"] == verdicts["none"] == "insufficientInformation"


def test_merges_are_verified(spark, rows):
    contact = "id string, given string, family string, organization string, phones array<struct<label string, value string, normalized string>>, emails array<struct<label string, value string, normalized string>>"
    v = lambda *xs: [("x", x, None) for x in xs]
    people = [(i, "Ann", None, None, v(f"555000{i}"), v(f"{i}@x")) for i in "1234567"]
    reviewed = spark.createDataFrame(people, contact)
    groups = spark.createDataFrame([("ok", ["1", "2"]), ("changed", ["3", "4"]), ("lost", ["5", "6"]), ("alone", ["7"])], "group_id string, member_ids array<string>")
    plans = I.merge_plan(reviewed, groups)
    live = spark.createDataFrame([p if p[0] != "4" else (*p[:1], "Bea", *p[2:]) for p in people], contact)
    after = I.apply_merges(live, plans.where("group_id IN ('ok', 'lost')"))
    assert [x.value for x in after.where("id = '1'").first().phones] == ["5550001", "5550002"]
    spoilt = after.withColumn("emails", F.when(F.col("id") == "5", F.array().cast(after.schema["emails"].dataType)).otherwise(F.col("emails")))
    got = {r.group_id: (r.outcome, r.planned, r.removed) for r in I.merge_outcomes(plans, reviewed, live, spoilt).collect()}
    assert got == {"ok": ("succeeded", 1, 1), "changed": ("stale", 1, 0), "lost": ("verificationFailed", 1, 0), "alone": ("invalidMerge", 0, 0)}
