"""Vectors are compared with all vectors of their label, however many there are."""

from itertools import combinations

import pytest

from mediasift import queries as Q
from mediasift.operators import similarity as M


def test_block_pairs_are_all_pairs(spark, rows):
    labels = {i: None if i == 99 else "hot" if i % 10 else "cold" for i in range(100)}
    df = spark.createDataFrame([(i, x, [float(i)]) for i, x in labels.items()], "id bigint, bucket_id string, v array<float>")
    want = sorted(((x, a, b, [float(a)], [float(b)]) for a, b in combinations(range(99), 2) if (x := labels[a]) == labels[b]), key=str)
    for block in (7, 1000):
        assert rows(M.block_pairs(df, ["v"], block=block), "bucket_id", "a", "b", "v_a", "v_b") == want


@pytest.fixture
def folder(spark, tmp_path):
    data = [(5, 1, [0.0, 0.0]), (700, 1, [1.0, 0.0]), (1400, 1, [0.0, 1.25]), (6, 2, [0.0, 0.0]), (7, None, [0.0, 0.0]), (8, None, [0.0, 0.0])]
    spark.createDataFrame(data, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_far_ids_of_a_label_meet(spark, rows, folder):
    got = lambda name, *c: rows(Q.queries()[name](spark, folder), *c)
    assert got("mth_02", "a", "b", "distance") == [(5, 1400, 1.25), (5, 700, 1.0), (700, 1400, 1.600781)]
    assert got("joi_12", "bucket_id", "a", "b") == [("1", 5, 700)]
    assert got("flt_13", "a", "b") == [(5, 1400), (5, 700)]
    assert got("agg_13", "bucket_id", "min_distance", "max_distance") == [("1", 1.0, 1.0)]
