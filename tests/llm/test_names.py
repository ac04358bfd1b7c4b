import random

import pytest
from pyspark.sql import functions as F

from mediasift.llm import names
from mediasift.scratch import Scratch

CONTACT = "id string, given string, family string, organization string"


def groups(spark, data):
    out = {}
    for r in names.link_names(spark.createDataFrame(data, CONTACT).withColumn("token", F.lit("clash")).withColumn("org", F.lit(1))).collect():
        out.setdefault(r.group_id, set()).add(r.id)
    return sorted(sorted(g) for g in out.values())


def filler(n):
    """Organisations that share their generic words, so that these can be told from names."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5))
    return [(f"x{i:03}", None, None, f"{word().title()} {rng.choice(['Logistics', 'Services'])} {rng.choice(['Ltd', 'GmbH'])}") for i in range(n)]


def test_variants_meet_and_others_do_not(spark):
    data = [
        ("a1", "Patricia", "Zetipelis", "Drabudo Logistics Ltd"), ("a2", "Pat", "Zetipelsi", "DRABUDO LOGISTICS"), ("a3", "Zetipelis, Patricia M.", "", "Logistics, Drabudo"), ("a4", "P.", "Zetipelis ", None), ("a5", "Ms Patricia", "Zetipelis-Brooke", "Drabudo"), ("a6", None, None, "Dr. Patricia Zetipelis"),
        ("b1", "Patricia", "Zetipelis", "Kolomar Services"), ("c1", "Robert", "Zetipelis", "Drabudo Logistics Ltd"),
        ("o1", "", None, "Fugomar Logistics GmbH"), ("o2", None, "fugomar svcs", ""), ("o3", "unknown", "-", "The Fugomar  Logistics"), ("n1", None, None, None), ("n2", "?", " ", "N/A"), (None, "Patricia", "Zetipelis", None), ("a1", "Patricia", "Zetipelis", "Drabudo Logistics Ltd"),
    ]
    got = groups(spark, data + filler(60))
    assert ["a1", "a2", "a3", "a5"] == [x for x in next(g for g in got if "a1" in g) if x not in ("a4", "a6")]
    assert ["b1"] == [x for x in next(g for g in got if "b1" in g) if x not in ("a4", "a6")]
    assert ["c1"] in got and ["o1", "o3"] == [x for x in next(g for g in got if "o1" in g) if x != "o2"]
    assert not any("n1" in g or "n2" in g or None in g for g in got)


def test_common_names_are_told_apart_by_organisation(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)).title()
    data = [(f"h{i:03}{k}", "Elisabeth" if k == 0 else "E.", "Halden", org) for i in range(90) for org in [f"{word()} Services Ltd"] for k in range(2)]
    got = groups(spark, data)
    assert [g for g in got] == sorted([f"h{i:03}0", f"h{i:03}1"] for i in range(90))


def test_empty_and_long(spark):
    assert groups(spark, []) == []
    assert groups(spark, [("a", "x" * 20_000, "y", None), ("b", None, "z " * 5_000, None)]) is not None


def test_pairs_leave_group_members_out(spark, rows):
    c = spark.createDataFrame([("a", "Ina", "Vogelsang", None), ("b", "INA", "VOGELSANG", ""), ("c", "Ina", "Vogelsang", None), ("a", "Ina", "Vogelsang", None)], CONTACT)
    g = spark.createDataFrame([("g", ["c", None])], "group_id string, member_ids array<string>")
    assert rows(names.name_pairs(c, g)) == [("a", "b")]


def test_banding_reaches_its_recall(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(11)) for _ in range(400)]
    typos = [w[:i] + rng.choice("qrstuvwxyz") + w[i + 1 :] for w in base for i in [rng.randrange(11)]]
    met = {tuple(r) for r in names.similar_tokens(spark.createDataFrame([(w,) for w in sorted(set(base + typos))], "token string"), Scratch(spark, "t")).collect()}
    assert sum((a, b) in met and (b, a) in met for a, b in zip(base, typos, strict=True)) / 400 >= 0.95


@pytest.mark.parametrize(("s", "rows_", "recall"), [(0.5, 4, 0.95), (0.8, 5, 0.99)])
def test_collision_curve(s, rows_, recall):
    b = names.bands_for(s, rows_, recall)
    assert 1 - (1 - s**rows_) ** b >= recall > 1 - (1 - s**rows_) ** (b - 1)


def test_edits_and_partners():
    assert [names.edits("vabao", "vaabo", 2), names.edits("abc", "abcd", 1), names.edits("kitten", "sitting", 2), names.edits("", "ab", 2)] == [1, 1, 3, 2]
    assert names.token_similarity("theodora", "teddy") > 0 and names.token_similarity("b", "bonea") > 0 and names.token_similarity("bonea", "krugan") == 0


def test_stars_equal_the_sequential_rule(spark, rows):
    rng = random.Random(6)
    edges = {(a, b): rng.random() for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.06}
    rank = {v: rng.random() for v in range(40)}
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in rank}
    covered, centres = set(), set()
    for v in sorted(rank, key=rank.get, reverse=True):
        if v not in covered:
            centres.add(v)
            covered |= near[v] | {v}
    vs = spark.createDataFrame(list(rank.items()), "v bigint, rank double")
    es = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a bigint, b bigint, similarity double")
    got = dict(rows(names.star_clusters(vs, es, Scratch(spark, "t"))))
    weight = lambda a, b: edges.get((a, b), edges.get((b, a)))
    assert got == {v: v if v in centres else max(near[v] & centres, key=lambda c: (weight(v, c), rank[c])) for v in rank}
