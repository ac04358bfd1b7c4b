import math
import random
from collections import Counter
from datetime import datetime

import pytest

from mediasift.llm import survivors
from mediasift.scratch import Scratch

CONTACT = "id string, given string, family string, organization string, phones array<struct<label string, value string, normalized string>>, emails array<struct<label string, value string, normalized string>>, store_id string, updated timestamp_ntz"
GROUP = "group_id string, member_ids array<string>, reasons array<string>"
CONFLICT = "conflict_id bigint, group_id string, destination_id string, source_id string, field string, kept string, not_copied string"
STORE = "store_id string, store_name string, trust_rank int"


def day(n):
    return datetime(2024, 1, n)


def run(spark, contacts, groups, conflicts=()):
    stores = spark.createDataFrame([("s1", "one", 1), ("s2", "two", 2), ("s3", "three", 2), (None, "none", 1)], STORE)
    return survivors.survivors(spark.createDataFrame(contacts, CONTACT), spark.createDataFrame(groups, GROUP), spark.createDataFrame(list(conflicts), CONFLICT), stores)


def p(*keys):
    return [("home", k, k) for k in keys]


def found(df):
    return sorted({(r.group_id, r.field, r.contact_id) for r in df.where("decided = 'unanimous'").collect()})


def test_strict_winner_ties_and_stand_ins(spark):
    contacts = [
        ("a", "Robert", "Voss", None, p("1", "2"), [], "s1", day(9)), ("a", "Robert", "Voss", None, p("1", "2"), [], "s1", day(9)),
        ("b", "Rob", "Vossler", "N/A", p("1"), None, "s2", day(5)), ("c", "unknown", "Voss", "Acme", p("3", "3"), [("x", "y", None)], None, None),
        ("d", "Mia", None, "  ", [], [], "s3", day(7)), ("e", "Mi", None, None, None, None, "s2", day(7)), ("sole", "Ann", None, None, None, None, None, None),
    ]
    groups = [("g1", ["a", "b", "c", "gone"], []), ("g2", ["d", "e"], []), ("g3", ["sole"], None), ("g4", None, None), (None, ["a"], None), ("g5", ["x", None], [])]
    got = found(run(spark, contacts, groups))
    # b is longer than a in the family name but older; d and e tie in date; c is the only one with an organisation.
    assert got == [("g1", "given", "a"), ("g1", "organization", "c"), ("g1", "phones", "a"), ("g3", "given", "sole")]


def test_lost_names_come_from_the_conflict_log(spark):
    contacts = [("a", None, None, None, None, None, "s1", day(9)), ("b", "Li", None, None, None, None, "s2", day(2))]
    log = [(1, "g", "a", "b", "given", "Linda", "Li"), (1, "g", "a", "b", "given", "Linda", "Li"), (2, "g", "b", "a", "phones", "x", "y"), (3, "other", "a", "b", "family", "X", "Y"), (4, "g", "a", None, "family", None, "none")]
    assert found(run(spark, contacts, [("g", ["a", "b"], [])], log)) == [("g", "given", "a")]


def test_model_keeps_values_many_sources_state(spark):
    contacts, groups = [], []
    for i in range(30):
        groups.append((f"g{i}", [f"{i}a", f"{i}b", f"{i}c"], []))
        contacts += [(f"{i}a", "Ann", f"Fam{i}", None, p(f"t{i}", f"u{i}"), [], "s1", day(1)), (f"{i}b", "Ann", f"Fam{i}", None, p(f"t{i}", f"u{i}"), [], "s2", day(1)), (f"{i}c", f"Wrong{i}", None, None, p(f"w{i}"), [], "s3", day(1))]
    got = run(spark, contacts, groups).collect()
    assert {r.value for r in got if r.field == "given"} == {"Ann"}
    kept = {r.key for r in got if r.field == "phones"}
    assert {f"t{i}" for i in range(30)} | {f"u{i}" for i in range(30)} <= kept and not any(k.startswith("w") for k in kept)
    assert all(0 <= r.truth <= 1 for r in got)


def test_empty(spark):
    assert run(spark, [], []).count() == 0


def em_by_hand(claims, tolerance, rounds):
    """The model over dictionaries, denials written out."""
    slots, states = {}, {}
    for g, f, k, s in claims:
        slots.setdefault((g, f), set()).add(s)
        states.setdefault((g, f, k), set()).add(s)
    (a1, a0), (b1, b0) = survivors.SENSITIVITY_PRIOR, survivors.FALSE_POSITIVE_PRIOR
    sens = {(f, s): a1 / (a1 + a0) for (_, f), ss in slots.items() for s in ss}
    fpr = {k: b1 / (b1 + b0) for k in sens}

    def truth():
        out = {}
        for (g, f, k), own in states.items():
            odds = sum(math.log(sens[f, s] / fpr[f, s]) if s in own else math.log((1 - sens[f, s]) / (1 - fpr[f, s])) for s in slots[g, f])
            out[g, f, k] = 1 / (1 + math.exp(-odds))
        return out

    for _ in range(rounds):
        t, had = truth(), (dict(sens), dict(fpr))
        for f, s in sens:
            over = [(x, s in states[key]) for key, x in t.items() if key[1] == f and s in slots[key[:2]]]
            sens[f, s] = (sum(x for x, said in over if said) + a1) / (sum(x for x, _ in over) + a1 + a0)
            fpr[f, s] = (sum(1 - x for x, said in over if said) + b1) / (sum(1 - x for x, _ in over) + b1 + b0)
        if max(max(abs(sens[k] - had[0][k]) for k in sens), max(abs(fpr[k] - had[1][k]) for k in fpr)) <= tolerance:
            break
    return truth(), sens, fpr


def planted(n=400, seed=5):
    """Slots of five values of which two are true, stated by sources of known quality."""
    rng = random.Random(seed)
    known = {"good": (0.95, 0.05), "fair": (0.8, 0.15), "eager": (0.9, 0.5), "shy": (0.7, 0.02), "poor": (0.55, 0.45), "liar": (0.2, 0.7)}
    claims, true = [], {}
    for g in range(n):
        for k in range(5):
            true[f"g{g}", "phones", f"k{k}"] = k < 2
            claims += [(f"g{g}", "phones", f"k{k}", s) for s, (sens, fpr) in known.items() if rng.random() < (sens if k < 2 else fpr)]
    return claims, true, known


def test_model_as_by_hand_and_planted_qualities(spark, rows):
    claims, true, known = planted()
    df = spark.createDataFrame(claims, "group_id string, field string, key string, source string")
    facts, quality = survivors.fit(df, Scratch(spark, "t"), 1e-3, 50)
    expected, sens, fpr = em_by_hand(claims, 1e-3, 50)
    got = {(r.group_id, r.field, r.key): r.truth for r in survivors.judge(df, Scratch(spark, "t")).collect()}
    assert got == pytest.approx(expected, abs=1e-9)
    q = quality.first()
    for s, a, b in zip(q.names, q.sens, q.fpr, strict=True):
        assert (a, b) == pytest.approx((sens["phones", s], fpr["phones", s]), abs=1e-9)
        assert a == pytest.approx(known[s][0], abs=0.1) and b == pytest.approx(known[s][1], abs=0.1)  # values nobody states are never seen
    # The model beats the vote of the majority, since it learns whom not to believe.
    votes = Counter(c[:3] for c in claims)
    right = sum((t >= 0.5) == true[k] for k, t in got.items()) / len(got)
    majority = sum((votes[k] > len(known) / 2) == true[k] for k in got) / len(got)
    assert right >= 0.95 and right > majority


def test_rounds_end_at_the_tolerance(spark):
    df = spark.createDataFrame(planted(60)[0], "group_id string, field string, key string, source string")
    ends = [survivors.fit(df, Scratch(spark, "t"), 1e-3, n)[1].first().sens for n in (40, 60)]
    assert ends[0] == pytest.approx(ends[1], abs=1e-12) and survivors.fit(df, Scratch(spark, "t"), 1e-3, 1)[1].first().sens != ends[0]


def test_model_can_overrule_the_fullest_member(spark):
    """A book that the others always contradict is not believed, however full and new its entries."""
    contacts, groups = [], []
    for i in range(60):
        groups.append((f"g{i}", [f"{i}{x}" for x in "abcd"], []))
        contacts += [(f"{i}{x}", "Anna", f"Fam{i}", None, None, None, s, day(1)) for x, s in (("a", "s1"), ("b", "s2"), ("c", "s4"))]
        contacts.append((f"{i}d", f"Wrongname{i}", f"Fam{i}", None, None, None, "s3", day(9)))
    got = [r for r in run(spark, contacts, groups).collect() if r.field == "given"]
    assert {r.value for r in got} == {"Anna"}


def test_a_hot_group(spark):
    """A third of all contacts in one group: its values are counted by pattern, none is lost."""
    contacts = [(f"h{i}", "Ann", None, None, p(f"n{i}"), None, f"s{i % 3 + 1}", day(1 + i % 20)) for i in range(300)] + [(f"o{i}", "Bea", None, None, p(f"m{i}"), None, "s1", day(1)) for i in range(600)]
    got = run(spark, contacts, [("hot", [f"h{i}" for i in range(300)], [])] + [(f"g{i}", [f"o{i}", f"o{i + 1}"], []) for i in range(0, 600, 2)])
    assert [r.value for r in got.where("group_id = 'hot' AND field = 'given'").collect()] == ["Ann"]
    assert got.where("field = 'given'").count() == 301
