from mediasift.operators import identity as I
from mediasift.scratch import Scratch
from mediasift.sources.readers import CONTACT

v = lambda *xs: [("home", x, None) for x in xs]


def contact(i, given=None, family=None, org=None, phones=(), emails=()):
    return (i, given, family, org, v(*phones), v(*emails), None, None)


FIXTURE = [
    # A phone typed in two ways, beside different emails; and one with the country code only once.
    contact("k1", "Ulla", "Brandvik", "", ["+47 (212) 334-5566"], ["ulla@fjord.test"]), contact("k2", "Ulla", "Brandvik", "", ["+47 212 334 5566"], ["u.brandvik@fjord.test"]),
    contact("k3", "Teo", "Sandoval", None, ["+12024440188"]), contact("k4", "Teo", "Sandoval", None, ["(202) 444-0188"]),
    # An email, a name with its organisation, and contacts that share nothing usable.
    contact("k5", "Nadia", "Ferrant", "Quarry Nine", [], ["nadia@quarry.test"]), contact("k6", "N.", "Ferrant", "Quarry Nine", [], ["nadia@quarry.test"]),
    contact("k7", "Bo", "Lindqvist", "Quarry Nine", ["+1 202 444 0301"]), contact("k8", "Bo", "Lindqvist", "Quarry Nine", ["+1 202 444 0302"]),
    contact("k9", "Imre", "Palotas", None, ["+1 202 444 0401"], ["imre@palotas.test"]), contact("l1", "Yuki", "Arakawa", "Arakawa Press", ["+1 202 444 0402"]), contact("l2"),
    (None, "Ulla", "Brandvik", None, None, None, None, None),
]


def groups(spark, rows):
    return sorted((r.member_ids, r.reasons) for r in I.duplicate_groups(spark.createDataFrame(rows, CONTACT)).collect())


def test_fixture_groups(spark):
    assert groups(spark, FIXTURE) == [(["k1", "k2"], ["sharedPhone"]), (["k3", "k4"], ["sharedPhone"]), (["k5", "k6"], ["sharedEmail"]), (["k7", "k8"], ["sharedNameAndOrganization"])]


def test_key_cap(spark):
    assert groups(spark, [contact(f"{i:02}", phones=["5550001"]) for i in range(52)]) == []
    assert [len(m) for m, _ in groups(spark, [contact(f"{i:02}", phones=["5550001"]) for i in range(50)])] == [50]


def test_chain_of_reasons_and_empty(spark):
    rows = [contact("a", phones=["5550001"]), contact("b", phones=["555-0001"], emails=["x@y"]), contact("c", "Al", "Bo", "Org", emails=["X@Y "]), contact("d", " al", "BO", "ORG")]
    assert groups(spark, rows) == [(["a", "b", "c", "d"], ["sharedEmail", "sharedNameAndOrganization", "sharedPhone"])]
    assert groups(spark, []) == []


def test_merge_plan(spark):
    rows = [contact("a", "", "Ekberg", "Lab", ["555 0001"], ["a@x"]), contact("b", "Siri", "Ekber", None, ["5550001", "555-0002", "none"], ["A@X", "b@x"]), contact("c", "Sira", "Ekberg", "Lab", ["5550002", "none"], ["odd"])]
    g = spark.createDataFrame([("g", ["c", "a", "b", "gone"])], "group_id string, member_ids array<string>")
    p = I.merge_plan(spark.createDataFrame(rows, CONTACT), g).first()
    assert (p.destination_id, p.source_ids, p.phones, p.emails) == ("a", ["b", "c"], ["555-0002", "none"], ["b@x", "odd"])
    assert (p.given, p.family, p.organization) == ("Siri", "Ekberg", "Lab")
    assert [tuple(x) for x in p.conflicts] == [("given", "Siri", "Sira"), ("family", "Ekberg", "Ekber")]


def test_components_of_chains_and_hubs(spark, rows, monkeypatch):
    edges = spark.createDataFrame([(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("hub", f"s{i:03}") for i in range(120)] + [("x", "x")], "a string, b string")
    expected = sorted([(f"c{i:03}", "c000") for i in range(71)] + [("hub", "hub")] + [(f"s{i:03}", "hub") for i in range(120)], key=str)
    assert rows(I.components(edges, Scratch(spark, "t"))) == expected
    plain = I.join_on_hot_key  # and with keys salted from ten rows on
    monkeypatch.setattr(I, "join_on_hot_key", lambda *a: plain(*a, salts=4, least=10))
    assert rows(I.components(edges, Scratch(spark, "t"))) == expected
