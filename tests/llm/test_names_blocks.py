"""Crowded blocks lose no pair that the comparison would accept."""

import random

import pytest
from pyspark.sql import functions as F

from mediasift.llm import names
from mediasift.scratch import Scratch
from mediasift.ship import ship
from tests.llm.test_names import filler, groups


def typos(word, n):
    """``n`` spellings, each one replaced letter away from ``word``."""
    return [word[:i] + x + word[i + 1 :] for x in "xqwz" for i in range(1, len(word)) if word[i] != x][:n]


def test_one_token_names_of_crowded_blocks_meet(spark):
    words = ["zetipelis", *typos("zetipelis", 24), "zetipelis"]
    assert [len(g) for g in groups(spark, [(f"o{i:02}", None, None, f"{w} Logistics Ltd") for i, w in enumerate(words)] + filler(60)) if "o00" in g] == [26]


def test_one_token_people_of_a_crowded_organisation_meet(spark):
    words = ["zetipelis", *typos("zetipelis", 24), "zetipelis"]
    got = groups(spark, [(f"p{i:02}", None, w, "Drabudo Logistics Ltd") for i, w in enumerate(words)] + [("q", None, "Zetipelis", "Kolomar Services Ltd")] + filler(60))
    assert [len(g) for g in got if "p00" in g] == [26] and ["q"] in got


def test_near_families_with_different_usual_spellings_meet(spark):
    """Lanker is near Janker and Lankes; the given name is in a crowded block, and no organisation helps."""
    crowd = [(f"j{i:02}", f"Given{chr(97 + i)}", "Janker", None) for i in range(20)] + [(f"l{i:02}", f"Other{chr(97 + i)}", "Lankes", None) for i in range(15)]
    crowd += [(f"e{i:02}", "Elisabeth", f"{a}{b}rrukomas", None) for i, (a, b) in enumerate((a, b) for a in "BDFGK" for b in "aeiou")]
    got = groups(spark, [("x", "Elisabeth", "Lanker", None), ("y", "Elisabeth", "Lankes", None), *crowd])
    assert any({"x", "y"} <= set(g) for g in got)


def test_near_tokens_are_all_found(spark):
    """Against brute force: every pair within its edits, short tokens and long."""
    rng = random.Random(5)
    words = set()
    for n in [*range(4, 13), 19, 20, 21, 22, 26] * 12:
        w = "".join(rng.choice("abcdeilmnorst") for _ in range(n))
        words.add(w)
        for _ in range(4):
            for _ in range(rng.choice([1, 2])):
                i, x = rng.randrange(len(w) - 1), rng.choice("abcdeilmnorst")
                w = rng.choice([w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + x + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + x + w[i:]])
            words.add(w)
    words = sorted(w for w in words if len(w) >= 4)
    want = {(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) <= 2 and names.edits(a, b, names.allowed_edits(a, b)) <= names.allowed_edits(a, b)}
    ship(spark)
    got = {tuple(r) for r in names.similar_tokens(spark.createDataFrame([(w,) for w in words], "token string"), Scratch(spark, "t")).collect()}
    assert got == want


@pytest.mark.parametrize("others", [2, 15, 40, 5000])
def test_a_crowded_family_loses_no_pair(spark, others):
    """Two spellings of one person, beside many other people of the family."""
    given = ["".join(random.Random(i).choice(c) for c in ("bdgklmnrstv", "aeiou") * 4).title() + "us" for i in range(others)]
    data = [("x", "Bill", "Winterbottom", None), ("y", "Wiliam", "Winterbottom", None)] + [(f"w{i}", g, "Winterbottom", None) for i, g in enumerate(given)]
    assert any({"x", "y"} == set(g) for g in groups(spark, data))


def test_candidates_are_all_that_match(spark):
    """Against brute force over the comparison itself."""
    rng = random.Random(11)
    given, family, orgs = ["elisabeth", "lisa", "elsabeth", "e", "robert", "bob", "robrt", "jo", "joana", "johanna"], ["brooke", "broke", "brooks", "halden", "haldne", "zetipelis", "zetipelis-brooke", "brocke"], ["drabudo", "drabuod", "kolomar", "fugomar", "kolomra"]
    spellings = []
    for _ in range(160):
        kind = "o" if rng.random() < 0.2 else "p"
        name = rng.sample(orgs, rng.randint(1, 2)) if kind == "o" else rng.sample(given, rng.randint(0, 2)) + rng.sample(family, rng.randint(1, 2))
        org = [] if kind == "o" or rng.random() < 0.4 else rng.sample(orgs, rng.randint(1, 2))
        spellings.append((kind, sorted(name), sorted(org)))
    spellings = [(f"r{i:03}", *x) for i, x in enumerate(sorted({(k, tuple(n), tuple(o)) for k, n, o in spellings}))]
    want = {(a, b) for a, k, n, o in spellings for b, k2, n2, o2 in spellings if a < b and k == k2 and names.same_name(k, list(n), list(o), list(n2), list(o2)) > 0}
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(r, k, list(n), list(o)) for r, k, n, o in spellings], "rep string, kind string, name array<string>, org array<string>")
    counts = scratch.write(df.select(F.explode(names.word_parts(F.concat("name", "org"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    near = scratch.write(names.similar_tokens(counts, scratch))
    got = {tuple(r) for r in names._candidates(df, near, names._usual_spelling(counts, near), scratch).collect()}
    assert len(want) > 100 and want <= got


def test_copies_of_one_organisation_do_not_change_what_is_generic(spark):
    """A third of all rows name one organisation; its form stays generic, and people typed as organisations stay people."""
    hot = [(f"h{i:03}", None, None, "Fugribibeth Logistics Ltd") for i in range(200)]
    rng = random.Random(9)
    families = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(6)) for _ in range(40)]
    people = [(f"m{i:02}", "Kotreel", f, None) for i, f in enumerate(families)] + [(f"k{i:02}", None, None, f"Kotreel {f}") for i, f in enumerate(families[:20])]
    typed = [("t0", "Fugribibeth", "Logistics", None)]
    got = groups(spark, hot + people + typed + filler(60))
    assert any({"h000", "h199", "t0"} <= set(g) for g in got)
    assert all(any({f"k{i:02}", f"m{i:02}"} == set(g) for g in got) for i in range(20))
