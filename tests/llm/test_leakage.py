import random

import numpy as np
from pyspark.sql import functions as F

from mediasift.llm import leakage

WORDS = [f"w{i}" for i in range(300)]


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            if text and item and d is not None and i is not None:
                mode = leakage.mode_of(item)
                sep = "" if mode.chars else " "
                a, b = leakage.units(text, mode), leakage.units(item, mode)
                runs = {sep.join(b[k : k + mode.run]) for k in range(len(b) - mode.run + 1)}
                if any(sep.join(a[k : k + mode.run]) in runs for k in range(len(a) - mode.run + 1)):
                    out.add((d, i))
    return sorted(out, key=str)


def world():
    rng = random.Random(7)
    items = [(i, " ".join(rng.choices(WORDS[: 40 if i % 2 else 300], k=30))) for i in range(12)]
    items += [(20, "如果第二位考官打开来访名片登记册在剧院后面找到直到三一六三号工单写明唯一可信的所有者"), (21, "short text"), (22, ""), (23, None), (24, "已知某位阅卷人打开一盒没有标签的幻灯片abcdefghijklmnopqrstuvwxyz由学院捐出")]
    docs = []
    for d in range(60):
        words = rng.choices(WORDS, k=80)
        item = items[rng.randrange(12)][1].split()
        n = rng.choice([9, 11, 12, 13, 30])
        at = rng.randrange(len(item) - n + 1)
        docs.append((d, ", ".join(words[:40] + [w.upper() for w in item[at : at + n]] + words[40:])))
    docs += [(100, "前言。如果第二位考官，打开来访名片登记册：在剧院后面找到直到三一六三号。"), (101, "如果第二位考官打开"), (102, None), (103, ""), (104, "x ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (105, "w1 " * 50_000)]
    return docs, items


def test_exact_runs_as_brute_force(spark, rows):
    docs, items = world()
    d = spark.createDataFrame(docs + docs[:3] + [(None, docs[0][1])], "doc_id bigint, text string").withColumn("body", F.lit(1))
    i = spark.createDataFrame(items + items[:2], "item_id bigint, text string").withColumn("item", F.lit(2))
    expected = brute(docs, items)
    assert len(expected) > 20
    assert rows(leakage.find_leaks(d, i).where("verbatim"), "doc_id", "item_id") == expected
    assert rows(leakage.find_leaks(d, i, block_units=60, edited=False).where("verbatim"), "doc_id", "item_id") == expected


def test_edited_copy_scores_and_nothing_else_does(spark, rows):
    item = " ".join(f"term{i}" for i in range(30))
    edited = " ".join(w for i, w in enumerate(item.split()) if i % 7 != 6)
    d = spark.createDataFrame([("d1", "intro words " + edited), ("d2", "nothing of the kind here")], "doc_id string, text string")
    got = leakage.find_leaks(d, spark.createDataFrame([("i1", item)], "item_id string, text string")).collect()
    assert [(r.doc_id, r.item_id, r.verbatim) for r in got] == [("d1", "i1", False)] and got[0].score > 0.6 and got[0].longest_run == 6


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert leakage.find_leaks(none, some).count() == 0
    assert leakage.find_leaks(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), some.where("item_id = 2")).count() == 0


def test_alignment_as_the_plain_table():
    rng = random.Random(1)
    for _ in range(30):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        items = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        expected = []
        for b in items:
            h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a, 1):
                for j, y in enumerate(b, 1):
                    h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                    run[i][j] = run[i - 1][j - 1] + 1 if x == y else 0
            expected.append((max(map(max, h)), max(map(max, run))))
        assert leakage.align([(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) for b in items]) == expected


def test_long_document(spark, rows):
    item = " ".join(f"term{i}" for i in range(40))
    noise = " ".join(f"n{i}" for i in range(5000))
    d = spark.createDataFrame([(1, f"{noise} {item} {noise}"), (2, " ".join([noise, *item.split()[:13]])), (3, noise)], "doc_id bigint, text string")
    got = {r.doc_id: (r.longest_run, r.verbatim) for r in leakage.find_leaks(d, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert got == {1: (40, True), 2: (13, True)}


def planted(seed=3):
    """Items of common words with a rare one here and there, as templates share them; a clean copy of each, and edited and paraphrased ones."""
    rng = random.Random(seed)
    frame = [" ".join(rng.choices(WORDS[:80], k=9)) for _ in range(12)]
    items = [(i, " ".join(x for _ in range(rng.randint(2, 4)) for x in (rng.choice(frame), f"name{rng.randrange(10**6)}", " ".join(rng.choices(WORDS, k=4)), str(rng.randrange(10**5))))) for i in range(60)]
    docs, truth = [], set()
    noise = lambda: rng.choices(WORDS, k=60) + rng.choice(frame).split()
    for d in range(600):
        words = noise()
        if d % 3 == 0:
            i, item = items[rng.randrange(60)]
            copy = item.split()
            kind = d % 4
            if kind == 0:  # every fifth word replaced
                copy = [rng.choice(WORDS) if k % 5 == 4 else w for k, w in enumerate(copy)]
            elif kind == 1:  # paraphrased: a quarter replaced, some left out, some put in
                copy = [x for w in copy if rng.random() > 0.08 for x in ([rng.choice(WORDS)] if rng.random() < 0.25 else [w, "well"] if rng.random() < 0.05 else [w])]
            elif kind == 2:  # cut in two and turned round
                copy = copy[len(copy) // 2 :] + copy[: len(copy) // 2]
            words[30:30] = copy
            truth.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, items, truth


def test_recall_of_edited_and_paraphrased_copies(spark, rows):
    docs, items, truth = planted()
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = set(rows(leakage.find_leaks(d, i, min_score=0.4), "doc_id", "item_id"))
    assert len(truth & got) >= 0.95 * len(truth) and len(got - truth) <= 0.05 * len(truth)
    # Ten times as many other documents change nothing of what is found.
    more = d.unionByName(spark.range(1000, 7000).select(F.col("id").alias("doc_id"), F.lit(docs[1][1]).alias("text")))
    assert truth & got <= set(rows(leakage.find_leaks(more, i, min_score=0.4), "doc_id", "item_id"))


def test_memory_of_a_block_of_chinese_items():
    """One million characters, a block's fill, as arrays."""
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9000, leakage.BLOCK_UNITS)))
    items = leakage.Items([(k, text[k * 1000 : (k + 1) * 1000]) for k in range(1000)], leakage.CHARS, True)
    size = items.codes.nbytes + sum(k.sorted.nbytes + k.first.nbytes for k in items.known.values())
    assert size < 64 * leakage.BLOCK_UNITS
