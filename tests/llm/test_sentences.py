import pytest
from pyspark.sql import functions as F

from mediasift.llm import sentences as S

#: Sentences one after the other, each with the blank that follows it.
CASES = [
    ["The scan ended at 5.30 p.m. and stopped. ", "Next one."],
    ["We spoke to Mr. Vale of Acme Inc. about it. ", "“Did it stop?” asked Iris. ", "See a.example.com/x?id=3 for more."],
    ["“It kept two frames,” said J. R. Otis, “as I expected.” ", "(The widget hid it.) ", "It waited... and went on (it always does!) there."],
    ["Storage overview\n\n", "The widget counted\nthe videos. ", "It took 1,204.5 s… not bad! ", "Wow!\n", "2) The scan listed them.\n", "• The widget stopped?!"],
    ["Am 14. März zählte das Album 1.204 Bilder. ", "Nr. 5 bzw. S. 12 fehlt. ", "„Ist das fertig?“, fragte Otto. ", "Otto schrieb: „Alles da.“ ", "Das Widget steht."],
    ["« Le nettoyage a fini ! » a dit Paul. ", "La vue a compté env. 3,4 Go. ", "Paul a écrit : « C'est fait. » ", "Le reste suit."],
    ["¿La limpieza borró una ficha? ", "A las 5 p. m. la agenda paró. ", "¡Listo! ", "«Ya está», dijo Ana."],
    ["我的图库显示了内容。", "真的吗？", "截图（约 3.4 GB！）跳过了它。", "甲说：「丢失了照片。」", "重复联系人保留了……然后停了。"],
    ["連絡先は（約 3.7 GB。目安です）残した。", "「数えた？」とRenが聞いた。", "本当ですか？", "終わり。"],
    ["डॉ. Vale ने कार्ड छिपाईं। ", "“प्रतियाँ दीं।” ", "क्या वे रखीं? ", "अंत।"],
    ["هل نقلت الصور؟ ", "قال د. Otis: «أخفت 9.5 غيغابايت.» ", "النسخة نقلت الصور."],
]
STARTS = ["The", "Das", "La", "Le", "See", "It", "We", "Next", "Nr", "Am", "A", "Wow"]
MODEL = S.Model(abbreviations={"p.m": True, "mr": False, "inc": False, "j": False, "r": False, "nr": False, "bzw": False, "s": False, "env": False, "डॉ": False, "د": False, "p": False, "m": False}, starters=set(STARTS), ordinals={"März"})


def expected(parts):
    out, at = [], 0
    for p in parts:
        out.append(at + len(p.rstrip()))
        at += len(p)
    return out


@pytest.mark.parametrize("parts", CASES, ids=range(len(CASES)))
def test_rules(parts):
    text = "".join(parts)
    ends = S.sentence_ends(text, MODEL)
    assert [text[a:b] for a, b in zip([0, *ends], ends, strict=False)] == [text[a:b] for a, b in zip([0, *expected(parts)], expected(parts), strict=False)]


def test_thai():
    model = S.Model(thai={"คลังร", "สมุดร"}, said={"บอกว่"})
    parts = ["สมุดรายชื่อลบ IMG_8601.HEIC ในรอบที่ 8601 นี้ค่ะ ", "คลังรูปภาพใกล้กับ Rosteres แล้ว ", "Kitrikro บอกว่าสมุดรายชื่อเก็บภาพ 3605 ใบ\n", "2) คลังรูปภาพลบแล้ว"]
    assert S.sentence_ends("".join(parts), model) == expected(parts)


def test_abbreviations_are_learned(spark):
    docs = [(i, f"Name{i} showed approx. {i} items. The widget saw Dr. Fulo{i} there. It ended. The end came.") for i in range(40)]
    docs += [(100 + i, "The scan moved items vs. the others. My phone has items. It went well.") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("doc", F.lit(1)).withColumn("body", F.lit("x"))
    got = {}
    for r in S.split_sentences(df).collect():
        got.setdefault(r.doc_id, []).append(r.end_pos)
    assert all(len(got[i]) == 4 for i in range(40)) and all(len(got[100 + i]) == 3 for i in range(20))


def test_nothing_null_blank_repeated_and_long(spark, rows):
    long = "A sentence of some length (never closed. “Open too. " * 20_000
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", " \n\t "), ("d", "One. Two."), ("d", "One. Two."), (None, "Lone"), ("l", long)], "doc_id string, text string")
    got = rows(S.split_sentences(df), "doc_id", "end_pos")
    assert [r for r in got if r[0] != "l"] == sorted([("d", 4), ("d", 9), ("d", 4), ("d", 9), (None, 4)], key=str)
    assert S.split_sentences(df.where("doc_id = 'none'")).count() == 0


def test_every_character_is_in_a_sentence():
    for parts in CASES:
        text = "".join(parts)
        ends = S.sentence_ends(text, S.Model())
        assert ends == sorted(set(ends)) and ends[-1] == len(text.rstrip())


def cut(text, model):
    ends = S.sentence_ends(text, model)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends, strict=False)]


def test_the_document_decides_before_the_corpus():
    model = S.Model(abbreviations={"art": True, "approx": False}, starters={"The", "It"})
    own = "The pkg. was heavy. It held pkg. 5 and pkg. no one wanted. We saw the pkg. The label was torn."
    assert cut(own, model) == ["The pkg. was heavy.", "It held pkg. 5 and pkg. no one wanted.", "We saw the pkg.", "The label was torn."]
    title = "We met Kdt. of the guard, Kdt. 7 and Kdt. in white. There was Kdt. Moro again."
    assert cut(title, model) == ["We met Kdt. of the guard, Kdt. 7 and Kdt. in white.", "There was Kdt. Moro again."]
    plain = "She likes art and he hates art too. All of it is art. Moro left."
    assert cut(plain, model)[1] == "All of it is art." and cut("All of it is art. Moro left.", S.Model(abbreviations={"art": False})) == ["All of it is art. Moro left."]


def test_names_and_common_words_are_read_off_the_document():
    model = S.Model(abbreviations={"inc": True}, starters={"Rose"})
    assert cut("They work at Acme Inc. Rose is there.", model) == ["They work at Acme Inc.", "Rose is there."]
    assert cut("I told Rose that Acme Inc. Rose is a firm, says Rose.", S.Model(abbreviations={"inc": False}, starters={"Rose"})) == ["I told Rose that Acme Inc. Rose is a firm, says Rose."]
    assert cut("We saw nobody when we called Acme Inc. Nobody came.", S.Model(abbreviations={"inc": True})) == ["We saw nobody when we called Acme Inc.", "Nobody came."]


def test_rare_abbreviations_of_a_large_corpus(spark, rows):
    """Beyond what is broadcast, every text gets its abbreviations by a join; the sentences are the same."""
    docs = [(i, f"Name{i} showed approx. {i} items. The widget saw Dr. Fulo{i} there. It ended. The end came.") for i in range(40)] + [(99, None), (98, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("h", F.lit("x")).withColumn("types", F.lit(1))
    few, many = (rows(S.split_sentences(df, max_types=n)) for n in (0, 10_000))
    assert few == many and len(few) == 160
