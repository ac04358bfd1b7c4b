import pytest
from pyspark.sql import functions as F

from mediasift.functions import normalize as N
from mediasift.functions import text as T


def apply(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_phone_keys(spark):
    values = ["+1 (555) 010-1234", "15550101234", "(555) 010-7777", "+15550107777", "", "123", "call me", "+1+5550101234", "5550101234+", "५५५०१०१२३४", "1 555\t0101", None, "09876543210"]
    keys = apply(spark, N.phone_keys, values)
    assert keys[0] == ["s:15550101234", "n:5550101234"] and keys[1] == ["s:15550101234"]
    assert keys[2] == ["s:5550107777", "n:5550107777"] and keys[3][1] == "n:5550107777"
    assert keys[4:9] == [[]] * 5 and keys[9] == ["s:5550101234", "n:5550101234"] and keys[10] == ["s:15550101"] and keys[11] is None and keys[12] == ["s:09876543210"]
    assert apply(spark, N.phone_key, ["+1 555 0101", "x", None]) == ["s:15550101", None, None]


def test_email_and_name_keys(spark):
    assert apply(spark, N.email_key, [" Owen.Blake@Example.com ", "a@b@c", "@x", "x@", "x", None]) == ["owen.blake@example.com", None, None, None, None, None]
    assert apply(spark, N.name_key, ["  Mara  VOSS ", "", " \t", None, "Zoë"]) == ["mara voss", None, None, None, "zoë"]


def fnv(text):
    h = 14695981039346656037
    for b in text.encode():
        h = ((h ^ b) * N.FNV_MULTIPLIER) % 2**64
    return format(h, "x")


def test_digest(spark):
    values = ["", "a", "foobar", "Müller \u0001 x", "z" * 300]
    assert apply(spark, N.fnv_hex, values) == [fnv(v) for v in values]
    ids = spark.createDataFrame([(["a", "b"],)], "m array<string>").select(N.group_id(F.col("m"))).first()[0]
    assert ids == "g-" + fnv("a\x01b")


def test_letters_and_digits(spark):
    assert apply(spark, T.alnum, ["_$!<Home>!$_", "٣٤ ÄB-c", None, "१２3"]) == ["home", "34äbc", None, "123"]
    assert apply(spark, T.fold_marks, ["Zoë Søren Müllbach Bélanque", None]) == ["Zoe Soren Mullbach Belanque", None]
    assert apply(spark, T.blank_trim, ["  a b\t　", None]) == ["a b", None]


@pytest.mark.parametrize("ids", [["b", "a"], []])
def test_signature(spark, ids):
    got = spark.createDataFrame([(ids,)], "m array<string>").select(N.set_signature(F.col("m"))).first()[0]
    assert got == f"{len(ids)}|{','.join(sorted(ids))}"
