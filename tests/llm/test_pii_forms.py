import re

from pyspark.sql import functions as F

from repeatloom.llm import pii


def masked(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_values) for r in pii.pseudonymise(rows, "k1").orderBy("doc_id").collect()]


def test_all_telephone_numbers(spark):
    texts = [f"Call {n} now." for n in ("+1 (017) 555-7713", "+1 (132) 555-1352", "456-155-1234", "(156) 055-1234", "+49 30 1234567", "+33 1 23 45 67 89", "+44 20 7946 0958", "+4915112345678", "(030) 1234567", "0171-1234567", "089/123456", "01 23 45 67 89")]
    out = masked(spark, texts)
    for old, (new, n) in zip(texts, out):
        assert n == 1 and new != old, old
        assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", old)
    assert re.search(r"\([01]..\)", out[0][0]) and re.search(r" [2-9]..-[01]..-", out[2][0])


def test_low_telephone_codes_one_to_one(spark):
    number = lambda i: F.concat(F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((i * 7 % 1000).cast("string"), 3, "0"), F.lit("-1234"))
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), number(F.col("id")).alias("text"))
    assert pii.pseudonymise(rows, "k1").select("text").distinct().count() == 1000


def test_cards_beside_other_numbers(spark):
    card, other = "4111 1111 1111 1111", "5500 0000 0000 0004"
    texts = [f"{card} 12/27", "4111111111111111 123", f"12 {card}", f"x {card} y", f"123 4567 {card} {other} 9", f"{card} {other}", "1 456 555 1245 456 555 1246 7", "1 2 3 4 5 6 7 8 9 0 1 2 3 5 8"]
    out = masked(spark, texts)
    new = out[3][0][2:21]
    assert new != card and [n for _, n in out] == [1, 1, 1, 1, 2, 2, 2, 0]
    assert [t for t, _ in out[:3]] == [f"{new} 12/27", f"{new.replace(' ', '')} 123", f"12 {new}"]
    assert out[4][0].startswith(f"123 4567 {new} ") and out[4][0].endswith(" 9") and other not in out[4][0]
    assert "456 555 124" not in out[6][0] and out[7][0] == texts[7]


def test_long_secret(spark):
    value = "a1B2" * 100
    new = masked(spark, [f"token={value} end"])[0][0]
    assert len(new) == len(f"token={value} end") and "B2a1" not in new
