"""Pseudonyms against a plain Python version: own readers of each format, own Feistel network."""

import calendar
import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from repeatloom.llm import pii

KEY = "a key of the tests"


def feistel(l, r, sizes, tweak):
    for turn in range(10):
        noise = int(hashlib.sha256(f"{KEY}|{tweak}|{turn}|{r if turn % 2 == 0 else l}".encode()).hexdigest()[:15], 16)
        if turn % 2 == 0:
            l = (l + noise % sizes[0]) % sizes[0]
        else:
            r = (r + noise % sizes[1]) % sizes[1]
    return l, r


def permute(digits, kind):
    h = len(digits) // 2
    l, r = feistel(int(digits[:h]), int(digits[h:]), (10**h, 10 ** (len(digits) - h)), f"{kind}{len(digits)}")
    return f"{l:0{h}d}{r:0{len(digits) - h}d}"


def fill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def only(text):
    return re.sub(r"\D", "", text)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def card(text):
    d = only(text)
    body = permute(d[:-1], "card")
    return fill(text, next(body + str(c) for c in range(10) if luhn(body + str(c))))


def number97(text):
    return int("".join(str(int(c, 36)) for c in text.replace(" ", "")))


def account(text):
    body = fill(text[4:], permute(only(text[4:]), "account"))
    check = 98 - number97(body + text[:2] + "00") % 97
    return f"{text[:2]}{check:02d}{body}"


def address(text):
    a, b, c, d = map(int, text.split("."))
    l, r = feistel(a * 256 + b, c * 256 + d, (65536, 65536), "address")
    return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"


def social(text):
    areas = [a for a in range(1, 900) if a != 666]
    a, g, s = map(int, text.split("-"))
    l, r = feistel(areas.index(a), (g - 1) * 9999 + s - 1, (898, 989901), "social")
    return f"{areas[l]:03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"


def date(text):
    sep = re.search(r"\D", text)[0]
    f = text.split(sep)
    order = "ymd" if len(f[0]) == 4 else "dmy"
    if order == "dmy" and not (1 <= int(f[1]) <= 12 and 1 <= int(f[0]) <= calendar.monthrange(int(f[2]), int(f[1]))[1]):
        order = "mdy"
    part = dict(zip(order, f))
    y, m, d = (int(part[k]) for k in "ymd")
    if (m, d) == (2, 29):
        l, r = feistel((y - 1904) // 4 // 7, (y - 1904) // 4 % 7, (7, 7), "leap")
        y = 1904 + 28 * l + 4 * r
    else:
        first_days = [datetime.date(2001, 1, 1) + datetime.timedelta(k) for k in range(365)]
        days = [
            (x.month, x.day) for x in first_days
            if (len(part["m"]) == 2 or x.month < 10) and (len(part["d"]) == 2 or x.day < 10) and (order != "mdy" or x.day > 12)
        ]
        tweak = "date" + order[0] + "".join(str(len(part[k]) == 1).lower() for k in "md")
        l, r = feistel(y - 1900, days.index((m, d)), (200, len(days)), tweak)
        y, (m, d) = 1900 + l, days[r]
    new = {"y": str(y), "m": str(m).zfill(len(part["m"])), "d": str(d).zfill(len(part["d"]))}
    return sep.join(new[k] for k in order)


def secret(value):
    out = "".join(hashlib.sha256(f"{KEY}|secret{i or ''}|{value}".encode()).hexdigest() for i in range(len(value) // 64 + 1))
    return out[: len(value)]


def email(text):
    return "user" + hashlib.sha256(f"{KEY}|email|{text.lower()}".encode()).hexdigest()[:16] + "@example.invalid"


def values(rng):
    """(old, new) of a random value."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    kind = rng.randrange(10)
    if kind == 0:
        body = rng.choice("3456") + digits(rng.choice([11, 14, 17]))
        number = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        text = rng.choice([number, " ".join(number), " ".join(number[i : i + 4] for i in range(0, len(number), 4)), "-".join(number)])
        return text, card(text)
    if kind == 1:
        letters = rng.choice(["", "WEST", "ABNA"])
        body = letters + digits(rng.choice([14, 16, 18]))
        number = f"DE{98 - number97(body + 'DE00') % 97:02d}{body}"
        text = rng.choice([number, " ".join(number[i : i + 4] for i in range(0, len(number), 4))])
        return text, account(text)
    if kind == 2:
        text = ".".join(str(rng.randrange(256)) for _ in range(4))
        return text, address(text)
    if kind == 3:
        text = f"{rng.choice([1, 123, 665, 667, 899, rng.randrange(1, 660)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
        return text, social(text)
    if kind in (4, 5, 6):
        day = rng.choice([datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73000)), datetime.date(2024, 2, 29)])
        width = rng.choice(["", "02"])
        fields = {"y": f"{day.year:04d}", "m": f"{day.month:{width}d}", "d": f"{day.day:{width}d}"}
        text = rng.choice("-/.").join(fields[k] for k in rng.choice(["ymd", "dmy", "mdy"]))
        return text, date(text)
    if kind == 7:
        value = "".join(rng.choices("abcdefXYZ_+/-", k=rng.choice([9, 80, 300]))) + digits(3) + rng.choice(["", ".ab1.c-d", "=="])
        lead = rng.choice(["token=", "api_key: ", 'Password="'])
        return lead + value, lead + secret(value)
    if kind == 8:
        text = "".join(rng.choices("abc._%+-", k=rng.choice([3, 60, 400]))) + rng.choice("xyz") + "@" + rng.choice(["a.b-c.example.com", "X1.org", "x" * 70 + ".net"])
        return text, email(text)
    bad = rng.choice(["4041894974608796", "999.1.1.1", "2001-02-30", "30/30/2001", "666-11-1111", "123-00-1234", "3.14159", "1/2", "12:30", "DE00 1234 1234 1234 1234 12", "13/13/2013"])
    return bad, bad


def test_random_texts(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        old, new, n = "", "", 0
        for _ in range(rng.randrange(0, 6)):
            words = " ".join(rng.choices(["see", "the", "(", "and:", "über", "\n", "x,"], k=rng.randrange(1, 4)))
            a, b = values(rng)
            old, new, n = f"{old}{words} {a}\t", f"{new}{words} {b}\t", n + (a != b)
        rows.append((i, old + "end", new + "end", n))
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string, n long").repartition(4)
    wrong = pii.pseudonymise(docs, KEY).where("text <> want or n_values <> n").limit(3).collect()
    assert wrong == []


@pytest.mark.parametrize("shape", ["d/d/y", "dd-dd-y", "y.dd.dd", "d-dd-y", "dd/d/y"])
def test_dates_one_to_one(spark, shape):
    """All dates so written go to different dates so written."""
    one = {"d": [str(i) for i in range(1, 10)], "dd": [f"{i:02d}" for i in range(1, 32)], "y": ["1900", "1996", "2001", "2024", "2099"]}
    a, sep, b, _, c = re.match(r"(\w+)(\W)(\w+)(\W)(\w+)", shape).groups()
    texts = [f"{x}{sep}{y}{sep}{z}" for x in one[a] for y in one[b] for z in one[c]]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string"), KEY, count=None).collect()]
    assert len(set(out)) == len(set(texts)) and [len(x) for x in out] == [len(x) for x in texts]
    assert all(re.sub(r"\d", "0", x) == re.sub(r"\d", "0", y) for x, y in zip(out, texts))


def test_very_long_texts_and_clashing_names(spark):
    number = "4041 8949 7460 8795"
    digits = " ".join(str(i % 10) for i in range(30_000)) + "x"
    long = f"{'word ' * 200_000}{number} {'.' * 300_000}{'a' * 300_000} {'7' * 5000}"
    rows = [(1, long, 5, "f", "s"), (2, digits, 5, "f", "s"), (None, None, None, None, None), (None, number, 1, None, None), (None, number, 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_values int, __found string, __found_ string")
    out = pii.pseudonymise(docs, KEY).collect()
    assert out[0].text == long.replace(number, card(number)) and out[0].n_values == 1
    assert [(r["__found"], r["__found_"]) for r in out] == [tuple(r[3:]) for r in rows]
    assert len(out[1].text) == len(digits) and out[2].n_values == 0 and out[3].text == out[4].text == card(number)
    assert pii.pseudonymise(docs, KEY, count=None).columns == docs.columns
    assert [r.n_values for r in pii.pseudonymise(docs, KEY, count="found").orderBy(F.col("doc_id").desc_nulls_last()).select("n_values").collect()][:2] == [5, 5]
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")
