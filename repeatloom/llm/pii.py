"""Format-preserving pseudonyms for personal data, in SQL functions only.

Candidates are found by pattern and validated: card and bank account numbers by their check
digits, addresses by their ranges, dates by the calendar; all telephone numbers count. Each
valid value is replaced by a keyed Feistel permutation of its own format, so equal values
get equal pseudonyms in all documents and different values different ones. E-mail addresses
and access keys have no such format; they get keyed digests in the same alphabet.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: Spark setting that holds the key.
KEY_SETTING = "spark.repeatloom.pii.key"

# Patterns of candidates, in the order in which they are tried. Repetitions without a bound
# are of single characters, which the engine matches without recursion and, as a run is
# entered at its start only, in one pass.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*\.){1,120}[A-Za-z]{2,24}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:token|password|passwd|secret|api_key|apikey)\s?[=:]\s?\"?[A-Za-z0-9_+/-]{8,}(?:\.[A-Za-z0-9_+/-]+){0,8}={0,2}",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "address": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?<![0-9][.-])(?=[0-9](?:[ -]?[0-9]){12})[0-9][0-9 -]*[0-9](?![0-9]|\.[0-9])",
    "world": r"(?<![0-9.+])\+(?!1[ .-]?\(?[0-9]{3}\)?[ .-])[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,12})){1,6}(?![0-9])",
    "trunk": r"(?<![0-9.+-])(?:\(0[1-9][0-9]{1,4}\)[ ]?|0[1-9][0-9]{1,4}[ /-])[0-9]{3,8}(?:[ -][0-9]{2,5})?(?![0-9])|(?<![0-9.+-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])",
    "phone": r"(?<![0-9.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}


def _any(*names: str) -> str:
    """An alternation of patterns; a date's back references are written out, as their numbers would change."""
    dates = "|".join(f"[0-9]{{4}}{m}[0-9]{{1,2}}{m}[0-9]{{1,2}}|[0-9]{{1,2}}{m}[0-9]{{1,2}}{m}[0-9]{{4}}" for m in ("-", "/", r"\."))
    date = rf"(?<![0-9./-])(?:{dates})(?![0-9]|[./-][0-9])"
    return "|".join(f"(?:{date if n == 'date' else PATTERNS[n]})" for n in names)


ANY = _any(*PATTERNS)
#: What is looked for in the rest of a candidate for a card or an account.
REST = _any("date", "social", "trunk", "phone")
LOOSE = _any("address", "date", "social", "card", "trunk", "phone")
#: Every candidate holds a match of this: two digits at most two separators apart, or a sign of the others.
HINT = r"[0-9][ .()/-]{0,2}[0-9]|@|AKIA|ASIA|[=:]"

YEARS = 200  # from 1900
_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def feistel(left: Column, right: Column, sizes: tuple, tweak: Column, key: str) -> Column:
    """A keyed permutation of the pairs left < sizes[0], right < sizes[1], as a struct l, r."""
    m_left, m_right = (F.lit(s).cast("long") if isinstance(s, int) else s for s in sizes)

    def noise(turn: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), other.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def step(state: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        moved = F.pmod(F.when(even, state["l"]).otherwise(state["r"]) + F.pmod(noise(turn, F.when(even, state["r"]).otherwise(state["l"])), F.when(even, m_left).otherwise(m_right)), F.when(even, m_left).otherwise(m_right))
        return F.struct(F.when(even, moved).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise(moved).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _into(text: Column, digits: Column) -> Column:
    """text with its digits replaced, in order, by those of ``digits``."""
    places = F.sequence(F.lit(1), F.length(text))

    def char(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(text, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(places, char), "")


def permute_digits(digits: Column, kind: str, key: str) -> Column:
    """A permutation of the strings of as many digits (2 to 30)."""
    size = F.length(digits)
    half = F.floor(size / 2).cast("int")
    pow10 = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    left, right = F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1, size).cast("long")
    out = feistel(left, right, (pow10(half), pow10(size - half)), F.concat(F.lit(kind), size.cast("string")), key)
    return _let(out, lambda o: F.concat(F.lpad(o["l"].cast("string"), half, "0"), F.lpad(o["r"].cast("string"), size - half, "0")))


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of digits, every second doubled; doubled_from_right is the place (from 0) of the first doubled one."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((size - i) % 2 == doubled_from_right, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add)


def _card(hit: Column, key: str) -> Column:
    digits = _digits(hit)

    def fresh(body: Column) -> Column:
        return F.concat(body, F.pmod(-_luhn_sum(body, 0), F.lit(10)).cast("string"))

    new = _let(permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key), fresh)
    return F.when(_is_card(digits), _let(new, lambda n: _into(hit, n))).otherwise(hit)


def _is_card(digits: Column) -> Column:
    return F.when(F.length(digits).between(13, 19), _luhn_sum(digits, 1) % 10 == 0).otherwise(F.lit(False))


def _cut(text: Column, pattern: str) -> Column:
    """text as an array: what matches, and what stands between."""
    found, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.flatten(F.transform(rest, lambda r, i: F.array(r, F.coalesce(F.get(found, i), F.lit("")))))


def _pieces(hit: Column) -> Column:
    """A candidate as an array of texts, each a candidate by itself or plain.

    One for a card that is no card whole is split at the valid cards in it, which begin and
    end where its numbers do; what remains is split at dates, social security and telephone
    numbers. One for an account is split after the
    longest valid account at its start.
    """
    return (
        F.when(_is(hit, "card") & ~_is_card(_digits(hit)), _split_numbers(hit))
        .when(_is(hit, "account"), _split_account(hit))
        .otherwise(F.array(hit))
    )


#: Of each number in a candidate, the longest text of 13 to 19 digits that begins there and ends where a number does.
_WINDOWS = r"(?=([0-9](?:[ -]?[0-9]){12,18}(?![0-9]))?)[0-9]+"


def _split_numbers(hit: Column) -> Column:
    """A candidate cut into valid cards, taken from the left and the shortest first, and what stands between."""
    none = F.array().cast("array<string>")
    of_length = lambda w, n: F.regexp_extract(w, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0)
    card_in = lambda w: F.get(F.filter(F.array(*(of_length(w, n) for n in range(13, 20))), lambda t: (t != "") & _is_card(_digits(t))), F.lit(0))
    windows = F.regexp_extract_all(hit, F.lit(_WINDOWS), F.lit(1))
    at = F.transform(windows, lambda w, i: F.struct((i + 1).alias("k"), F.when(w != "", card_in(w)).alias("t")))
    kind = "array<struct<k:int,t:string,n:int>>"
    start = F.struct(F.lit(1).alias("free"), F.array().cast(kind).alias("cards"))

    def choose(state: Column, c: Column) -> Column:
        def taken(n: Column) -> Column:
            return F.struct((c["k"] + n).alias("free"), F.concat(state["cards"], F.array(F.struct(c["k"].alias("k"), c["t"].alias("t"), n.alias("n"))).cast(kind)).alias("cards"))

        return F.when(c["k"] >= state["free"], _let(F.size(F.split(c["t"], "[ -]")), taken)).otherwise(state)

    chosen = F.aggregate(F.filter(at, lambda c: c["t"].isNotNull()), start, choose, lambda state: state["cards"])
    numbers, gaps = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0)), F.split(hit, "[0-9]+", -1)
    units = F.zip_with(numbers, F.slice(gaps, F.lit(2), F.size(numbers)), lambda a, b: F.struct(a.alias("number"), b.alias("gap")))

    def with_units(u: Column, cards: Column) -> Column:
        text = lambda a, b: F.array_join(F.transform(F.slice(u, a, b - a + 1), lambda x: F.concat(x["number"], x["gap"])), "")
        after = lambda i: F.coalesce(F.get(cards, i)["k"] + F.get(cards, i)["n"], F.lit(1))

        def lead(i: Column, upto: Column) -> Column:
            """What stands between card i (none if i < 0) and the number ``upto``."""
            first = F.when(i >= 0, after(i)).otherwise(F.lit(1))
            gap = F.when(i >= 0, F.get(u, first - 2)["gap"]).otherwise(F.lit(""))
            return _let(F.concat(gap, text(first, upto - 1)), lambda x: F.when(x != "", _cut(x, REST)).otherwise(none))

        return F.concat(F.flatten(F.transform(cards, lambda c, i: F.concat(lead(i - 1, c["k"]), F.array(c["t"])))), lead(F.size(cards) - 1, F.size(u) + 1))

    return _let(units, lambda u: _let(chosen, lambda cards: with_units(u, cards)))


def _remainder(text: Column) -> Column:
    """Remainder modulo 97 of an account number whose letters stand for 10 to 35."""

    def add(total: Column, c: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.pmod(total * F.when(value > 9, F.lit(100)).otherwise(F.lit(10)) + value, F.lit(97))

    return F.aggregate(F.regexp_extract_all(text, F.lit("."), F.lit(0)), F.lit(0), add)


def _is_account(text: Column) -> Column:
    bare = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 40), F.left(bare, F.lit(4)))
    return F.length(bare).between(15, 34) & (_remainder(moved) == 1)


def _split_account(hit: Column) -> Column:
    groups = F.split(hit, " ")
    text = lambda n: F.array_join(F.slice(groups, F.lit(1), n), " ")
    n = F.array_max(F.filter(F.sequence(F.lit(1), F.size(groups)), lambda k: _is_account(text(k))))

    def cut(n: Column) -> Column:
        rest = F.substr(hit, F.length(text(n)) + 1, F.length(hit))
        return F.when(n.isNull(), _cut(hit, LOOSE)).otherwise(F.concat(F.array(text(n)), _cut(rest, LOOSE)))

    return _let(n, cut)


def _account(hit: Column, key: str) -> Column:
    """Country and letters stay, the digits of the number are permuted, its check digits computed anew."""
    body = F.substr(hit, F.lit(5), F.length(hit))
    digits = _digits(body)
    new = _let(permute_digits(digits, "account", key), lambda d: _into(body, d))

    def written(n: Column) -> Column:
        moved = F.concat(F.replace(n, F.lit(" "), F.lit("")), F.left(hit, F.lit(2)), F.lit("00"))
        return F.concat(F.left(hit, F.lit(2)), F.lpad((F.lit(98) - _remainder(moved)).cast("string"), 2, "0"), n)

    return F.when(_is_account(hit) & (F.length(digits) >= 2), _let(new, written)).otherwise(hit)


def _social(hit: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999, permuted within these."""
    parts = F.transform(F.split(hit, "-"), lambda x: x.cast("long"))

    def renewed(p: Column) -> Column:
        area = p[0] - F.when(p[0] > 666, F.lit(2)).otherwise(F.lit(1))
        out = feistel(area, (p[1] - 1) * 9999 + p[2] - 1, (898, 99 * 9999), F.lit("social"), key)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return _let(out, lambda o: F.concat_ws("-", pad(o["l"] + F.when(o["l"] >= 665, F.lit(2)).otherwise(F.lit(1)), 3), pad(F.floor(o["r"] / 9999) + 1, 2), pad(o["r"] % 9999 + 1, 4)))

    valid = lambda p: p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
    return _let(parts, lambda p: F.when(valid(p), renewed(p)).otherwise(hit))


def _address(hit: Column, key: str) -> Column:
    octets = F.transform(F.split(hit, r"\."), lambda o: o.cast("long"))

    def renewed(o: Column) -> Column:
        out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), F.lit("address"), key)
        return _let(out, lambda x: F.concat_ws(".", *(F.floor(v).cast("string") for v in (x["l"] / 256, x["l"] % 256, x["r"] / 256, x["r"] % 256))))

    return _let(octets, lambda o: F.when(F.forall(o, lambda v: v < 256), renewed(o)).otherwise(hit))


def _days(months: range, days: range) -> Column:
    """The days of a common year in these ranges, as month * 100 + day."""
    return F.array(*(F.lit(m * 100 + d) for m in months for d in days if d <= _DAYS[m - 1]))


def _date(hit: Column, key: str) -> Column:
    """A date of 1900 to 2099 gets another one written in the same order and with as many digits.

    It is a permutation of the years and the days of a common year that can be so written;
    a 29 February becomes that of another leap year. A date whose day may come first is read
    so; the others, with a day above 12 in the second place, stay such.
    """
    fields = F.split(hit, r"[-/.]")
    mark = F.regexp_extract(hit, r"[-/.]", 0)
    year_first = F.length(fields[0]) == 4
    year_text, a, b = (F.when(year_first, fields[i]).otherwise(fields[j]) for i, j in ((0, 2), (1, 0), (2, 1)))
    year = year_text.cast("int")
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))

    def valid(m: Column, d: Column) -> Column:
        longest = F.coalesce(F.get(F.array(*map(F.lit, _DAYS)), m - 1), F.lit(0)) + F.when(leap & (m == 2), F.lit(1)).otherwise(F.lit(0))
        return m.between(1, 12) & (d >= 1) & (d <= longest)

    x, y = a.cast("int"), b.cast("int")
    day_first = ~year_first & valid(y, x)
    month, day = F.when(day_first, y).otherwise(x), F.when(day_first, x).otherwise(y)
    narrow_month, narrow_day = (F.length(F.when(day_first, q).otherwise(p)) == 1 for p, q in ((a, b), (b, a)))
    late = ~year_first & ~day_first  # the month comes first and the day is above 12
    one, two = range(1, 10), range(1, 13)
    days = (
        F.when(late & narrow_month, _days(one, range(13, 32)))
        .when(late, _days(two, range(13, 32)))
        .when(narrow_month & narrow_day, _days(one, one))
        .when(narrow_month, _days(one, range(1, 32)))
        .when(narrow_day, _days(two, one))
        .otherwise(_days(two, range(1, 32)))
    )

    def written(y: Column, m: Column, d: Column) -> Column:
        yy, mm, dd = y.cast("string"), F.when(narrow_month, m.cast("string")).otherwise(F.lpad(m.cast("string"), 2, "0")), F.when(narrow_day, d.cast("string")).otherwise(F.lpad(d.cast("string"), 2, "0"))
        return F.when(year_first, F.concat(yy, mark, mm, mark, dd)).when(day_first, F.concat(dd, mark, mm, mark, yy)).otherwise(F.concat(mm, mark, dd, mark, yy))

    shape = F.concat(F.lit("date"), F.when(year_first, "y").when(day_first, "d").otherwise("m"), narrow_month.cast("string"), narrow_day.cast("string"))

    def renewed(known: Column) -> Column:
        at = F.array_position(known, month * 100 + day) - 1
        out = feistel(year - 1900, at, (YEARS, F.size(known).cast("long")), shape, key)
        return _let(out, lambda o: _let(F.get(known, o["r"].cast("int")), lambda md: written(o["l"] + 1900, F.floor(md / 100), md % 100)))

    number = F.floor((year - 1904) / 4)  # of a leap year, of which there are 49
    leaping = feistel(F.floor(number / 7), number % 7, (7, 7), F.lit("leap"), key)
    leap_day = _let(leaping, lambda o: written(o["l"] * 28 + o["r"] * 4 + 1904, F.lit(2), F.lit(29)))
    known_year = year.between(1900, 1900 + YEARS - 1)
    is_date = known_year & (day_first | valid(x, y))
    return F.when(is_date & (month == 2) & (day == 29), leap_day).when(is_date, _let(days, renewed)).otherwise(hit)


def _phone(hit: Column, key: str) -> Column:
    """Area and exchange codes of 200 to 999 stay such, as do those below 200: the number is a pair of values in their ranges."""
    digits = _digits(hit)
    head, own = F.substr(digits, F.lit(1), F.length(digits) - 10), F.right(digits, F.lit(10))

    def renewed(d: Column) -> Column:
        area, exchange, line = (F.substr(d, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
        base = lambda code: F.when(code >= 200, F.lit(200)).otherwise(F.lit(0))
        size = lambda code: F.when(code >= 200, F.lit(80_000)).otherwise(F.lit(20_000)).cast("long")
        left, right = (area - base(area)) * 100 + F.floor(line / 100), (exchange - base(exchange)) * 100 + line % 100
        out = feistel(left, right, (size(area), size(exchange)), F.lit("phone"), key)
        code = lambda x, c: F.lpad((F.floor(x / 100) + base(c)).cast("string"), 3, "0")
        return _let(out, lambda o: F.concat(code(o["l"], area), code(o["r"], exchange), F.lpad((o["l"] % 100).cast("string"), 2, "0"), F.lpad((o["r"] % 100).cast("string"), 2, "0")))

    return _let(F.concat(head, _let(own, renewed)), lambda n: _into(hit, n))


def _abroad(hit: Column, key: str) -> Column:
    """Other telephone numbers of 8 to 15 digits: the first two stay, the others are permuted."""
    digits = _digits(hit)
    new = _let(F.concat(F.left(digits, F.lit(2)), permute_digits(F.substr(digits, F.lit(3), F.length(digits)), "abroad", key)), lambda n: _into(hit, n))
    return F.when(F.length(digits).between(8, 15), new).otherwise(hit)


def _digest(value: Column, kind: str, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 256)


def _secret(hit: Column, key: str) -> Column:
    """The value after the name, if it holds a digit, becomes as many characters of digests."""
    lead = F.regexp_extract(hit, r"^[A-Za-z_]+\s?[=:]\s?\"?", 0)
    value = F.substr(hit, F.length(lead) + 1, F.length(hit))
    blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int"))
    kind = lambda i: F.when(i == 0, "secret").otherwise(F.concat(F.lit("secret"), i.cast("string")))
    digest = lambda i: F.sha2(F.concat_ws("|", F.lit(key), kind(i), value), 256)
    return F.when(value.rlike("[0-9]"), F.concat(lead, F.left(F.array_join(F.transform(blocks, digest), ""), F.length(value)))).otherwise(hit)


def _is(hit: Column, name: str) -> Column:
    return hit.rlike(f"^(?:{PATTERNS[name]})$")


def pseudonym(hit: Column, key: str) -> Column:
    """The pseudonym of a candidate; what doesn't validate stays as it is."""
    email = F.concat(F.lit("user"), F.substring(_digest(F.lower(hit), "email", key), 1, 16), F.lit("@example.invalid"))
    access = F.concat(F.substring(hit, 1, 4), F.upper(F.translate(F.substring(_digest(hit, "key", key), 1, 16), "01", "GH")))
    return (
        F.when(_is(hit, "email"), email)
        .when(_is(hit, "key"), access)
        .when(_is(hit, "secret"), _secret(hit, key))
        .when(_is(hit, "account"), _account(hit, key))
        .when(_is(hit, "address"), _address(hit, key))
        .when(_is(hit, "date"), _date(hit, key))
        .when(_is(hit, "social"), _social(hit, key))
        .when(_is(hit, "card"), _card(hit, key))
        .when(_is(hit, "phone"), _phone(hit, key))
        .when(_is(hit, "world") | _is(hit, "trunk"), _abroad(hit, key))
        .otherwise(hit)
    )


_session_key = secrets.token_hex(16)


def key_of(spark: SparkSession) -> str:
    """The key in KEY_SETTING; where it is unset, one that holds for this driver's lifetime only."""
    return spark.conf.get(KEY_SETTING, None) or _session_key


def pseudonymise(docs: DataFrame, key: str, column: str = "text", count: str | None = "n_values") -> DataFrame:
    """``docs`` with personal data in ``column`` replaced, and ``count``: how many values were.

    All other columns are unchanged, but one named like ``count`` is replaced by it; without
    ``count`` none is added. A null text stays null with a count of 0, texts without personal
    data stay as they are; the same value has the same pseudonym in every row, so repeated
    rows stay alike; an empty table gives an empty result. Very long texts and values are
    taken whole. Whoever knows ``key`` can undo the permutations.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(f"`{column}`")
    hits = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    rest = F.split(text, ANY, -1)
    known = lambda h: F.transform(_pieces(h), lambda p: F.struct(p.alias("old"), pseudonym(p, key).alias("new")))
    plain = lambda r: F.array(F.struct(r.alias("old"), r.alias("new")))
    # Every text between candidates, each with the pieces of the candidate after it.
    pairs = F.concat(F.flatten(F.transform(hits, lambda h, i: F.concat(plain(F.get(rest, i)), known(h)))), plain(F.element_at(rest, -1)))
    searched = F.when(text.rlike(HINT), F.struct(F.size(hits).alias("n"), pairs.alias("pairs")))
    inside = "__found"
    while inside in docs.columns:
        inside += "_"
    found = docs.withColumn(inside, searched)
    f = F.col(inside)
    joined = F.array_join(F.transform(f["pairs"], lambda p: p["new"]), "")
    changed = F.coalesce(F.size(F.filter(f["pairs"], lambda p: p["old"] != p["new"])), F.lit(0)).cast("long")
    new = F.when(f.isNotNull() & (f["n"] > 0), joined).otherwise(text)
    columns = [(new if c == column else F.col(f"`{c}`")).alias(c) for c in docs.columns if c != count or c == column]
    counted = [F.when(f.isNotNull(), changed).otherwise(F.lit(0).cast("long")).alias(count)] if count else []
    return found.select(*columns, *counted)
