"""Personal data: format-preserving Feistel pseudonyms.

Card, phone and social security numbers, IPv4 addresses and dates are found by one expression, validated (check
digits, ranges, calendar) and permuted under a key within their format by an additive Feistel network over two
halves of their domain: a value of the format becomes another one, equal values become equal values in all documents,
and different values stay different. E-mail addresses become addresses of a keyed hash. What fails its validation
stays as it is.

Everything on the data is DataFrame operations; the key reaches the executors in the plan.

Nulls: a null text stays null, with counts of zero. Empty tables give an empty result; repeated rows are treated
alike. All columns of the input are kept; the names of the counts (n_email and so on) are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates are permuted within this many days from 1900-01-01 (to May 2100): 271 x 270.
FIRST_DAY, DAYS = "1900-01-01", (271, 270)

#: What each kind looks like (Java syntax). No part can be tried from inside a longer run of its characters.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_N = r"(?:[ .-]?\(?\d\)?){{{}}}(?!\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\d]|\.\d)",
    # countries of one length of number: so many digits and not the next number; others: groups; without a country code
    "phone": r"(?<![\w+])(?:\+(?:(?:4[57]|65)" + _N.format(8) + r"|(?:27|3[134]|4[018]|61|351|353|380)" + _N.format(9) + r"|(?:1|7|20|30|44|52|9[01])" + _N.format(10) + r"|86" + _N.format(11) + r")"
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\d])",
}
#: Runs of 13 digits or more, up to where another kind begins.
PATTERNS["card"] = r"(?<![\d-])(?=\d(?:[ -]?\d){12})\d++(?:[ -](?!" + "|".join(PATTERNS[k] for k in ("date", "ssn", "ip", "phone")) + r")\d++)*+"
#: What is looked for in a run: cards as they are written, at each border of groups; if there is none, any grouping of the run itself.
CARDS = [r"\d{13,19}(?!\d)", r"\d{4}(?:[ -]\d{4}){3}(?!\d)", r"\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)", r"\d{4}(?:[ -]\d{4}){2,3}[ -]\d{1,3}(?!\d)"]
ANY_CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
KINDS = list(PATTERNS)


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: str, key: str) -> Column:
    """A keyed permutation of (left in 0..a-1, right in 0..b-1), as a struct l, r: in turn each half is shifted by a hash of the other."""

    def shift(i: Column, other: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), a, b, i, other), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda s, i: F.when(i % 2 == 0, F.struct(((s["l"] + shift(i, s["r"], a)) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + shift(i, s["l"], b)) % b).alias("r"))),
    )


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(11)]), n + 1)


def permuted_digits(digits: Column, tweak: str, key: str) -> Column:
    """The digits permuted among all strings of as many digits (2 to 20)."""
    n, half = F.length(digits), F.floor(F.length(digits) / 2).cast("int")
    rest = n - half
    out = feistel(F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, rest).cast("long"), _power(half), _power(rest), tweak, key)
    joined = lambda x: F.concat(F.lpad(x["l"].cast("string"), half, F.lit("0")), F.lpad(x["r"].cast("string"), rest, F.lit("0")))
    return F.element_at(F.transform(F.array(out), joined), 1)


def luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 for valid numbers."""
    def part(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d >= 5, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + part(i))


def _refilled(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in order; all else stays."""
    return F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )


def _let(value: Column, use) -> Column:
    """use(value), value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _one_card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
        return _refilled(m, _let(body, lambda p: F.concat(p, ((10 - luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))))

    return _let(_digits(m), made)


def _valid(m: Column) -> Column:
    return F.when(F.length(m) > 0, F.when(luhn(_digits(m)) % 10 == 0, m))


def _card(m: Column, key: str) -> Column:
    """(value, n): the run with its n cards replaced, from left to right; null without one."""
    text = lambda a, b: F.substring(m, a, b - a)
    end = F.length(m) + 1
    borders = F.filter(F.sequence(F.lit(1), F.length(m)), lambda p: F.substring(m, p, F.lit(1)).between("0", "9") & ((p == 1) | ~F.substring(m, p - 1, F.lit(1)).between("0", "9")))

    def step(s: Column, p: Column) -> Column:
        def found(c: Column) -> Column:
            kept = F.struct(F.concat(s["out"], text(s["at"], p), _one_card(c, key)).alias("out"), (p + F.length(c)).alias("at"), (s["n"] + 1).alias("n"))
            return F.when(c.isNotNull(), kept).otherwise(s)

        first = _let(F.substring(m, p, end - p), lambda rest: F.coalesce(*[_valid(F.regexp_extract(rest, f"^(?:{c})", 0)) for c in CARDS]))
        return F.when(p < s["at"], s).otherwise(_let(first, found))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), F.lit(0).alias("n"))
    strict = F.aggregate(borders, start, step, lambda s: F.struct(F.when(s["n"] > 0, F.concat(s["out"], text(s["at"], end))).alias("value"), s["n"].alias("n")))
    whole = F.transform(F.regexp_extract_all(m, F.lit(ANY_CARD), F.lit(0)), lambda x: F.struct(x.alias("x"), F.when(luhn(_digits(x)) % 10 == 0, _one_card(x, key)).alias("y")))

    def loose(found: Column) -> Column:
        n = F.size(F.filter(found, lambda x: x["y"].isNotNull()))
        pieces = F.zip_with(F.split(m, ANY_CARD, -1), found, lambda gap, x: F.concat(gap, F.coalesce(x["y"], x["x"], F.lit(""))))
        return F.struct(F.when(n > 0, F.array_join(pieces, "")).alias("value"), n.alias("n"))

    any_strict = m.rlike(r"(?<!\d)(?:" + "|".join(CARDS) + ")")
    tried = F.when(any_strict, strict).otherwise(F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).alias("n")))
    return _let(tried, lambda t: F.when(t["n"] > 0, t).otherwise(_let(whole, loose)))


def _phone(m: Column, key: str) -> Column:
    """8 to 15 digits, of which the last ten at most are permuted: equal numbers agree with and without a country code."""

    def made(d: Column) -> Column:
        n = F.length(d)
        k = F.least(F.lit(10), n - F.when(F.startswith(m, F.lit("+")), 1).otherwise(0))
        return F.when(n.between(8, 15), _refilled(m, F.concat(F.substring(d, F.lit(1), n - k), permuted_digits(F.substring(d, n - k + 1, k), "phone", key))))

    return _let(_digits(m), made)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001: 898 x 99 and 9999 values."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), "ssn", key)

    def shown(x: Column) -> Column:
        p = F.floor(x["l"] / 99)
        a = F.when(p + 1 >= 666, p + 2).otherwise(p + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

    return F.when((area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1), _let(out, shown))


def _ip(m: Column, key: str) -> Column:
    p = F.split(m, r"\.")
    n = [F.element_at(p, k).cast("long") for k in (1, 2, 3, 4)]
    size = F.lit(65536).cast("long")
    out = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], size, size, "ip", key)
    parts = lambda x: F.concat_ws(".", F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)
    return _let(out, parts)


def _date(m: Column, key: str) -> Column:
    """Year-month-day, month/day/year or day.month.year; a date moves alike in all of them."""
    styles = [(r"^(\d{4})-(\d{2})-(\d{2})$", "$1-$2-$3", "yyyy-MM-dd"), (r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2", "MM/dd/yyyy"), (r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1", "dd.MM.yyyy")]
    size = [F.lit(n).cast("long") for n in DAYS]
    first = F.lit(FIRST_DAY).cast("date")

    def moved(style: str):
        def of(d: Column) -> Column:
            day = F.datediff(d, first).cast("long")
            other = feistel(F.floor(day / DAYS[1]), day % DAYS[1], size[0], size[1], "date", key)
            shown = _let(other, lambda x: F.date_format(F.date_add(first, (x["l"] * DAYS[1] + x["r"]).cast("int")), style))
            return F.when(d.isNotNull() & (day >= 0) & (day < DAYS[0] * DAYS[1]), shown)

        return of

    out = F.lit(None).cast("string")
    for shape, read, style in styles:
        out = F.when(m.rlike(shape), _let(F.regexp_replace(m, shape, read).try_cast("date"), moved(style))).otherwise(out)
    return out


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.org"))


def _more(kind: str):
    return lambda n, x: n + F.when(x["kind"] == kind, x["n"]).otherwise(0)


MAKERS = {"email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def pseudonymised(docs: DataFrame, key: str, *, text_col: str = "text", kinds: list[str] = KINDS) -> DataFrame:
    """docs with the personal data of the text replaced, and the number of values replaced of each kind (n_email, ...)."""
    text, every = F.col(text_col), "|".join(f"(?:{PATTERNS[k]})" for k in kinds)
    counted = "array<struct<kind: string, value: string, n: int>>"

    def replaced(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        made = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).alias("n"))
        for k in reversed(kinds):
            alone = m.rlike(rf"\A(?:{PATTERNS[k]})\z")
            one = MAKERS[k](m, key) if k == "card" else _let(MAKERS[k](m, key), lambda v: F.struct(v.alias("value"), v.isNotNull().cast("int").alias("n")))
            kind, made = F.when(alone, F.lit(k)).otherwise(kind), F.when(alone, one).otherwise(made)
        return _let(made, lambda x: F.struct(kind.alias("kind"), x["value"].alias("value"), x["n"].alias("n")))

    found = F.regexp_extract_all(text, F.lit(every), F.lit(0))
    hit = F.coalesce(text.rlike(every), F.lit(False))
    met = docs.withColumn("_pii_found", F.when(hit, found).otherwise(F.array().cast("array<string>")))
    met = met.withColumn("_pii_made", F.transform("_pii_found", replaced).cast(counted))
    pieces = F.zip_with(F.split(text, every, -1), F.zip_with("_pii_found", "_pii_made", lambda m, x: F.coalesce(x["value"], m)), lambda gap, v: F.concat(gap, F.coalesce(v, F.lit(""))))
    met = met.withColumn(text_col, F.when(F.size("_pii_found") > 0, F.array_join(pieces, "")).otherwise(text))
    counts = {f"n_{k}": F.aggregate("_pii_made", F.lit(0).cast("long"), _more(k)) for k in kinds}
    return met.withColumns(counts).drop("_pii_found", "_pii_made")
