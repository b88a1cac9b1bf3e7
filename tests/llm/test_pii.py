import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii
from tests.llm.helpers import documents, frame

TEXTS = [
    "card 4614953556326981, again 4614-9535-5632-6981 and bad 4614953556326982.",
    "call +1 (643) 555-5742 or (643) 555-5742 or 643-555-5742; not 12643-555-57421",
    "ssn 123-45-6789 and 000-45-6789, 666-12-1234, 900-12-1234; ip 106.158.249.239 and 256.1.1.1 or 1.2.3.4.5",
    "born 1984-02-29, 02/29/1984, 29.02.1984, but 1983-02-29 and 2984-01-01 are none",
    "mail Ann.Lee+x@mail3.example.com twice ann.lee+x@mail3.example.com, a@b, @c.d",
    "1234 12 3.14 v1.2.3 2020 " + "a" * 60_000 + " " + "1" * 60_000,
    None,
    "",
    "dial +44 20 7946 0958, +33 1 23 45 67 89, +14155551234 or +12",
]


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, value int, kind string")
    return {r["doc_id"]: r for r in pii.pseudonymised(df, "k").collect()}


def luhn_ok(d):
    x = [int(c) for c in d][::-1]
    return (sum(x[::2]) + sum(sum(divmod(2 * v, 10)) for v in x[1::2])) % 10 == 0


def test_each_kind_keeps_its_format_and_links(spark):
    got = run(spark, TEXTS)
    a, b, bad = re.match(r"card (\d{16}), again ([\d-]{19}) and bad (\d{16})\.$", got[0]["text"]).groups()
    assert luhn_ok(a) and a == b.replace("-", "") != "4614953556326981" and bad == "4614953556326982" and got[0]["n_card"] == 2
    a, b, c = re.match(r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}); not 12643-555-57421$", got[1]["text"]).groups()
    assert a == b != "(643) 555-5742" and re.sub(r"\D", "", b) == re.sub(r"\D", "", c)
    s = re.match(r"ssn (\d{3}-\d{2}-\d{4}) and 000-45-6789, 666-12-1234, 900-12-1234; ip (\d+\.\d+\.\d+\.\d+) and 256.1.1.1 or 1.2.3.4.5$", got[2]["text"])
    assert s and s[1] != "123-45-6789" and s[2] != "106.158.249.239" and all(int(x) < 256 for x in s[2].split("."))
    d = re.match(r"born (\d{4}-\d\d-\d\d), (\d\d/\d\d/\d{4}), (\d\d\.\d\d\.\d{4}), but 1983-02-29 and 2984-01-01 are none$", got[3]["text"])
    days = [datetime.datetime.strptime(x, f).date() for x, f in zip(d.groups(), ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y"), strict=True)]
    assert len(set(days)) == 1 and days[0] != datetime.date(1984, 2, 29) and got[3]["n_date"] == 3
    e = re.match(r"mail (u[0-9a-f]{16}@example.org) twice (u[0-9a-f]{16}@example.org), a@b, @c.d$", got[4]["text"])
    assert e[1] == e[2] and got[4]["n_email"] == 2
    a, b, c = re.match(r"dial \+(44 \d\d \d{4} \d{4}), \+(3\d \d(?: \d\d){4}), \+(1\d{10}) or \+12$", got[8]["text"]).groups()
    assert a != "44 20 7946 0958" and b != "33 1 23 45 67 89" and c != "14155551234" and got[8]["n_phone"] == 3
    assert got[5]["text"] == TEXTS[5] and got[6]["text"] is None and got[7]["text"] == "" and got[6]["n_card"] == 0


def test_permutations_are_one_to_one(spark):
    n = 20_000
    df = spark.range(n).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("d"))
    got = df.select(pii.permuted_digits(F.col("d"), "t", "k").alias("p"), pii.permuted_digits(F.col("d"), "t", "other").alias("q")).toPandas()
    assert got["p"].nunique() == got["q"].nunique() == n and (got["p"].str.len() == 5).all() and (got["p"] == got["q"]).mean() < 0.01
    all_ = spark.range(100 * 100).select(pii.feistel(F.floor(F.col("id") / 100), F.col("id") % 100, F.lit(100).cast("long"), F.lit(100).cast("long"), "t", "k").alias("x")).select("x.l", "x.r").distinct().count()
    assert all_ == 10_000
    dates = spark.range(pii.DAYS[0] * pii.DAYS[1]).select(F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d")).filter("hash(d) % 20 = 0")
    moved = dates.select(pii._date(F.col("d"), "k").alias("m"))
    assert moved.filter("m is null").count() == 0 and moved.distinct().count() == dates.count()


def test_clean_texts_stay(spark):
    df = frame(spark)
    got = pii.pseudonymised(df, "k")
    assert got.columns[: len(df.columns)] == df.columns and got.count() == len(documents())
    assert sorted(str(r["text"]) for r in got.collect()) == sorted(str(r[1]) for r in documents())
    assert pii.pseudonymised(frame(spark, []), "k").count() == 0


def test_no_planted_value_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, after = ({r["doc_id"]: r["text"] for r in x.select("doc_id", "text").collect()} for x in (docs, pii.pseudonymised(docs, "k")))
    for pattern in (r"\b\d{16}\b", r"\+1 \(\d{3}\) 555-\d{4}", r"\S+@mail\d\.example\.com", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"):
        for k, t in before.items():
            for v in re.findall(pattern, t):
                if pattern != r"\b\d{16}\b" or luhn_ok(v):
                    assert v not in after[k], v


def test_addresses_at_the_end_of_a_sentence(spark):
    texts = ["Write to bob@example.com. Next", "bob@example.com.", "(bob@mail.example.co.uk.)", "bob@example.com.5 or bob@example.com.-"]
    got = run(spark, texts)
    assert [re.sub(r"u[0-9a-f]{16}@example\.org", "U", got[k]["text"]) for k in range(4)] == ["Write to U. Next", "U.", "(U.)", "U.5 or U.-"]
    assert [got[k]["n_email"] for k in range(4)] == [1, 1, 1, 2]


def test_numbers_beside_cards_and_phones(spark):
    card, spaced, phone = "4614953556326981", "4614 9535 5632 6981", "+1 (643) 555-5742"
    texts = [card, f"{card} 123", f"{spaced} 12", f"{card} 12/25", f"2 {card}", f"1234 {spaced} 9", f"{card} {card}", f"{card} 643-555-5742", f"7 {card}-1", phone, f"{phone} 20 people", f"20 {phone} 4000", "(643)555-5742", "+33 1 23 45 67 89", "+33 1 23 45 67 89 20"]
    got = run(spark, texts)
    new = got[0]["text"]
    shown = re.sub(r"(.{4})(?=.)", r"\1 ", new)
    assert luhn_ok(new) and new != card
    moved = re.search(r"\(643\)|\(\d{3}\)", got[9]["text"])[0] + got[9]["text"][8:]
    want = [new, f"{new} 123", f"{shown} 12", f"{new} 12/25", f"2 {new}", f"1234 {shown} 9", f"{new} {new}", f"{new} " + moved[1:4] + "-" + moved[6:], f"7 {new}-1", got[9]["text"], f"{got[9]['text']} 20 people", f"20 {got[9]['text']} 4000", moved.replace(" ", ""), got[13]["text"], got[13]["text"] + " 20"]
    assert [got[k]["text"] for k in range(len(texts))] == want
    assert got[6]["n_card"] == 2 and got[7]["n_card"] == got[7]["n_phone"] == 1 and got[13]["text"] != texts[13]


# a pseudonymiser in plain Python, over the same formats

KEY = "k"


def feistel(left, right, a, b, tweak):
    for i in range(pii.ROUNDS):
        other, size = (right, a) if i % 2 == 0 else (left, b)
        digest = hashlib.sha256("|".join(map(str, (KEY, tweak, a, b, i, other))).encode()).hexdigest()
        shift = int(digest[:15], 16) % size
        left, right = ((left + shift) % a, right) if i % 2 == 0 else (left, (right + shift) % b)
    return left, right


def permuted(digits, tweak):
    half = len(digits) // 2
    left, right = feistel(int(digits[:half]), int(digits[half:]), 10**half, 10 ** (len(digits) - half), tweak)
    return f"{left:0{half}d}{right:0{len(digits) - half}d}"


def refilled(shape, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in shape)


def plain_card(m):
    def one(c):
        body = permuted(re.sub("[^0-9]", "", c)[:-1], "card")
        return refilled(c, body + next(x for x in "0123456789" if luhn_ok(body + x)))

    ok = lambda c: luhn_ok(re.sub("[^0-9]", "", c))
    out, at, n = "", 0, 0
    for p in [i for i, c in enumerate(m) if c.isdigit() and (i == 0 or not m[i - 1].isdigit())]:
        if p >= at:
            got = next((x[0] for c in pii.CARDS if (x := re.match(c, m[p:], re.ASCII)) and ok(x[0])), None)
            if got:
                out, at, n = out + m[at:p] + one(got), p + len(got), n + 1
    if n:
        return out + m[at:], n
    n = sum(ok(x[0]) for x in re.finditer(pii.ANY_CARD, m, re.ASCII))
    return re.sub(pii.ANY_CARD, lambda x: one(x[0]) if ok(x[0]) else x[0], m, flags=re.ASCII), n


def plain_value(kind, m):
    """The pseudonym and how many values it holds; none: (m, 0)."""
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        return plain_card(m)
    if kind == "email":
        return "u" + hashlib.sha256(f"{KEY}|email|{m.lower()}".encode()).hexdigest()[:16] + "@example.org", 1
    if kind == "phone":
        k = min(10, len(d) - m.startswith("+"))
        return (refilled(m, d[: len(d) - k] + permuted(d[len(d) - k :], "phone")), 1) if 8 <= len(d) <= 15 else (m, 0)
    if kind == "ssn":
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return m, 0
        left, right = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        area = left // 99 + 1
        return f"{area + (area >= 666):03d}-{left % 99 + 1:02d}-{right + 1:04d}", 1
    if kind == "ip":
        a, b, c, e = map(int, m.split("."))
        left, right = feistel(a * 256 + b, c * 256 + e, 65536, 65536, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}", 1
    style = "%m/%d/%Y" if "/" in m else "%d.%m.%Y" if "." in m else "%Y-%m-%d"
    first = datetime.date.fromisoformat(pii.FIRST_DAY)
    try:
        day = (datetime.datetime.strptime(m, style).date() - first).days
    except ValueError:
        return m, 0
    if not 0 <= day < pii.DAYS[0] * pii.DAYS[1]:
        return m, 0
    left, right = feistel(day // pii.DAYS[1], day % pii.DAYS[1], *pii.DAYS, "date")
    return (first + datetime.timedelta(left * pii.DAYS[1] + right)).strftime(style), 1


def plain(text):
    counts = dict.fromkeys(pii.KINDS, 0)

    def made(x):
        kind = next((k for k in pii.KINDS if re.fullmatch(pii.PATTERNS[k], x[0], re.ASCII)), None)
        out, n = plain_value(kind, x[0]) if kind else (x[0], 0)
        if kind:
            counts[kind] += n
        return out

    return re.sub("|".join(f"(?:{pii.PATTERNS[k]})" for k in pii.KINDS), made, text or "", flags=re.ASCII), counts


def test_whole_texts_as_by_plain_python(spark):
    rng = random.Random(6)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = rng.choice("3456") + number(14)
        d = body + next(x for x in "0123456789" if luhn_ok(body + x))
        return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    makers = [
        card, lambda: number(rng.randint(1, 20)), lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: f"{rng.randint(1890, 2110)}-{rng.randint(1, 13):02d}-{rng.randint(1, 31):02d}", lambda: f"{rng.randint(1, 12):02d}/{rng.randint(1, 31):02d}/{rng.randint(1900, 2099)}", lambda: f"a.b{number(2)}@mail.example.com", lambda: "word", lambda: "é𝔘",
    ]
    texts = [*TEXTS, *["".join(rng.choice(makers)() + rng.choice([" ", " ", ", ", ". ", "\n", "/", "-", ""]) for _ in range(rng.randint(1, 30))) for _ in range(300)]]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        want, counts = plain(t)
        assert (got[i]["text"] or "") == want, t
        assert {k: got[i][f"n_{k}"] for k in pii.KINDS} == counts, t
