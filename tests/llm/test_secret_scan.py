import hashlib
import random
import re
import time
from collections import Counter
from itertools import accumulate

from pyspark.sql import functions as F

from tessera.llm import queries, secret_scan
from tests.llm.helpers import documents, frame


def brute(text, rules):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if m.end(r.group) - m.start(r.group) >= r.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_spans_as_by_brute_force(spark):
    got = secret_scan.scan(frame(spark).select("doc_id", "text"), out="found").collect()
    assert len(got) == len(documents())
    for r in got:
        assert [tuple(x) for x in r["found"]] == brute(r["text"], secret_scan.RULES), r["text"]
    assert sum(len(r["found"]) for r in got) >= 9


def test_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in secret_scan.scan(docs).collect():
        assert [tuple(x) for x in r["spans"]] == brute(r["text"], secret_scan.RULES)
    assert queries.op2_secrets(spark, "/root/testdata/sf0.001").count() == docs.count()


#: As the contract has them.
CONTRACT = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def test_the_query_as_the_contract_says(spark, tmp_path):
    rows = [*documents(), (7001, "x " * 30 + "SECRET = 'abcdef' tokens: abcdefg " + "0123456789abcdef" * 2 + " AKIA" + "Z" * 16, None, None, 0, 0, "s", "k", "f", "p")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), "/root/testdata/sf0.001"):
        docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        want = []
        for i, t in docs:
            found = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(CONTRACT) for m in p.finditer(t or "") if m.end(g) - m.start(g) >= least)
            shown = ",".join(f"{CONTRACT[k][0]}:{a}:{b}" for a, k, b in found)
            want.append((i, *[sum(k == x for _, x, _ in found) for k in range(3)], hashlib.sha256(shown.encode()).hexdigest()))
        got = queries.op2_secrets(spark, d).collect()
        assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == Counter(want)
        assert all(set(re.findall(r"(?:assign|access|hex):\d+:\d+", r["spans"])) <= set(r["spans"].split(",")) for r in got)


def test_a_long_text_with_many_secrets(spark):
    rng = random.Random(2)
    text = "".join(f"é𝔘 {'x' * rng.randint(0, 9)} token={rng.randrange(16**8):08x}" + ("AKIA" + "B" * 16) * (k % 7 == 0) for k in range(20_000)) + " end"
    df = spark.createDataFrame([(1, text), (2, text[: 1 << 16])], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in secret_scan.redacted(df).collect()}
    assert time.time() - began < 60
    for k, t in ((1, text), (2, text[: 1 << 16])):
        out, top = [], 0
        for a, _, b in brute(t, secret_scan.RULES):
            if a >= top:
                out += [t[top:a], "[SECRET]"]
            top = max(top, b)
        assert got[k] == "".join(out) + t[top:]


def test_running(spark):
    for n in (0, 1, 63, 64, 65, 129, 1000):
        values = [(k * 37) % 101 for k in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        got = df.select(secret_scan.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), secret_scan.running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(0)).alias("m")).first()
        assert got["s"] == list(accumulate(values)) and got["m"] == list(accumulate(values, max))


def test_a_column_of_the_outputs_name_is_replaced(spark):
    df = frame(spark)
    got = secret_scan.scan(df, out="spans")
    assert "spans" in df.columns and sorted(got.columns) == sorted(df.columns) and dict(got.dtypes)["spans"].startswith("array")


def test_queries_hold_for_matches():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == secret_scan.ANY
    assert secret_scan.trigram_query("ab?cde") == {frozenset({"abc", "bcd", "cde"}), frozenset({"acd", "cde"})}
    assert secret_scan.trigram_query("foo.*(bar|bazz)") == {frozenset({"foo", "bar"}), frozenset({"foo", "baz", "azz"})}
    assert secret_scan.trigram_query("(ab|xyz)") == secret_scan.ANY
    assign = secret_scan.trigram_query(secret_scan.RULES[0].pattern)
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        held = {word[i : i + 3] for i in range(len(word) - 2)}
        assert any(a <= held for a in assign)


def test_redacted(spark):
    df = frame(spark)
    got = secret_scan.redacted(df)
    assert got.columns == df.columns and got.count() == df.count()
    for r in got.collect():
        assert not brute(r["text"], secret_scan.RULES)
    clean = {r[0]: r[1] for r in documents() if not brute(r[1], secret_scan.RULES)}
    assert all(clean[r["doc_id"]] == r["text"] for r in got.collect() if r["doc_id"] in clean and r["doc_id"] != 45)
    assert secret_scan.redacted(frame(spark, [])).count() == 0
