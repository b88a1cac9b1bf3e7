import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline as P
from tessera.llm import packing, secret_scan
from tests.llm.helpers import words
from tests.llm.test_mixing import targets
from tests.llm.test_packing import whole
from tests.llm.test_secret_scan import brute

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, at = [spark.read.parquet(f"{D}/documents.parquet")], tmp_path_factory.mktemp("stages")
    for name, stage in P.STAGES:
        stage(spark, out[-1], D).write.parquet(str(at / name))
        out.append(spark.read.parquet(str(at / name)))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(text):
    w = words(text.encode().lower().decode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_return_documents(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language_keeps_all_with_letters(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert set(after) == {k for k, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
    assert all(after[k]["text"] == before[k]["text"] for k in after)


def test_dedup_against_brute_force(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    sets = {k: shingles(r["text"]) for k, r in before.items()}
    ids = sorted(before)
    close = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[:i] if sets[a] & sets[b]}
    sure = [p for p, j in close.items() if j >= 0.8]
    assert sure and not [p for p in sure if p[0] in after and p[1] in after]
    assert set(before) - set(after) <= {k for p in sure for k in p}  # whatever is gone has a near copy
    group = {k: k for k in before}
    find = lambda k: k if group[k] == k else find(group[k])
    for x, y in sure:
        group[max(find(x), find(y))] = min(find(x), find(y))
    assert set(after) == {k for k in before if find(k) == k}  # one of each group, the least id
    assert all(r["text"] == before[k]["text"] for k, r in after.items())


def test_no_secret_is_left_and_clean_texts_stay(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    assert set(before) == set(after)
    for k, r in after.items():
        if brute(before[k]["text"], secret_scan.RULES):
            assert not brute(r["text"], secret_scan.RULES) and "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert r == before[k]


def test_mix_is_near_its_targets(stages):
    before, got = by_id(stages[3]), stages[4].collect()
    counts = Counter(r["doc_id"] for r in got)
    assert max(counts.values()) <= 2 and all(r["text"] == before[r["doc_id"]]["text"] for r in got)
    size, taken = Counter(), Counter()
    longest = Counter()
    for r in before.values():
        n = len(words(r["text"]))
        size[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in got:
        taken[r["source"]] += len(words(r["text"]))
    assert all(abs(taken[s] - t) <= longest[s] for s, t in targets(size).items())


def test_pack_holds_all_of_the_mix(stages):
    rows = stages[5].collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in stages[4].collect())
    assert whole(rows) <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1


def test_run_and_registration(spark, stages):
    assert __spark_entry__.queries()["pipeline"] is P.run and P.ORACLE_SQL is None
    assert P.run(spark, D).count() == stages[5].count()


def test_an_empty_table_and_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "", "en", "a", 0), (2, " \n", None, "a", 2), (3, "one two three", None, None, 13), (3, "one two three", None, None, 13), (None, "four five", "en", "a", 9)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, D)
        assert docs.count() >= (1 if rows else 0)
    assert re.match("long|bigint", dict(docs.dtypes)["doc_id"])
