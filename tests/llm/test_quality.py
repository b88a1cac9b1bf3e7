from collections import Counter

import numpy as np

from tessera.llm import quality, queries
from tests.llm.helpers import documents, frame, words


def brute(text):
    t = text or ""
    w = words(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if words(x)]
    return [len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def test_figures_as_by_brute_force(spark):
    extra = ["a b c a b c", "a b c d\na b c", "x x x x", "a b\na b\n\n \na b ", "#*$ %&|<> é𝔘", "one two", "é é é é"]
    rows = [*documents(), *[(5000 + i, t, None, None, 0, 0, "s", "k", "f", "p") for i, t in enumerate(extra)]]
    got = quality.judge(frame(spark, rows)).collect()
    have = sorted((-1 if r["id"] is None else r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    assert have == sorted((-1 if r[0] is None else r[0], *brute(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(frame(spark, [])).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    bad = rng.random(20_000) < 0.2
    votes = np.stack([np.where(rng.random(20_000) < 0.1, 0, np.where(bad ^ (rng.random(20_000) < 0.04 * k), 2, 1)) for k in range(1, 6)], axis=1)
    seen, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(seen, counts.astype(float))
    assert abs(model["prior_bad"] - 0.2) < 0.02
    assert np.abs(model["accuracy"] - [1 - 0.04 * k for k in range(1, 6)]).max() < 0.03
    # EM itself, step by step over single documents
    p = model["bad_votes"]
    odds = [(1 - model["prior_bad"]) * np.prod(np.where(v == 0, 1, np.where(v == 2, p[0], 1 - p[0]))) for v in seen]
    other = [model["prior_bad"] * np.prod(np.where(v == 0, 1, np.where(v == 2, p[1], 1 - p[1]))) for v in seen]
    assert np.abs(np.array(odds) / (np.array(odds) + other) - model["good"]).max() < 1e-6


def test_keeps_good_and_drops_bad(spark):
    d = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    passed = [r for r in queries.op10_quality(spark, d).collect() if not r["base_failed"]]
    got = [r for r in passed if r["doc_id"] in truth]
    assert np.mean([r["kept"] for r in got if truth[r["doc_id"]] == 1]) >= 0.99
    assert np.mean([r["kept"] for r in got if truth[r["doc_id"]] == 0]) <= 0.01
    # not all must pass: most single bad votes are overruled, three are not
    one, three = ([r["kept"] for r in passed if r["n_bad_votes"] == n] for n in (1, 3))
    assert len(one) > 100 and np.mean(one) > 0.9 and len(three) > 100 and not any(three)
    assert all(r["kept"] == (r["posterior"] >= 0.5) for r in passed)


def test_clean_tables_stay_whole(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join("".join(rng.choice(list("aeiourstnl"), rng.integers(2, 9))) for _ in range(n))
    rows = [(k, say(int(rng.integers(60, 400)))) for k in range(400)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert np.mean([r["kept"] for r in got]) >= 0.99
