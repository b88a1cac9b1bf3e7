import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import mixing, queries
from tests.llm.helpers import documents, frame, words


def test_water_fill_stops_at_twice_the_size():
    assert mixing.water_fill([10, 100], [5, 1], 165, 2) == [20, 145]
    assert mixing.water_fill([0, 0], [5, 1], 0, 2) == [0, 0]


def test_schedule_gives_each_source_its_quota_evenly(spark):
    quotas = [5, 0, 90, 33]
    got = mixing.schedule(spark, quotas).toPandas()
    assert got.groupby("src").size().to_dict() == {0: 5, 2: 90, 3: 33}
    for s, part in got.sort_values("time").groupby("src"):
        assert part["rank"].tolist() == list(range(quotas[s]))
    order = got.sort_values("time")["src"].to_numpy()
    for at in range(8, len(order), 8):  # every prefix is mixed nearly as the whole
        assert abs((order[:at] == 2).sum() - at * 90 / 128) < 5
    assert sorted(mixing.van_der_corput(np.arange(16), 4)) == list(range(16))


def targets(size):
    """As the contract says it, in fractions: whoever is above twice its size stops there, the rest is shared again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    total, capped = Fraction(3, 2) * sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped and size[s]]
        left, sum_ = total - sum(2 * size[s] for s in capped), sum(weight[s] for s in free)
        share = {s: 2 * size[s] if s in capped or not size[s] else left * weight[s] / sum_ for s in names}
        above = {s for s in free if share[s] > 2 * size[s]}
        if not above:
            return {s: float(share[s]) for s in names}
        capped |= above


def test_takes_near_targets_and_reruns_agree(spark):
    df = frame(spark)
    got = mixing.mix(df, weight_of=mixing.cycle_521, block_tokens=64).collect()
    again = mixing.mix(df.repartition(7), weight_of=mixing.cycle_521, block_tokens=64).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    rows, sizes = documents(), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in rows)
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["passes"]) for r in got)
    for s, t in targets(sizes).items():
        part = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - t) < 1e-6 for r in part)
        assert abs(sum(r["taken"] for r in part) - t) <= 1


def test_the_query_on_the_small_table(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op1_mix(spark, d).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in docs.values():
        size[r["source"]] += len(words(r["text"]))
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    want = targets(size)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        taken[s] += r["taken"]
        assert r["size"] == len(words(docs[r["doc_id"]]["text"])) and r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 and r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())


def test_every_prefix_of_the_mix_is_near_the_weights(spark):
    rng, rows = random.Random(4), []
    for s, n in (("a", 900), ("b", 500), ("c", 2400), (None, 300)):
        rows += [(len(rows) + k, " ".join(["w"] * rng.randint(20, 200)), s) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weight_of=mixing.cycle_521, block_tokens=256).collect()
    comes = sorted((p["slot"], r["source"] or "", p["words"]) for r in got for p in r["passes"] if p["words"])
    goal = {r["source"] or "": r["target"] for r in got}
    whole, seen = sum(goal.values()), Counter()
    for k, (_, s, n) in enumerate(comes):
        seen[s] += n
        if k > 200 and k % 50 == 0:  # blocks and documents are cut at different places: a few of each
            assert all(abs(seen[x] - goal[x] / whole * sum(seen.values())) < 1500 + 0.02 * sum(seen.values()) for x in goal)
    # and so the rows of the mix themselves, in the order of their partitions
    laid = mixing.mixed_documents(df, block_tokens=256).select("source", F.size(F.split("text", " ")).alias("n")).collect()
    seen = Counter()
    for k, r in enumerate(laid):
        seen[r["source"] or ""] += r["n"]
        if k > 200 and k % 50 == 0:
            assert all(abs(seen[x] - goal[x] / whole * sum(seen.values())) < 1500 + 0.03 * sum(seen.values()) for x in goal)


def test_empty_and_wordless(spark):
    assert mixing.mix(frame(spark, []), weight_of=mixing.cycle_521).count() == 0
    rows = [(1, None, None, "a", 0, 1, "s", "k", "f", "p"), (1, " ", None, None, 0, 1, "s", "k", "f", "p")]
    assert [r["taken"] for r in mixing.mix(frame(spark, rows), weight_of=mixing.cycle_521).collect()] == [0, 0]


def test_mixed_documents_keeps_columns(spark):
    df = frame(spark)
    got = mixing.mixed_documents(df, block_tokens=64)
    assert got.columns == df.columns
    most = got.groupBy("doc_id", "text").count().agg({"count": "max"}).first()[0]
    assert most <= 2 * 3  # two passes over a row that comes three times
