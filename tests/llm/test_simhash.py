import random
from collections import Counter

import numpy as np
import xxhash

from tessera.llm import graph, queries, simhash
from tests.llm.helpers import documents, frame, words


def brute_fingerprint(text, k=3):
    w = [bytes(x.encode()).lower() for x in words(text)]
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    n, comp = len(ids), list(range(len(ids)))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                comp[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def check(rows, got):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components([i for i, _ in rows], fps, 2)
    want = Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp, strict=True))
    assert Counter(got) == want


def test_fixture_as_by_brute_force(spark):
    got = simhash.near_duplicates(frame(spark), shingle=3).collect()
    check([(r[0], r[1]) for r in documents()], [(r["id"], r["fp"].hex(), r["component"]) for r in got])


def test_table_as_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(rows, [tuple(r) for r in queries.op8_simhash(spark, "/root/testdata/sf0.001").collect()])


def least_reached(near):
    want = np.arange(len(near))
    while True:
        new = np.array([want[row].min() for row in near])
        if (new == want).all():
            return want
        want = new


def test_bit_sliced_runs_as_by_brute_force():
    rng = np.random.default_rng(1)
    for radius, bits in ((2, 64), (5, 64), (78, 512)):
        centre = rng.integers(0, 2, (6, bits))
        rows = (centre[rng.integers(0, 6, 300)] ^ (rng.random((300, bits)) < radius / bits / 2.2)).astype(np.uint8)
        near = (rows[:, None, :] != rows[None]).sum(2) <= radius
        keys, place = np.sort(rng.integers(0, 4, 300)), np.arange(300)
        root = simhash.run_forest(np.packbits(rows, axis=1), place + 1, np.searchsorted(keys, keys, side="right"), radius)
        assert (root == least_reached(near & (keys[:, None] == keys[None]))).all()
        cross = place < 140  # two tiles
        root = simhash.run_forest(np.packbits(rows, axis=1), np.where(cross, 140, 300), np.full(300, 300), radius)
        assert (root == least_reached(near & (cross[:, None] != cross[None]) | np.eye(300, dtype=bool))).all()


def test_a_hot_band_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 13, 900))  # 51 bits in common: every band of the upper blocks is hot
    want = least_reached(np.array([[bin(int(a ^ b)).count("1") <= 2 for b in fps] for a in fps]))
    unique = spark.createDataFrame([(int(i), int(x).to_bytes(8, "big")) for i, x in enumerate(fps)], "c long, fp binary").repartition(3)
    for tile in (simhash.TILE, 100):
        monkeypatch.setattr(simhash, "TILE", tile)
        found = graph.components(simhash.links(simhash.banded(unique, simhash.exact_bands(64, 2)), unique, 2))
        root = {r["node"]: r["root"] for r in found.collect()}
        assert [root.get(i, i) for i in range(len(fps))] == want.tolist()


def test_fifty_thousand_fingerprints_of_one_key(spark):
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 1 << 26, 50_000))
    unique = spark.createDataFrame([(int(i), int(x).to_bytes(8, "big")) for i, x in enumerate(fps)], "c long, fp binary").repartition(4)
    one = unique.selectExpr("1L AS key", "c")
    near = simhash.links(one, unique, 1).collect()
    value = {int(x): i for i, x in enumerate(fps)}
    pairs = {(value[int(x)], value[int(x) ^ 1 << k]) for x in fps for k in range(26) if int(x) ^ 1 << k in value}
    union = list(range(len(fps)))
    find = lambda i: i if union[i] == i else find(union[i])
    for r in near:
        union[find(r["u"])] = find(r["v"])
    assert pairs and all(find(a) == find(b) for a, b in pairs) and all(bin(int(fps[r["u"]] ^ fps[r["v"]])).count("1") >= 1 for r in near)


def test_exact_bands_lose_no_pair():
    rng = random.Random(2)
    for radius in (1, 2, 3):
        bands = simhash.exact_bands(64, radius)
        for _ in range(200):
            differ = set(rng.sample(range(64), radius))
            assert any(not differ & set(b) for b in bands)


def test_components_of_a_long_path(spark):
    ids = list(range(200))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(900, 901), (5, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 900: 900, 901: 900}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_deduplicated(spark):
    df = frame(spark)
    got = simhash.deduplicated(df)
    assert got.columns == df.columns
    texts = [r["text"] for r in got.collect()]
    base = {r[1] for r in documents()}
    assert set(texts) <= base and sum("changed" in (t or "") for t in texts) == 1
    assert sum(not (t or "").strip() for t in texts) == 3
    assert simhash.deduplicated(frame(spark, [])).count() == 0


def test_dedup_decides_on_the_shingles(spark, monkeypatch):
    rng, rows, want = random.Random(8), [], set()
    say = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    for g in range(300):
        w = say(104)  # 100 shingles
        lost = (11, 12, 25)[g % 3]  # Jaccard 89 / 111 = 0.802, 88 / 112 = 0.786, 75 / 125 = 0.6
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:-lost] + say(lost)))]
        want |= {2 * g} if g % 3 == 0 else {2 * g, 2 * g + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (simhash.TILE_SHINGLES, 150):  # the second cuts every pair into tiles
        monkeypatch.setattr(simhash, "TILE_SHINGLES", tile)
        assert {r["doc_id"] for r in simhash.deduplicated(df).collect()} == want


def test_verified_links_as_by_brute_force():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(40, rng.integers(20, 40), replace=False).astype(np.uint64)) for _ in range(60)]
    near = np.array([[9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) for b in sets] for a in sets])
    want = np.arange(60)
    for _ in range(60):
        want = np.array([want[near[i]].min() for i in range(60)])
    assert near.sum() > 60 and (simhash.verified_links(sets, np.arange(60), np.arange(60)) == want).all()


def test_recall_just_above_the_threshold(spark):
    rng, rows = random.Random(12), []
    say = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    for g in range(1500):
        n = rng.choice([24, 54, 104, 304])  # words
        w = say(n)
        lost = next(x for x in range(n, 0, -1) if (n - 4 - x) / (n - 4 + x) >= 0.8)  # Jaccard from 0.80 to 0.85
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[: n - lost] + say(lost)))]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert 1500 <= got <= 1500 + 7  # 0.995 of the pairs are found


def test_dedup_drops_rows_not_ids(spark):
    rows = [(1, "one two three four five six"), (1, "quite another text with the same id"), (2, "one two three four five six"), (None, "a text without any id at all"), (None, "a text without any id at all"), (None, "another text without an id")]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([rows[0], rows[1], rows[3], rows[5]])
