"""Methods do the whole job beyond the sizes at which they once refused, and as their formulas say."""

import numpy as np

from tessera.operators import classifiers, similarity, small, walks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ring(spark, n, classes=3, chords=()):
    """A weighted ring with chords; the first `classes` nodes have a label."""
    rng = np.random.default_rng(4)
    e = [(i, (i + 1) % n, float(rng.uniform(0.5, 1))) for i in range(n)] + [(a, b, float(rng.uniform(0.1, 1))) for a, b in chords]
    return frame(spark, e, "src long, dst long, w double"), frame(spark, [(i, i if i < classes else -1) for i in range(n)], "id long, y int"), e


def test_dynamic_propagation_as_by_dense_matrices(spark):
    rng = np.random.default_rng(5)
    n, k, alpha, lam, steps = 50, 3, 0.05, 0.1, 12
    edges, labels, e = ring(spark, n, chords=[(i, int(j)) for i in range(0, n, 2) for j in rng.integers(0, n, 4) if abs(i - j) > 1])
    a = np.zeros((n, n))
    for s, t, w in e:
        a[s, t] += w / 2
        a[t, s] += w / 2
    p0 = a / a.sum(1)[:, None]
    order = np.argsort(-p0, axis=1, kind="stable")[:, :k]
    p = np.zeros_like(p0)
    np.put_along_axis(p, order, np.take_along_axis(p0, order, axis=1), axis=1)
    p /= p.sum(1, keepdims=True)
    y0 = np.eye(n, 3)
    f, pt = y0.copy(), p0
    for _ in range(steps):
        new = pt @ f
        new /= np.maximum(new.sum(1, keepdims=True), 1e-300)
        new[:3] = y0[:3]
        pt = p @ (pt + alpha * f @ f.T) @ p.T + lam * np.eye(n)
        pt /= max(1.0, pt.sum(1).max())
        f = new
    got = {r["id"]: r["x"] for r in small.dynamic_label_propagation(edges, labels, 3, k, alpha, lam, steps).collect()}
    assert np.allclose([got[i] for i in range(n)], f, atol=1e-12)


def test_dynamic_propagation_of_many_nodes(spark):
    n = 4000
    edges, labels, _ = ring(spark, n, 2)
    got = {r["id"]: np.argmax(r["x"]) for r in small.dynamic_label_propagation(edges, labels, 2, steps=6).collect()}
    assert len(got) == n and got[0] == 0 and got[1] == got[2] == got[3] == 1 and got[n - 1] == 0


def test_spectral_embedding_as_by_a_dense_decomposition(spark):
    rng = np.random.default_rng(6)
    m = np.where(rng.random((250, 250)) < 0.05, rng.exponential(size=(250, 250)), 0)
    m[:60, :60] += 0.4
    m[60:90, 60:90] += 0.9
    ids = rng.permutation(1000)[:250]
    rows = [(int(ids[i]), int(ids[j]), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    got = {r["id"]: r["x"] for r in walks.spectral_embedding(frame(spark, rows, "a long, b long, v double"), frame(spark, [(int(i),) for i in ids], "id long"), 5).collect()}
    u, s, _ = np.linalg.svd(m)
    u = u[:, :5]
    assert np.allclose([got[i] for i in ids], u * np.sign(u[np.abs(u).argmax(0), np.arange(5)]) * s[:5], atol=1e-6)


def test_spectral_embedding_of_many_nodes_and_of_little(spark):
    n = 2500
    star = [(0, i, 1.0) for i in range(1, n)] + [(i, 0, 1.0) for i in range(1, n)]  # greatest values: sqrt(n - 1), twice; the others are 0
    x = np.array([r["x"] for r in walks.spectral_embedding(frame(spark, star, "a long, b long, v double"), spark.range(n), 4).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(x, axis=0), [np.sqrt(n - 1)] * 2 + [0, 0], atol=1e-6)
    few = walks.spectral_embedding(frame(spark, star[:1], "a long, b long, v double"), spark.range(3), 5).orderBy("id").collect()
    assert np.allclose(np.abs([r["x"] for r in few]), [[1, 0, 0, 0, 0], [0] * 5, [0] * 5])
    assert walks.spectral_embedding(frame(spark, [], "a long, b long, v double"), spark.range(0), 2).count() == 0


def anchored(x, y_ids, k, seed, per_node, metric):
    """By all pairs, sums from the first column to the last: (src, dst) of the k nearest among rows that share an anchor."""
    import hashlib

    n = len(x)
    total = lambda v: np.array([sum(r.tolist(), 0.0) for r in v])
    norm = np.maximum(np.sqrt(total(x * x)), 1e-12)
    d = np.stack([np.sqrt(total((x[i] - x) ** 2)) if metric == "euclidean" else 1.0 - total(x[i] * x) / norm[i] / norm for i in range(n)])
    ticket = lambda i: hashlib.md5(f"{seed}|anchor|{i}".encode()).hexdigest()
    chosen = sorted(range(n), key=lambda i: (ticket(y_ids[i]), y_ids[i]))[: max(10, round(n**0.5))]
    own = [set(sorted(chosen, key=lambda j: (d[i, j], y_ids[j]))[:per_node]) for i in range(n)]
    near = {i: sorted((j for j in range(n) if y_ids[j] != y_ids[i] and own[i] & own[j]), key=lambda j: (d[i, j], y_ids[j]))[:k] for i in range(n)}
    return {(int(y_ids[i]), int(y_ids[j])) for i in near for j in near[i]}


def test_anchor_graph_as_by_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(-2, 3, size=(90, 3)).astype(float), rng.normal(size=(60, 3)), np.zeros((3, 3))])
    x = np.concatenate([x, x[:30], np.repeat(x[100:101], 25, axis=0)])  # copies, and vectors with equal distances
    ids = rng.permutation(1000)[: len(x)]
    nodes = frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(5000, None), (5001, [None, 1.0, 0.0])], "id long, x array<double>")
    monkeypatch.setattr(similarity, "TILE_ROWS", 12)
    for metric in ("cosine", "euclidean"):
        got = {(r["src"], r["dst"]) for r in similarity.anchor_graph(nodes.filter("id < 5000"), 6, 3, 3, metric=metric).collect()}
        assert got == anchored(x, ids, 6, 3, 3, metric)
    assert {r["src"] for r in similarity.anchor_graph(nodes, 2, 3, 3).collect()} <= set(ids.tolist())
    assert similarity.anchor_graph(nodes.limit(0), 2, 3, 3).count() == 0


def test_anchor_graph_with_a_limit_of_candidates(spark):
    rng = np.random.default_rng(9)
    nodes = frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 4)))], "id long, x array<double>")
    whole = {(r["src"], r["dst"]) for r in similarity.anchor_graph(nodes, 200, 3, 2).collect()}
    want = {(i, j) for i in range(80) for j in sorted(b for a, b in whole if a == i)[:5]}
    assert {(r["src"], r["dst"]) for r in similarity.anchor_graph(nodes, 200, 3, 2, limit=5).collect()} == want


def test_anchor_graph_of_many_copies_makes_no_pairs(spark):
    """Twenty thousand copies were four hundred million pairs."""
    n = 20_000
    nodes = spark.range(n + 40).selectExpr("id", f"case when id < {n} then array(1.0d, 0.5d) else array(cos(id), sin(id)) end as x")
    got = similarity.anchor_graph(nodes, 3, 3, 2).groupBy("src").agg({"dst": "count", "d": "max"}).toPandas()
    assert len(got) >= n and (got["count(dst)"] == 3)[got["src"] < n].all() and (got["max(d)"][got["src"] < n] < 1e-12).all()


def test_classes_that_tie_go_to_the_smaller_one(spark):
    """Columns of class c are those of class 0 in another order: a row of ones ties them all, whatever the order of its sum."""
    rng = np.random.default_rng(10)
    base = (rng.random((8, 64)) < rng.uniform(0.1, 0.9, 64)).astype(float)
    rows = [(8 * c + k, v.tolist(), c) for c in range(6) for k, v in enumerate(base[:, rng.permutation(64)])]
    model = classifiers.BernoulliNB().fit(frame(spark, rows, "id long, x array<double>, y int"), 6)
    got = classifiers.predicted(model.scores(frame(spark, [(0, [1.0] * 64), (1, [0.0] * 64)], "id long, x array<double>"))).collect()
    assert [r["p"] for r in got] == [0, 0] and all(abs(r["conf"] - 1 / 6) < 1e-9 for r in got)
