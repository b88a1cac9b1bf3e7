"""Closed forms, invariants and edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import seeds
from tessera.operators import augment, classifiers, deep, edges, features, metrics, propagate, sampling, selflabel, similarity, small, thresholds, views, walks
from tessera.plans import cache, hpo, limits, preprocess, run
from tessera.sources import catalog, store


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edge_list(spark, pairs):
    return frame(spark, [(a, b, float(w)) for a, b, w in pairs], "src long, dst long, w double")


def triples(df):
    return sorted((r["src"], r["dst"], round(r["w"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clusters(spark):
    """Two triangles, one label each."""
    e = [(a, b, 1.0) for g in ((0, 1, 2), (3, 4, 5)) for a in g for b in g if a != b]
    return edge_list(spark, e), frame(spark, [(i, {0: 0, 3: 1}.get(i, -1)) for i in range(6)], "id long, y int")


def test_seeds_are_those_of_the_formats():
    assert seeds.part_seed(7, "split") == int(__import__("hashlib").sha256(b"7:split").hexdigest()[:8], 16)
    assert 0 <= seeds.mixed_seed(5, 9) < 2**32 and seeds.mixed_seed(5, 9) != seeds.mixed_seed(5, 10)


def test_label_quota():
    q = sampling.label_quota
    L = sampling.Labelling
    assert sum(q([3, 3], L("fraction", 0.1, min_per_class=1))) >= 2 and min(q([3, 3], L("fraction", 0.1, min_per_class=1))) == 1
    assert q([3, 3], L("count", 4, "balanced")) == [2, 2]
    assert q([10, 2, 5], L("per_class", 4)) == [6, 2, 4]  # a scarce class's shortfall goes to the one with most room
    assert q([5, 5], L("count", 100)) == [5, 5] and q([], L("count", 3)) == []
    with pytest.raises(sampling.SamplingError):
        q([1], L("fraction", 1.5))


def test_holdouts_and_folds(spark):
    df = frame(spark, [(i, "aab"[i % 3] if i % 7 else None) for i in range(100)], "id long, y string")
    parts = {r["part"]: r["count"] for r in sampling.holdout_split(df, "y", 1).groupBy("part").count().collect()}
    assert parts == {"test": 20, "val": 8, "train": 72}
    folds = [r["count"] for r in sampling.kfold(df, 3, 1).groupBy("fold").count().orderBy("fold").collect()]
    assert folds == [34, 33, 33]
    assert sampling.random_holdout(df, 0, 1).filter("_picked").count() == 0 and sampling.random_holdout(df, 1000, 1).filter("_picked").count() == 100
    with pytest.raises(sampling.SamplingError):
        sampling.kfold_split(df, 3, 3, 1)


def test_fixed_labels_and_imbalance(spark):
    df = frame(spark, [(0, 0), (1, 1), (2, 0)], "id long, y int")
    assert [r["id"] for r in sampling.fixed_labelled(df, [0, 2]).filter("is_labelled").orderBy("id").collect()] == [0, 2]
    for bad in ([99], [0, 0]):
        with pytest.raises(sampling.SamplingError):
            sampling.fixed_labelled(df, bad)
    assert sampling.long_tail_quota([10, 10, 10], 0.5, 1) == [10, 5, 2]
    assert sampling.cap_per_class(df, "y", 1, 0).count() == 2


def test_sample_is_sound(spark):
    df = frame(spark, [(i, i % 3, "test" if i >= 80 else "train") for i in range(100)], "id long, y int, split string")
    for plan, official in ((sampling.SamplingPlan(), "split"), (sampling.SamplingPlan(split="kfold", fold=1), None), (sampling.SamplingPlan(imbalance="cap", cap=10), None), (sampling.SamplingPlan(respect_official=False), "split")):
        a = sampling.sample(df, plan, "y", 3, official=official)
        assert all(v == 0 for v in sampling.violations(a, df).first())
        assert a.filter("is_labelled").count() > 0
        if official and plan.respect_official:
            assert {r["id"] for r in a.filter("part = 'test'").collect()} == set(range(80, 100))
    masks = sampling.masks_of(sampling.sample(df, sampling.SamplingPlan(), "y", 3))
    back = sampling.parts_of(masks)
    assert back.count() == 100


def test_metrics(spark):
    df = frame(spark, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (float("nan"), 1.0)], "y double, p double")
    real = df.filter(~F.isnan("y"))
    assert metrics.accuracy(real).first()[0] == 0.75 and metrics.balanced_accuracy(df).first()[0] == 0.75
    assert math.isclose(metrics.macro_f1(real).first()[0], 0.7333333, rel_tol=1e-5)
    assert math.isnan(metrics.accuracy(real.limit(0)).first()[0]) and math.isnan(metrics.macro_f1(real.limit(0)).first()[0])
    arrays = frame(spark, [([1, 0], [0.9, 0.1]), ([0, 1], [0.2, 0.8]), ([1, 0], [0.5, 0.5])], "y array<int>, p array<double>")
    assert {r["value"] for r in metrics.evaluate(arrays, list(metrics.METRICS)).collect()} == {1.0}
    with pytest.raises(ValueError, match="unknown metrics"):
        metrics.evaluate(real, ["nope"])


def test_symmetry_and_loops(spark):
    assert triples(edges.symmetrized(edge_list(spark, [(0, 1, 1), (1, 0, 0.5), (1, 2, 1)]))) == [(0, 1, 0.75), (1, 0, 0.75)]
    assert triples(edges.symmetrized(edge_list(spark, [(0, 1, 1), (0, 0, 0.5)]), "or")) == [(0, 0, 0.5), (0, 1, 1.0), (1, 0, 1.0)]
    nodes = spark.range(3)
    assert triples(edges.with_loops(edge_list(spark, [(0, 0, 0.5)]), nodes)) == [(0, 0, 0.5), (1, 1, 1.0), (2, 2, 1.0)]
    s = edges.degree_summary(edge_list(spark, [(0, 1, 1), (0, 2, 1)]), nodes).first()
    assert (s["min"], s["max"], s["zero"]) == (0, 2, 2)


def test_neighbours_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    x[7] = 0
    nodes = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    assert similarity.knn(nodes, 5).count() == 200
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 9)
    got = {(r["src"], r["dst"]) for r in similarity.knn(nodes, 4, "euclidean").collect()}
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(40) for j in np.argsort(d[i], kind="stable")[:4]}
    close = {(r["src"], r["dst"]) for r in similarity.epsilon_pairs(nodes, 2.5).collect()}
    assert close == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 2.5), strict=True)}
    assert similarity.knn(nodes.limit(3), 9).count() == 6 and similarity.knn(nodes.limit(0), 3).count() == 0


def test_propagation_family_recovers_clusters(spark, clusters):
    e, y = clusters
    runs = {
        "lp": propagate.label_propagation(e, y, 2, 10), "ls": propagate.label_spreading(e, y, 2, 5), "laplace": propagate.laplace_learning(e, y, 2), "lazy": propagate.lazy_random_walk(e, y),
        "poisson": propagate.poisson_learning(e, y, 2), "mbo": propagate.poisson_mbo(e, y, 2, steps=5, outer=1, inner=2), "p": propagate.p_laplace(e, y, 2, steps=1), "cut": small.graph_mincut(e, y), "dlp": small.dynamic_label_propagation(e, y, 2, 2),
    }
    for name, scores in runs.items():
        assert {r["id"]: r["p"] for r in propagate.predictions(scores).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}, name
    with pytest.raises(ValueError):
        propagate.lazy_random_walk(e.filter("src < 3 and dst < 3"), y)


def test_laplacian_and_solver(spark):
    e = edge_list(spark, [(0, 1, 1), (1, 0, 1)])
    x = frame(spark, [(0, [1.0]), (1, [0.0])], "id long, x array<double>")
    assert {r["id"]: r["x"][0] for r in propagate.laplacian(e, x, 1).collect()} == {0: 1.0, 1: -1.0}
    out, n, left = propagate.conjugate_gradients(lambda v: v.select("id", F.transform("x", lambda a: a * (2.0 + F.col("id"))).alias("x")), x, 1)
    assert math.isclose({r["id"]: r["x"][0] for r in out.collect()}[0], 0.5) and left <= 1e-6 and n <= 2
    f = {r["id"]: r["x"][0] for r in propagate.fixed_point(e, x, 1, 1, 0.5).collect()}
    assert f == {0: 0.5, 1: 0.5}


def test_min_cut_against_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 6
        arcs = [(a, b, int(rng.integers(1, 9))) for a in range(n) for b in range(n) if a != b and rng.random() < 0.5]
        side = small.min_cut(n, arcs, 0, n - 1)
        cost = lambda s: sum(c for a, b, c in arcs if s[a] and not s[b])
        best = min(cost([True, *[bool(m >> i & 1) for i in range(n - 2)], False]) for m in range(2 ** (n - 2)))
        assert cost(side) == best and side[0] and not side[n - 1]


def test_features(spark):
    df = frame(spark, [(1, " a ", "1"), (2, "?", "2.5"), (3, "b", "NA")], "id long, c string, n string")
    m = features.fit_onehot(df, ["c", "n"])
    assert m.numeric == ["n"] and m.categories == {"c": [" a ", "b", None]}
    assert [r["x"][1:] for r in m.apply(df).orderBy("id").collect()] == [[1, 0, 0], [0, 0, 1], [0, 1, 0]]
    rng = np.random.default_rng(2)
    a = rng.normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(a)], "id long, x array<double>")
    z = np.stack([r["x"] for r in features.fit_pca(rows, 2).apply(rows).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(a - a.mean(0), full_matrices=False)
    assert np.allclose(np.abs(z), np.abs(u[:, :2] * s[:2]))
    w = np.stack([r["x"] for r in features.fit_whitening(rows, 1e-9).apply(rows).collect()])
    assert np.allclose(np.cov(w.T, bias=True), np.eye(5), atol=1e-4)
    t = features.hash_tokenized(frame(spark, [(1, "Hello world"), (2, ""), (3, None)], "id long, text string"), "text", 3).orderBy("id").collect()
    assert [r["attention_mask"] for r in t] == [[1, 1, 0], [0, 0, 0], [0, 0, 0]] and t[1]["input_ids"] == [0, 0, 0]


def test_images_and_sound(spark):
    img = frame(spark, [(1, (2, 2, 1, [1.0, 2.0, 3.0, 4.0]))], f"id long, image {features.IMAGE}")
    get = lambda df: df.first()["image"]["data"]
    assert get(features.with_channels(img, "image", 2)) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert get(features.channels_order(features.with_channels(img, "image", 2), "image", "nchw")) == [1, 2, 3, 4, 1, 2, 3, 4]
    assert get(features.channels_order(features.channels_order(features.with_channels(img, "image", 2), "image", "nchw"), "image", "nhwc")) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert get(features.resized(img, "image", 1, 1)) == [1.0]
    assert sorted(get(augment.image_augmented(img, "image", "vision.random_crop_pad", 1, padding=1)))[0] >= 1
    wave = frame(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0])], "id long, wave array<double>")
    assert features.fixed_length(wave, "wave", 3, "center").first()["wave"] == [2, 3, 4] and features.fixed_length(wave, "wave", 7).first()["wave"] == [1, 2, 3, 4, 5, 0, 0]
    assert len(features.log_mel(wave, "wave", n_mels=8).first()["mel"]) == 8
    assert sorted(augment.augmented(wave, "wave", [("audio.time_shift", {"most": 0.9})], 4).first()["wave"]) == [1, 2, 3, 4, 5]


def test_text_augmentation(spark):
    df = frame(spark, [(1, "a b c d e f"), (2, "one"), (3, "")], "id long, text string")
    go = lambda op, **p: [r["text"] for r in augment.augmented(df, "text", [(op, p)], 5).orderBy("id").collect()]
    assert all(w for w in go("text.word_dropout", p=1.0)[:2]) and go("text.word_dropout", p=1.0)[1] == "one"
    assert sorted(go("text.random_swap", n=3)[0].split()) == list("abcdef") and go("text.random_swap")[1:] == ["one", ""]
    assert go("text.lowercase") == go("text.lowercase")
    ids = frame(spark, [(1, [5, 6, 7, 0, 0])], "id long, t array<bigint>")
    out = augment.augmented(ids, "t", [("text.token_swap", {})], 3).first()["t"]
    assert sorted(out[:3]) == [5, 6, 7] and out != [5, 6, 7, 0, 0] and out[3:] == [0, 0]


def test_views():
    v = views.resolve(views.two_views(), 6, 1)
    assert sorted(v["view_a"] + v["view_b"]) == list(range(6)) and len(v["view_a"]) == 3 and v == views.resolve(views.two_views(), 6, 1)
    for bad in ([views.View("a", "indices", [7]), views.View("b")], [views.View("a", "complement", of="b"), views.View("b")], [views.View("a")]):
        with pytest.raises(ValueError):
            views.resolve(bad, 6, 1)


@pytest.fixture(scope="module")
def square(spark):
    rng = np.random.default_rng(3)
    centre = np.array([[0, 0], [3, 3]])
    y = np.arange(60) % 2
    x = centre[y] + rng.normal(size=(60, 2)) * 0.3
    rows = frame(spark, [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")
    return rows, rows.filter("id < 8"), rows.filter("id >= 8").select("id", "x")


@pytest.mark.parametrize("name", ["knn", "gaussian_nb", "bernoulli_nb", "ridge", "student", "logreg", "linear_svm", "svm_rbf", "mlp"])
def test_classifiers(square, name):
    rows, known, _ = square
    params = {"bernoulli_nb": {"binarize": 1.5}, "mlp": {"hidden": (4,), "steps": 20}}.get(name, {})
    got = {r["id"]: r["p"] for r in classifiers.predicted(classifiers.build(name, **params).fit(known, 2).scores(rows)).collect()}
    assert np.mean([got[r["id"]] == r["y"] for r in rows.collect()]) >= (0.85 if name == "gaussian_nb" else 0.95)  # four rows a class
    with pytest.raises(NotImplementedError):
        classifiers.build("text_cnn")


def test_self_labelling_loops(square):
    rows, known, pool = square
    right = lambda model: np.mean([r["p"] == r["id"] % 2 for r in classifiers.predicted(model.scores(rows)).collect()])
    st = selflabel.self_training(known, pool, 2, rounds=2)
    assert st.added > 40 and right(st) >= 0.95
    assert right(selflabel.setred(known, pool, 2, rounds=1, graph="knn", k=3)) >= 0.95
    assert right(selflabel.tri_training(known, pool, 2, rounds=1)["models"][0]) >= 0.95
    assert right(selflabel.democratic(known, pool, 2, [classifiers.GaussianNB(), classifiers.Knn(3)], rounds=1)["models"][1]) >= 0.95
    assert right(selflabel.s4vm(known, pool, candidates=2)) >= 0.85
    two = lambda df: df.withColumns({"xa": F.slice("x", 1, 1), "xb": F.slice("x", 2, 1)})
    co = selflabel.co_training(two(known).select("id", "xa", "xb", "y"), two(pool).select("id", "xa", "xb"), 2, rounds=1, k=2)
    assert co["rounds"] == 1 and co["labelled"][1].count() == 12


def test_democratic_figures():
    lo, hi = selflabel.wald(9, 10)
    assert math.isclose(lo, 0.9 - 1.959964 * math.sqrt(0.009), rel_tol=1e-5) and hi == 1.0
    assert selflabel.worthwhile(10, 0.0, 5, 1.0) == (True, 0.0) and not selflabel.worthwhile(10, 0.0, 5, 0.0)[0]


@pytest.mark.parametrize("method", ["fixmatch", "softmatch", "adamatch", "mean_teacher", "mixmatch", "vat", "comatch", "daso"])
def test_consistency_training(square, method):
    rows, known, pool = (df.withColumn("x", F.transform("x", lambda v: v - 1.5)) for df in square)  # cosines tell the classes apart about the middle
    model = deep.train(method, known, pool, pool, 2, rounds=1, base=classifiers.Student(steps=8), threshold=0.6)
    assert np.mean([r["p"] == r["id"] % 2 for r in classifiers.predicted(model.scores(rows)).collect()]) >= 0.95
    with pytest.raises(NotImplementedError):
        deep.train("simclr_v2", known, pool, pool, 2)


def test_adversarial_rows_change_scores_most(spark):
    rng = np.random.default_rng(4)
    w = rng.normal(size=(6, 3))
    x = rng.normal(size=(40, 5))
    model = classifiers.SoftmaxOf(w)
    pool = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    soft = lambda v: (lambda e: e / e.sum(1, keepdims=True))(np.exp(v @ w[:-1] + w[-1]))
    got = sorted(deep.adversarial(model, pool, 0.05, 4).collect(), key=lambda r: r["id"])
    moved, p = np.array([r["x"] for r in got]), soft(x)
    assert np.allclose(np.linalg.norm(moved - x, axis=1), 0.05) and np.allclose([r["target"] for r in got], p)
    change = lambda y: (p * np.log(p / soft(y))).sum(1)
    for _ in range(20):
        d = rng.normal(size=x.shape)
        assert (change(moved) >= 0.9 * change(x + 0.05 * d / np.linalg.norm(d, axis=1, keepdims=True))).all()


def test_mixup(spark):
    assert np.allclose(deep.beta_quantiles(1.0), (np.arange(512) + 0.5) / 512, atol=1e-3)
    draws = np.sort(np.random.default_rng(0).beta(0.75, 0.75, 400_000))
    assert np.abs(deep.beta_quantiles(0.75) - draws[((np.arange(512) + 0.5) / 512 * 400_000).astype(int)]).max() < 0.01
    rows = frame(spark, [(i, [float(i), 1.0], [1.0, 0.0] if i % 2 else [0.0, 1.0], 1.0) for i in range(200)], "id long, x array<double>, target array<double>, weight double")
    got = deep.mixed_up(rows).collect()
    assert sorted(r["id"] for r in got) == list(range(200)) and all(abs(sum(r["target"]) - 1) < 1e-9 and abs(r["x"][1] - 1) < 1e-9 for r in got)
    assert all(r["target"][0 if r["id"] % 2 else 1] >= 0.5 for r in got) and sum(abs(r["x"][0] - r["id"]) > 1e-6 for r in got) > 150


def test_a_mean_teacher_averages_weights(spark):
    class Steps:
        def __init__(self):
            self.w = iter([np.full((2, 2), float(v)) for v in (0, 3, 6, 9)])

        def fit(self, rows, n_classes):
            rows.count()
            return classifiers.SoftmaxOf(next(self.w))

    known = frame(spark, [(0, [1.0], 0), (1, [2.0], 1)], "id long, x array<double>, y int")
    pool = known.drop("y")
    assert np.allclose(deep.train("mean_teacher", known, pool, pool, 2, rounds=3, base=Steps()).w, (0 + 3 + 6 + 9) / 4)


def test_committees(square):
    rows, known, pool = square
    base = classifiers.Student(steps=8)
    for m in (deep.trinet(known, pool, 2, 1, base=base), deep.deep_co_training(known, pool, pool, 2, 1, base), deep.meta_pseudo_labels(known, pool, 2, 2, base)):
        assert np.mean([r["p"] == r["id"] % 2 for r in classifiers.predicted(m.scores(rows)).collect()]) >= 0.95


def test_kernels(spark):
    assert thresholds.flexmatch_threshold({0: 1.0, 1: 0.5}) == {0: 0.95, 1: 0.95 / 3}
    assert thresholds.tsa_threshold(5, 10, 4) == 0.625 and thresholds.tsa_threshold(1, 10, 4, "none") == 1.0
    assert thresholds.early_stop([3, 2, 2, 2, 1], 2) == 3
    s = frame(spark, [(1, [0.5, 0.5]), (2, [1.0, 0.0])], "id long, x array<double>")
    js = {r["id"]: r["js"] for r in thresholds.js_divergence(s, s.withColumn("x", F.reverse("x"))).collect()}
    assert abs(js[1]) < 1e-12 and math.isclose(js[2], math.log(2))
    z = thresholds.ensembled(frame(spark, [(1, [0.0, 0.0])], "id long, z array<double>"), s, 0, 0.6).orderBy("id").collect()
    assert np.allclose(z[0]["x"], [0.5, 0.5]) and np.allclose(z[1]["x"], [1, 0])
    e = edge_list(spark, [(0, 1, 1), (2, 1, 1), (1, 0, 1), (1, 2, 1)])
    assert {(r["id"], r["grp"]) for r in thresholds.structural_groups(e, spark.range(4)).collect()} == {(0, 0), (1, 1), (2, 0), (3, 3)}


def test_walks(spark, clusters):
    e, y = clusters
    for p in (1.0, 0.5):
        w = walks.walks(e, y, 4, 2, 1, p, 2.0 if p != 1 else 1.0)
        assert w.count() == 6 * 2 * 4
        steps = w.alias("a").join(w.alias("b"), (F.col("a.walk") == F.col("b.walk")) & (F.col("a.at") + 1 == F.col("b.at")))
        assert steps.filter("floor(a.node / 3) <> floor(b.node / 3) or a.node = b.node").count() == 0
    assert walks.walks(e.limit(0), y, 3, 1, 1).filter("split(walk, '/')[0] <> node").count() == 0


def test_networks_recover_clusters(spark, clusters):
    e, y = clusters
    x = frame(spark, [(i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)], "id long, x array<double>")
    base = classifiers.Student(steps=8)
    for scores in (deep.sgc(e, x, y, 2, 2, base=base), deep.graphsage(e, x, y, 2, 2, base=base), deep.appnp(e, x, y, 2, 2, base=base), deep.chebnet(e, x, y, 2, 2, 3, base), deep.gcnii(e, x, y, 2, 2, 3, base=base), deep.gat(e, x, y, 2, 2, base), deep.grand(e, x, y, 2, 2, 2, 2, 0.2, base=base), deep.h_gcn(e, x, y, 2, 2, base), deep.grafn(e, x, y, 2, 2, base=base), deep.planetoid(e, x, y, 2, 4, base, length=4, per_node=2)):
        assert {r["id"]: r["p"] for r in propagate.predictions(scores).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_space_and_search():
    s = hpo.Space({"method": {"params": {"b": [1, 2], "a": {"dist": "choice", "values": ["x", "y"]}}}})
    assert [tuple(p.values()) for p in s.grid()] == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]
    r = list(hpo.Space({"a": {"dist": "loguniform", "low": 0.1, "high": 10}, "b": {"dist": "randint", "low": 1, "high": 3}}).random(1, 20))
    assert all(0.1 <= p["a"] < 10 and p["b"] in (1, 2) for p in r) and r == list(hpo.Space({"a": {"dist": "loguniform", "low": 0.1, "high": 10}, "b": {"dist": "randint", "low": 1, "high": 3}}).random(1, 20))
    found = hpo.search(s, lambda patch, seed: {1: float("nan"), 2: 1.0}[patch["method.params.b"]])
    assert found["best"]["index"] == 1
    for bad in ({}, {"a": []}, {"a": {"dist": "uniform", "low": 2, "high": 1}}, {"a": {"dist": "choice", "values": [1], "low": 1}}):
        with pytest.raises(hpo.SearchError):
            hpo.Space(bad)
    assert hpo.patched({"a": {"b": 1, "c": 2}}, {"a.b": 3, "d.e": 4}) == {"a": {"b": 3, "c": 2}, "d": {"e": 4}} and hpo.leaves({"a": {"b": 1}, "": {}}) == {"": {}, "a.b": 1}


def test_preprocess_plan(spark):
    df = frame(spark, [(i, [float(i), 1.0], "ab"[i % 2]) for i in range(10)], "id long, x array<double>, y string")
    plan = preprocess.PreprocessPlan.from_dict({"steps": [{"id": "tabular.standard_scaler"}, {"id": "labels.encode"}, {"id": "text.hash_tokenizer"}, {"id": "core.pca", "params": {"k": 1}, "enabled": False}]})
    got = preprocess.preprocess(df, plan, lambda d: d.filter("id < 5"))
    assert got.applied == ["0:tabular.standard_scaler", "1:labels.encode"] and set(got.skipped.values()) == {"missing ['text']", "disabled"}
    x = {r["id"]: r["x"] for r in got.data.collect()}
    assert math.isclose(x[2][0], 0) and x[9][1] == 0.0
    with pytest.raises(preprocess.PlanError):
        preprocess.preprocess(df, plan)
    with pytest.raises(preprocess.PlanError):
        preprocess.PreprocessPlan.from_dict({"steps": [{"id": "nope"}]})


def test_sources(spark, tmp_path):
    assert catalog.parse_uri(" toy : x ") == ("toy", "x") and len(catalog.CATALOG) == 21
    for bad in ("toy", ":x", "toy: "):
        with pytest.raises(catalog.SourceError):
            catalog.parse_uri(bad)
    got = catalog.load_dataset(spark, "toy", str(tmp_path / "s"))["nodes"]
    assert got.count() == 64 and got.filter("split = 'test'").count() == 16
    with pytest.raises(FileNotFoundError):
        catalog.load_dataset(spark, "toy", str(tmp_path / "s"), {"n_samples": 8}, download=False)
    catalog.load_dataset(spark, "toy", str(tmp_path / "s"), {"n_samples": 8})
    s = store.Store(spark, str(tmp_path / "s"))
    assert len(s.index()) == 2 and len(s.collect_garbage()) == 1 and len(s.index()) == 1
    report = {r["key"]: r["status"] for r in catalog.download_all(spark, str(tmp_path / "s"), include=["toy", "iris"]).collect()}
    assert report["iris"] == "failed" and report["toy"] in ("cached", "done")
    spark.createDataFrame([(1, "hi", "a"), (2, "ho", "b")], "k long, body string, cls string").write.parquet(str(tmp_path / "t.parquet"))
    t = catalog.read(spark, f"text:{tmp_path}/t.parquet", {"text_column": "body", "label_column": "cls", "id_column": "k", "class_filter": "a"})["nodes"]
    assert [(r["id"], r["text"], r["y"]) for r in t.collect()] == [(1, "hi", "a")]
    (tmp_path / "img/cat").mkdir(parents=True)
    (tmp_path / "img/cat/1.bin").write_bytes(b"abc")
    f = catalog.read(spark, f"files:{tmp_path}/img")["nodes"].first()
    assert f["y"] == "cat" and bytes(f["content"]) == b"abc"
    edge_list(spark, [(0, 1, 1), (1, 2, 1)]).write.parquet(str(tmp_path / "e.parquet"))
    frame(spark, [(0, [1.0], 0), (1, [1.0], 1), (2, [1.0], 1), (3, [1.0], None)], "id long, x array<double>, y int").write.parquet(str(tmp_path / "n.parquet"))
    g = catalog.read(spark, "graph:g", {"nodes_path": f"{tmp_path}/n.parquet", "edges_path": f"{tmp_path}/e.parquet", "class_filter": [1]})
    assert triples(g["edges"]) == [(0, 1, 1.0)]


CONFIG = {
    "run": {"name": "t", "seeds": [1]}, "dataset": {"id": "toy"}, "sampling": {"plan": {"split": {"kind": "holdout", "val_fraction": 0.2}, "labeling": {"mode": "fraction", "value": 0.3}}}, "preprocess": {"fit_on": "train", "plan": {"steps": [{"id": "core.ensure_2d"}]}},
    "graph": {"spec": {"k": 5, "weights": {"kind": "heat", "sigma": 1.0}, "backend": "numpy"}}, "method": {"kind": "transductive", "id": "label_propagation", "params": {"max_iter": 3}}, "evaluation": {"report_splits": ["val", "test"], "metrics": ["accuracy"]},
}


def test_experiment(spark, tmp_path):
    got = run.sweep(spark, CONFIG, str(tmp_path))
    assert got["status"] == "success", got["runs"][0]["error"]
    assert {(r["split"], r["metric"], r["n"]) for r in got["summary"]} == {("val", "accuracy", 1), ("test", "accuracy", 1)} and len(list(tmp_path.glob("*/run.json"))) == 1
    failed = run.run_one(spark, {**CONFIG, "dataset": {"id": "iris"}})
    assert failed["run"]["status"] == "failed" and "server" in failed["error"]


def test_configurations(monkeypatch):
    monkeypatch.setenv("SOME_DIR", "/x")
    assert run.expand({"a": ["${SOME_DIR}/y"]}) == {"a": ["/x/y"]}
    for bad in ({**CONFIG, "extra": {}}, {**CONFIG, "method": {"kind": "transductive", "id": "nope"}}, {**CONFIG, "run": {"benchmark_mode": True}}, {k: v for k, v in CONFIG.items() if k != "run"}):
        with pytest.raises(run.ConfigError):
            run.validated(bad)
    assert run.expand("$SOME_DIR/z $$5") == "/x/z $5"
    for missing in ("${NOT_SET_AT_ALL}", "$NOT_SET_AT_ALL"):
        with pytest.raises(run.ConfigError):
            run.expand(missing)
    with pytest.raises(run.ConfigError, match="cache_dir"):
        run.validated({**CONFIG, "graph": {**CONFIG["graph"], "cache": True}})
    whole = {**CONFIG, "run": {"benchmark_mode": True, "fail_fast": True}, "dataset": {"id": "toy", "download": False, "cache_dir": "/c"}}
    run.validated(whole)
    picked = {"enabled": True, "space": {"method": {"params": {"max_iter": [1, 2]}}}}
    for more in ({"search": picked}, {"search": {**picked, "split": "test"}, "evaluation": {**CONFIG["evaluation"], "split_for_model_selection": "val"}}, {"dataset": {"id": "toy", "download": False}}):
        with pytest.raises(run.ConfigError):
            run.validated({**whole, **more})


def test_memory_limits():
    wide = {**CONFIG, "limits": {"profile": "v100", "max_rows": 50}, "dataset": {"id": "toy", "options": {"limit": 80}}, "graph": {"spec": {"k": 5, "chunk_size": 4096}}, "method": {"kind": "inductive", "id": "supervised", "params": {"batch_size": 1000, "classifier_params": {"batch_size": 8}}}}
    got = limits.clipped(wide)
    assert got["method"]["params"] == {"batch_size": 128, "classifier_params": {"batch_size": 8}} and got["graph"]["spec"] == {"k": 5, "chunk_size": 512} and got["dataset"]["options"] == {"limit": 50}
    assert wide["graph"]["spec"]["chunk_size"] == 4096 and run.graph_spec(got["graph"]["spec"]).block_rows == 512
    assert limits.clipped(CONFIG) == CONFIG
    with pytest.raises(ValueError):
        limits.clipped({**CONFIG, "limits": {"profile": "none such"}})


def test_steps_are_cached(spark, tmp_path):
    config = {**CONFIG, "preprocess": {"fit_on": "train", "cache": True, "cache_dir": f"{tmp_path}/p", "plan": {"steps": [{"id": "core.ensure_2d"}, {"id": "tabular.standard_scaler"}]}}, "graph": {**CONFIG["graph"], "cache": True, "cache_dir": f"{tmp_path}/g"}}
    first = run.run_one(spark, config)
    assert first["run"]["status"] == "success", first["error"]
    made = sorted(x.name for x in [*(tmp_path / "p").iterdir(), *(tmp_path / "g").iterdir()])
    assert len(made) == 3
    assert run.run_one(spark, config)["metrics"] == first["metrics"] and sorted(x.name for x in [*(tmp_path / "p").iterdir(), *(tmp_path / "g").iterdir()]) == made
    cut_off = cache.StepCache(spark, f"{tmp_path}/p")
    (tmp_path / "p" / made[0] / "_SUCCESS").unlink(missing_ok=True)
    (tmp_path / "p" / made[1] / "_SUCCESS").unlink(missing_ok=True)
    keys = [x.name for x in (tmp_path / "p").iterdir() if not (x / "_SUCCESS").exists()]
    assert keys and not cut_off.whole(keys[0]) and cut_off(keys[0], lambda: spark.range(3)).count() == 3 and (cut_off.hits, cut_off.misses) == (0, 1)
    assert cut_off(keys[0], lambda: None).count() == 3 and cut_off.hits == 1


def test_co_training_scores_both_views(spark):
    class Fixed:
        def __init__(self, row):
            self.row = row

        def scores(self, rows):
            return rows.select("id", F.array(*[F.lit(v) for v in self.row]).alias("x"))

    class Turns:
        def __init__(self):
            self.given = iter([[0.9, 0.1], [0.2, 0.8]] * 10)

        def fit(self, rows, n_classes):
            return Fixed(next(self.given))

    both = frame(spark, [(i, [0.0], [1.0], i % 2) for i in range(4)], "id long, view_a array<double>, view_b array<double>, y int")
    ctx = {"labelled_views": both, "pool_views": both.drop("y").limit(0), "row_views": both.drop("y"), "n_classes": 2, "base": Turns()}
    got = [r["x"] for r in run._co(ctx, {"rounds": 0}).collect()]
    assert len(got) == 4 and all(abs(x[0] - 0.55) < 1e-9 and abs(x[1] - 0.45) < 1e-9 for x in got)


def test_command_line(capsys):
    from tessera.plans import cli

    assert cli.main(["datasets", "list", "--modality", "graph"]) == 0 and "cora" in capsys.readouterr().out
    for argv in (["inductive", "list"], ["supervised", "list"], ["preprocess", "steps"], ["augmentation", "list"], ["evaluation", "list"], ["doctor", "check"]):
        assert cli.main(argv) == 0


def test_stream(spark, square, tmp_path):
    from tessera.streaming import scoring

    rows, known, pool = square
    pool.write.parquet(str(tmp_path / "in"))
    stream, seen = spark.readStream.schema(pool.schema).parquet(str(tmp_path / "in")), []
    q = scoring.score_stream(stream, classifiers.GaussianNB().fit(known, 2), lambda df, e: seen.append(df.count()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert sum(seen) == 52
