"""Base classifiers: fit on (id, x, y), then scores(rows) gives (id, x) with a probability per class.

Classes are 0 .. n_classes - 1. Models are numbers per class and column, or pyspark.ml models; rows stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import argmax, as_double, normalised
from tessera.operators.propagate import cut
from tessera.operators.similarity import nearest


class Fitted(Protocol):
    def scores(self, rows: DataFrame) -> DataFrame: ...


def _onehot(cls, n: int):
    return F.array(*[F.when(cls == c, 1.0).otherwise(0.0) for c in range(n)])


@dataclass
class Knn:
    """k nearest rows vote, alike or by 1 / (d + eps), d being squared for the euclidean metric."""

    k: int = 5
    metric: str = "euclidean"
    weights: str = "uniform"
    eps: float = 1e-12

    def fit(self, rows: DataFrame, n_classes: int) -> Fitted:
        return _FittedKnn(self, rows.select("id", "x", "y"), n_classes)


@dataclass
class _FittedKnn:
    spec: Knn
    base: DataFrame
    n_classes: int

    def scores(self, rows: DataFrame) -> DataFrame:
        s = self.spec
        near = nearest(rows, self.base, s.k, s.metric, itself=True)
        d = F.col("d") * F.col("d") if s.metric == "euclidean" else F.col("d")
        w = F.lit(1.0) if s.weights == "uniform" else 1 / (d + s.eps)
        met = near.join(self.base.select(F.col("id").alias("dst"), "y"), "dst")
        votes = met.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.when(F.col("y") == c, w).otherwise(0.0)).alias(f"_{c}") for c in range(self.n_classes)])
        return votes.select("id", normalised(F.array(*[f"_{c}" for c in range(self.n_classes)])).alias("x"))


def _class_sums(rows: DataFrame, n_classes: int, width: int, *fs: Callable) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts by class, and by class and column what each function of a column aggregates to."""
    out, n = [np.zeros((n_classes, width)) for _ in fs], np.zeros(n_classes)
    aggs = [f(F.col("x")[i].cast("double")).alias(f"{k}_{i}") for k, f in enumerate(fs) for i in range(width)]
    for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *aggs).collect():  # a row a class
        n[r["y"]] = r["n"]
        for k in range(len(fs)):
            out[k][r["y"]] = [r[f"{k}_{i}"] or 0.0 for i in range(width)]
    return n, out


@dataclass
class _Linear:
    """Class scores from numpy over Arrow batches: softmax of f(rows of x).

    Of sums of `terms` numbers, those that differ from the greatest by no more than rounding count as equal to it.
    """

    f: Callable[[np.ndarray], np.ndarray]
    hard: bool = False
    terms: int = 0

    def scores(self, rows: DataFrame) -> DataFrame:
        f, hard, terms = self.f, self.hard, self.terms

        @F.pandas_udf("array<double>")
        def go(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            z = f(np.stack(x.to_numpy()).astype(float))
            if terms:
                top = z.max(1, keepdims=True)
                z = np.where(top - z <= 4 * np.finfo(float).eps * terms * np.abs(top), top, z)
            if hard:
                return pd.Series(list((z == z.max(1, keepdims=True)).astype(float)))
            e = np.exp(z - z.max(1, keepdims=True))
            return pd.Series(list(e / e.sum(1, keepdims=True)))

        return rows.select("id", go(as_double("x")).alias("x"))


def _width(rows: DataFrame) -> int:
    found = rows.select(F.size("x").alias("n")).first()
    if found is None:
        raise ValueError("nothing to fit on")
    return found["n"]


@dataclass
class GaussianNB:
    smoothing: float = 1e-9

    def fit(self, rows: DataFrame, n_classes: int) -> Fitted:
        width = _width(rows)
        n, (mean, var) = _class_sums(rows, n_classes, width, F.avg, F.var_pop)
        whole = rows.agg(*[F.var_pop(F.col("x")[i].cast("double")).alias(str(i)) for i in range(width)]).first()
        var = var + self.smoothing * max(whole[str(i)] for i in range(width))
        with np.errstate(divide="ignore"):
            prior = np.log(n / n.sum())
        var = np.where(var > 0, var, 1e-300)
        base = prior - 0.5 * np.log(2 * np.pi * var).sum(1)
        return _Linear(lambda x: base - 0.5 * (x**2 @ (1 / var).T - 2 * x @ (mean / var).T + (mean**2 / var).sum(1)))


@dataclass
class MultinomialNB:
    alpha: float = 1.0

    def fit(self, rows: DataFrame, n_classes: int) -> Fitted:
        n, (s,) = _class_sums(rows, n_classes, _width(rows), F.sum)
        theta = np.log((s + self.alpha) / (s + self.alpha).sum(1, keepdims=True))
        with np.errstate(divide="ignore"):
            prior = np.log(n / n.sum())
        return _Linear(lambda x: prior + x @ theta.T)


@dataclass
class BernoulliNB:
    """Classes that tie but for the rounding of sums get one score, so that the first is taken."""

    alpha: float = 1.0
    binarize: float = 0.0

    def fit(self, rows: DataFrame, n_classes: int) -> Fitted:
        at = self.binarize
        n, (s,) = _class_sums(rows, n_classes, _width(rows), lambda c: F.sum(F.when(c > at, 1.0).otherwise(0.0)))
        p = (s + self.alpha) / (n[:, None] + 2 * self.alpha)
        with np.errstate(divide="ignore"):
            prior = np.log(n / n.sum())
        return _Linear(lambda x: prior + (x > at) @ np.log(p).T + (x <= at) @ np.log(1 - p).T, terms=p.shape[1])  # of counts, so that classes do tie


@dataclass
class Ridge:
    """Targets +1 and -1 by class, normal equations with an intercept; hard scores."""

    alpha: float = 1.0

    def fit(self, rows: DataFrame, n_classes: int) -> Fitted:
        from tessera.operators.features import gramian

        width = _width(rows)
        joined = rows.select(F.concat(as_double("x"), F.transform(_onehot(F.col("y"), n_classes), lambda v: 2 * v - 1)).alias("x"))
        n, s, g = gramian(joined)
        mean = s / n
        c = g - n * np.outer(mean, mean)
        w = np.linalg.solve(c[:width, :width] + self.alpha * np.eye(width), c[:width, width:])
        b = mean[width:] - mean[:width] @ w
        return _Linear(lambda x: x @ w + b, hard=True)


@dataclass
class _Ml:
    """A pyspark.ml estimator; one-against-rest where it knows two classes only."""

    make: Callable[[], Any]
    binary: bool = False

    def fit(self, rows: DataFrame, n_classes: int) -> Fitted:
        from pyspark.ml.classification import OneVsRest
        from pyspark.ml.functions import array_to_vector

        data = rows.select(array_to_vector(as_double("x")).alias("features"), F.col("y").cast("double").alias("label"))
        est = self.make()
        return _FittedMl((OneVsRest(classifier=est) if self.binary else est).fit(data), n_classes)


@dataclass
class _FittedMl:
    model: Any
    n_classes: int

    def scores(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        out = self.model.transform(rows.select("id", array_to_vector(as_double("x")).alias("features")))
        if "probability" in out.columns:
            p = vector_to_array("probability")
            pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(self.n_classes) - F.size(p), F.lit(0)))
            return out.select("id", F.slice(F.concat(p, pad), 1, self.n_classes).alias("x"))
        return out.select("id", _onehot(F.col("prediction").cast("int"), self.n_classes).alias("x"))


@dataclass
class RbfSvm:
    """Random Fourier features of the Gaussian kernel, then a linear SVM (an approximation)."""

    gamma: float | None = None
    components: int = 256
    seed: int = 0

    def fit(self, rows: DataFrame, n_classes: int) -> Fitted:
        width = _width(rows)
        gamma = self.gamma
        if gamma is None:
            var = rows.select(F.explode(as_double("x")).alias("v")).agg(F.var_pop("v").alias("v")).first()["v"]
            gamma = 1 / (width * var) if var else 1.0
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(size=(width, self.components)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, self.components)

        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.sqrt(2 / len(b)) * np.cos(np.stack(x.to_numpy()).astype(float) @ w + b))) if len(x) else pd.Series([], dtype=object)

        inner = CLASSIFIERS["linear_svm"]().fit(rows.withColumn("x", lift(as_double("x"))), n_classes)
        return _Lifted(inner, lift)


@dataclass
class _Lifted:
    inner: Fitted
    lift: Any

    def scores(self, rows: DataFrame) -> DataFrame:
        return self.inner.scores(rows.withColumn("x", self.lift(as_double("x"))))


@dataclass
class Student:
    """A softmax regression trained by full-batch gradient steps with momentum, in numpy on sums that tasks compute: the student of the deep methods."""

    steps: int = 20
    rate: float = 0.5
    momentum: float = 0.9
    decay: float = 1e-4

    def fit(self, rows: DataFrame, n_classes: int) -> Fitted:
        """Rows may have a column `target` (probabilities) and `weight`; else y counts with weight 1."""
        width = _width(rows)
        t = F.col("target") if "target" in rows.columns else _onehot(F.col("y"), n_classes)
        u = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
        data = cut(rows.select(as_double("x").alias("x"), t.cast("array<double>").alias("t"), u.alias("u")))
        w = v = np.zeros((width + 1, n_classes))
        for _ in range(self.steps):
            g, total = np.zeros_like(w), 0.0
            for r in data.mapInPandas(_gradients(w), "g array<double>, n double").collect():  # a row a task
                g, total = g + np.array(r["g"]).reshape(w.shape), total + r["n"]
            if not total:
                break
            v = self.momentum * v - self.rate * (g / abs(total) + self.decay * w)
            w = w + v
        return SoftmaxOf(w)


@dataclass
class SoftmaxOf:
    """A softmax regression by its weights: a row a column of x, and one for the constant."""

    w: np.ndarray

    def scores(self, rows: DataFrame) -> DataFrame:
        w = self.w
        return _Linear(lambda x: x @ w[:-1] + w[-1]).scores(rows)


def _gradients(w: np.ndarray):
    def go(batches):
        g, n = np.zeros_like(w), 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(float)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                t, u = np.stack(pdf["t"].to_numpy()).astype(float), pdf["u"].to_numpy()
                z = x @ w
                e = np.exp(z - z.max(1, keepdims=True))
                g += x.T @ ((e / e.sum(1, keepdims=True) - t) * u[:, None])
                n += u.sum()
        yield pd.DataFrame({"g": [g.ravel().tolist()], "n": [n]})

    return go


def _ml(name: str, binary: bool = False, **defaults) -> Callable[..., _Ml]:
    def make(**params) -> _Ml:
        import pyspark.ml.classification as ml

        return _Ml(lambda: getattr(ml, name)(**{**defaults, **params}), binary)

    return make


@dataclass
class Mlp:
    hidden: tuple[int, ...] = (256, 128)
    steps: int = 50

    def fit(self, rows: DataFrame, n_classes: int) -> Fitted:
        from pyspark.ml.classification import MultilayerPerceptronClassifier

        layers = [_width(rows), *self.hidden, n_classes]
        return _Ml(lambda: MultilayerPerceptronClassifier(layers=layers, maxIter=self.steps, seed=0)).fit(rows, n_classes)


CLASSIFIERS: dict[str, Callable[..., Any]] = {
    "knn": Knn, "gaussian_nb": GaussianNB, "multinomial_nb": MultinomialNB, "bernoulli_nb": BernoulliNB, "ridge": Ridge, "svm_rbf": RbfSvm, "mlp": Mlp, "student": Student,
    "logreg": _ml("LogisticRegression", maxIter=100, regParam=0.01), "linear_svm": _ml("LinearSVC", True, maxIter=50, regParam=0.01),
    "random_forest": _ml("RandomForestClassifier", numTrees=200, seed=0), "extra_trees": _ml("RandomForestClassifier", numTrees=200, subsamplingRate=0.9, seed=0), "gradient_boosting": _ml("GBTClassifier", True, maxIter=100, maxDepth=3, seed=0),
}
#: Models of deep backbones are given by the caller: a bundle has fit(rows, n_classes) like the others.
DEEP = ["image_cnn", "image_pretrained", "audio_cnn", "audio_pretrained", "audio_cnn_scratch", "text_cnn", "lstm_scratch", "graphsage_inductive"]


def register(name: str, factory: Callable[..., Any]) -> None:
    if name in CLASSIFIERS:
        raise ValueError(f"{name} is taken")
    CLASSIFIERS[name] = factory


def build(name: str, **params) -> Any:
    if name in DEEP and name not in CLASSIFIERS:
        raise NotImplementedError(f"{name} needs a bundle: register() a factory")
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {name!r}; there are {sorted(CLASSIFIERS)}")
    return CLASSIFIERS[name](**params)


def predicted(scores: DataFrame) -> DataFrame:
    """(id, x) with p, the first class of greatest score, and conf."""
    return scores.select("id", "x", argmax("x").alias("p"), F.array_max("x").alias("conf"))
