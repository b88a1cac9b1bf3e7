"""Iterated graph algorithms: propagation, spreading, diffusion, and solvers by conjugate gradients.

A state is a table (id, x) with an array of one double per class. A step is a join of edges with the state on src and
partial sums by dst. Each step is written to the folder that driver and executors share and read again: plans stay
short, a lost executor costs a step, and the planner knows the size of what it joins. What the driver sees of a step
is a number per class.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import argmax, normalised
from tessera.operators.edges import normalized, spmm

EVERY = 5


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and all runs on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not given and own.isDefined():
        given = own.get()
    if not given:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(given)
    home = f"{given.rstrip('/')}/steps-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_remove, spark, home)
    return home


_homes: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    if path := getattr(df, "_cut_at", None):
        _remove(df.sparkSession, path)


def zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0)] * n)


def onehot(labels: DataFrame, n_classes: int) -> DataFrame:
    """(id, y with -1 for none) to (id, x, known)."""
    row = F.array(*[F.when(F.col("y") == c, 1.0).otherwise(0.0) for c in range(n_classes)])
    return labels.select("id", row.alias("x"), (F.col("y") >= 0).alias("known"))


def n_classes_of(labels: DataFrame) -> int:
    top = labels.filter("y >= 0").agg(F.max("y").alias("m")).first()["m"]
    if top is None:
        raise ValueError("no labelled node")
    return int(top) + 1


def residual(new: DataFrame, old: DataFrame) -> float:
    """Greatest change of any entry."""
    d = new.join(old.select("id", F.col("x").alias("o")), "id").select(F.array_max(F.zip_with("x", "o", lambda a, b: F.abs(a - b))).alias("d"))
    return d.agg(F.max("d").alias("d")).first()["d"] or 0.0


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, tol: float | None = None, every: int = EVERY) -> DataFrame:
    """n steps, or until the greatest change is at most tol (looked at every few steps); a warning if it never is.

    Each step is cut: a plan of several steps takes longer to plan than its steps to run, and a lost executor costs one step.
    """
    made: DataFrame | None = None
    for i in range(1, n + 1):
        new, change = cut(step(state)) if i < n else step(state), None
        if tol is not None and i < n and (i % every == 0 or i == n - 1):
            change = residual(new, state)
        if i < n and made is not None:
            drop(made)
        if change is not None and change <= tol:
            return new
        if change is not None and i == n - 1:
            warnings.warn(f"{n} steps: entries still change by {change:.2g}, more than {tol:.2g}", stacklevel=2)
        made = state = new
    return state


def _spread(edges: DataFrame, state: DataFrame, size: int) -> DataFrame:
    """P x for every node of the state; nodes without an edge get zeros."""
    return _gathered(edges, state, size, {}).select("id", "x")


def _gathered(edges: DataFrame, state: DataFrame, size: int, kept: dict[str, Column]) -> DataFrame:
    """(id, x = P x, and columns of the state as they are): the state's own rows go into the sums with weight zero, so that no join back is needed."""
    met = edges.join(state.select(F.col("id").alias("src"), "x"), "src")
    sent = met.select(F.col("dst").alias("id"), *[(F.col("w") * F.col("x")[i]).alias(f"_{i}") for i in range(size)], F.lit(False).alias("_own"), *[F.lit(None).cast(state.select(c).schema[0].dataType).alias(k) for k, c in kept.items()])
    own = state.select("id", *[F.lit(0.0).alias(f"_{i}") for i in range(size)], F.lit(True).alias("_own"), *[c.alias(k) for k, c in kept.items()])
    sums = sent.unionAll(own).groupBy("id").agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(size)], F.max("_own").alias("_own"), *[F.max(k).alias(k) for k in kept])
    return sums.filter("_own").select("id", F.array(*[f"_{i}" for i in range(size)]).alias("x"), *kept)


def _known_class(labels: DataFrame, n_classes: int) -> DataFrame:
    """(id, x, y): onehot rows and the class, null where there is none."""
    row = F.array(*[F.when(F.col("y") == c, 1.0).otherwise(0.0) for c in range(n_classes)])
    return labels.select("id", row.alias("x"), F.when(F.col("y") >= 0, F.col("y")).cast("int").alias("y"))


def label_propagation(edges: DataFrame, labels: DataFrame, n_classes: int, steps: int = 200, tol: float | None = 1e-6, norm: str = "rw") -> DataFrame:
    """F <- P F, labelled rows clamped, rows divided by their sums."""
    p, start = cut(normalized(edges, norm, "dst")), cut(_known_class(labels, n_classes))
    given = F.array(*[F.when(F.col("y") == c, 1.0).otherwise(0.0) for c in range(n_classes)])

    def step(f: DataFrame) -> DataFrame:
        return _gathered(p, f, n_classes, {"y": F.col("y")}).select("id", F.when(F.col("y").isNotNull(), given).otherwise(normalised("x")).alias("x"), "y")

    return iterate(start, step, steps, tol).select("id", "x")


def label_spreading(edges: DataFrame, labels: DataFrame, n_classes: int, steps: int = 200, alpha: float = 0.99, tol: float | None = 1e-6, norm: str = "sym") -> DataFrame:
    """F <- alpha S F + (1 - alpha) Y, no clamp."""
    return fixed_point(edges, onehot(labels, n_classes).select("id", "x"), n_classes, steps, alpha, tol, norm)


def fixed_point(edges: DataFrame, y: DataFrame, size: int, steps: int, alpha: float = 0.99, tol: float | None = None, norm: str = "sym", by: str = "dst") -> DataFrame:
    p, start = cut(normalized(edges, norm, by)), cut(y.select("id", "x", F.col("x").alias("y")))
    kept = {f"y{i}": F.col("y")[i] for i in range(size)}

    def step(f: DataFrame) -> DataFrame:
        back = F.array(*kept)
        return _gathered(p, f, size, kept).select("id", F.zip_with("x", back, lambda a, b: alpha * a + (1 - alpha) * b).alias("x"), back.alias("y"))

    return iterate(start, step, steps, tol).select("id", "x")


def diffusion_view(edges: DataFrame, x: DataFrame, size: int, steps: int, alpha: float = 0.1) -> DataFrame:
    """H <- (1 - alpha) P H + alpha X; P has rows by source, normalized by source: node i gathers from the ends of its edges."""
    p = normalized(edges, "rw", "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return fixed_point(p, x, size, steps, 1 - alpha, None, "none")


def propagated(edges: DataFrame, x: DataFrame, size: int, steps: int, norm: str = "sym") -> DataFrame:
    """S^k X: the features of a simplified graph convolution."""
    p = cut(normalized(edges, norm, "dst"))
    return iterate(x, lambda f: _spread(p, f, size), steps)


def personalized(edges: DataFrame, h: DataFrame, size: int, steps: int = 10, alpha: float = 0.1, norm: str = "sym") -> DataFrame:
    """Z <- (1 - alpha) S Z + alpha H: predictions spread by personalized page rank."""
    return fixed_point(edges, h, size, steps, 1 - alpha, None, norm)


def laplacian(edges: DataFrame, x: DataFrame, size: int, norm: str = "sym") -> DataFrame:
    """x - S x (sym, rw), or D x - W x (none); degrees by destination."""
    if norm == "none":
        deg = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("deg"))
        out = _spread(edges, x, size).select("id", F.col("x").alias("s"))
        met = x.join(out, "id").join(deg, "id", "left")
        return met.select("id", F.zip_with("x", "s", lambda a, b: a * F.coalesce("deg", F.lit(0.0)) - b).alias("x"))
    out = _spread(normalized(edges, norm, "dst"), x, size).select("id", F.col("x").alias("s"))
    return x.join(out, "id").select("id", F.zip_with("x", "s", lambda a, b: a - b).alias("x"))


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _dots(df: DataFrame, pairs: list[tuple[str, str]], size: int) -> list[np.ndarray]:
    row = df.agg(*[F.sum(F.col(a)[i] * F.col(b)[i]).alias(f"{k}_{i}") for k, (a, b) in enumerate(pairs) for i in range(size)]).first()
    return [np.array([row[f"{k}_{i}"] or 0.0 for i in range(size)]) for k in range(len(pairs))]


def conjugate_gradients(matvec: Callable[[DataFrame], DataFrame], b: DataFrame, size: int, tol: float = 1e-6, max_iter: int = 200) -> tuple[DataFrame, int, float]:
    """Solves A x = b for all columns at once, A symmetric and positive; stops when every residual norm is at most tol (absolute), and warns if none does.

    An iteration writes one table and takes all its sums in one go: the new residual is r - alpha A p, whose square
    follows from the sums r r, r A p and A p A p.
    """
    state = cut(b.select("id", zeros(size).alias("x"), F.col("x").alias("r"), F.col("x").alias("p")))
    (rr,) = _dots(state, [("r", "r")], size)
    for i in range(max_iter):
        if np.sqrt(rr).max() <= tol:
            return state.select("id", "x"), i, float(np.sqrt(rr).max())
        ap = matvec(state.select("id", F.col("p").alias("x"))).select("id", F.col("x").alias("ap"))
        met = cut(state.join(ap, "id"))
        drop(state)
        rr, pap, rap, apap = _dots(met, [("r", "r"), ("p", "ap"), ("r", "ap"), ("ap", "ap")], size)
        alpha = np.divide(rr, pap, out=np.zeros(size), where=pap > 0)
        new = np.maximum(rr - 2 * alpha * rap + alpha**2 * apap, 0.0)
        beta = np.divide(new, rr, out=np.zeros(size), where=rr > 0)
        given = F.arrays_zip(*[F.col(k).alias(k) for k in ("x", "r", "p", "ap")], _array(alpha).alias("alpha"), _array(beta).alias("beta"))
        x = F.transform(given, lambda z: z["x"] + z["alpha"] * z["p"])
        r = F.transform(given, lambda z: z["r"] - z["alpha"] * z["ap"])
        p = F.transform(given, lambda z: z["r"] - z["alpha"] * z["ap"] + z["beta"] * z["p"])
        state = met.select("id", x.alias("x"), r.alias("r"), p.alias("p"))
        state._cut_at = met._cut_at
        rr = new
    left = float(np.sqrt(rr).max())
    if left > tol:
        warnings.warn(f"{max_iter} iterations: a residual of {left:.2g} is left, more than {tol:.2g}", stacklevel=2)
    return state.select("id", "x"), max_iter, left


def affinity(edges: DataFrame) -> DataFrame:
    """Symmetric, no diagonal: the mean of both directions, absent ones being 0."""
    half = edges.filter("src <> dst").select("src", "dst", (F.col("w") / 2).alias("w"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def laplace_learning(edges: DataFrame, labels: DataFrame, n_classes: int, tol: float = 1e-8, max_iter: int = 500) -> DataFrame:
    """Harmonic: L_uu F_u = W_ul Y_l on unlabelled nodes, labels kept. A part of the graph without a label stays 0."""
    w, y = cut(affinity(edges)), cut(onehot(labels, n_classes))
    free = cut(y.filter("not known").select("id"))
    deg = cut(w.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("deg")))
    inner = cut(w.join(free.select(F.col("id").alias("src")), "src", "left_semi").join(free.select(F.col("id").alias("dst")), "dst", "left_semi"))
    b = spmm(w, y.filter("known").select("id", "x"), n_classes).select("id", F.col("x").alias("b"))
    b = free.join(b, "id", "left").select("id", F.coalesce("b", zeros(n_classes)).alias("x"))

    def matvec(x: DataFrame) -> DataFrame:
        s = spmm(inner, x, n_classes).select("id", F.col("x").alias("s"))
        met = x.join(deg, "id", "left").join(s, "id", "left")
        return met.select("id", F.zip_with("x", F.coalesce("s", zeros(n_classes)), lambda a, c: a * F.coalesce("deg", F.lit(0.0)) - c).alias("x"))

    out, _, _ = conjugate_gradients(matvec, b, n_classes, tol, max_iter)
    return out.unionByName(y.filter("known").select("id", "x"))


def lazy_random_walk(edges: DataFrame, labels: DataFrame, alpha: float = 0.99, tol: float = 1e-8, max_iter: int = 500) -> DataFrame:
    """Two classes: (I - alpha S) f = y with y in {1, -1, 0}; hard 0 / 1 rows. An isolated node is an error."""
    s = cut(affinity(edges))
    if labels.join(s.select(F.col("dst").alias("id")), "id", "left_anti").limit(1).count():
        raise ValueError("isolated nodes")
    s = cut(normalized(s, "sym", "dst"))
    b = labels.select("id", F.array(F.when(F.col("y") == 1, 1.0).when(F.col("y") == 0, -1.0).otherwise(0.0)).alias("x"))

    def matvec(x: DataFrame) -> DataFrame:
        out = _spread(s, x, 1).select("id", F.col("x").alias("s"))
        return x.join(out, "id").select("id", F.zip_with("x", "s", lambda a, c: a - alpha * c).alias("x"))

    f, _, _ = conjugate_gradients(matvec, b, 1, tol, max_iter)
    one = F.when(F.col("x")[0] >= 0, 1.0).otherwise(0.0)
    return f.select("id", F.array(1.0 - one, one).alias("x"))


def poisson_sources(labels: DataFrame, n_classes: int, centred: bool = True) -> DataFrame:
    """Onehot minus the mean over labelled nodes, on labelled nodes; or onehot minus its mean over all nodes."""
    y = onehot(labels, n_classes)
    scope = y.filter("known") if centred else y.withColumn("x", F.when(F.col("known"), F.col("x")).otherwise(zeros(n_classes)))
    means = scope.agg(*[F.avg(F.col("x")[c]).alias(str(c)) for c in range(n_classes)]).first()
    mean = _array([means[str(c)] for c in range(n_classes)])
    off = F.zip_with(F.when(F.col("known"), F.col("x")).otherwise(zeros(n_classes)), mean, lambda a, m: a - m)
    return y.select("id", (F.when(F.col("known"), off).otherwise(zeros(n_classes)) if centred else off).alias("x"))


def poisson_learning(edges: DataFrame, labels: DataFrame, n_classes: int, norm: str = "sym", eps: float = 1e-6, tol: float = 1e-6, max_iter: int = 200, centred: bool = True) -> DataFrame:
    """(L + eps I + 11'/n) f = b for each class."""
    labels = cut(labels)
    edges, b = cut(edges), poisson_sources(labels, n_classes, centred)

    def matvec(x: DataFrame) -> DataFrame:
        row = x.agg(*[F.avg(F.col("x")[c]).alias(str(c)) for c in range(n_classes)]).first()
        mean = _array([row[str(c)] for c in range(n_classes)])
        out = laplacian(edges, x, n_classes, norm).select("id", F.col("x").alias("l"))
        return x.join(out, "id").select("id", F.transform(F.arrays_zip(F.col("x").alias("x"), F.col("l").alias("l"), mean.alias("m")), lambda z: z["l"] + eps * z["x"] + z["m"]).alias("x"))

    f, _, _ = conjugate_gradients(matvec, b, n_classes, tol, max_iter)
    return f


def poisson_mbo(edges: DataFrame, labels: DataFrame, n_classes: int, steps: int = 200, outer: int = 20, inner: int = 40, mu: float = 1.0, d_tau: float = 10.0, limits: tuple[float, float] = (0.5, 2.0), volume_steps: int = 100, prior: list[float] | None = None) -> DataFrame:
    """Poisson iterations, then rounds of diffusion with sources and a projection to classes whose volumes meet the prior."""
    labels = cut(labels)
    w = cut(affinity(edges))
    b = cut(poisson_sources(labels, n_classes))
    known = labels.filter("y >= 0")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = np.array([counts.get(c, 0) for c in range(n_classes)], float) / max(1, sum(counts.values()))
    if (share == 0).any():
        raise ValueError("a class without a labelled node")
    want = np.array(prior, float) / sum(prior) if prior else np.full(n_classes, 1 / n_classes)
    deg = w.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("deg"))
    deg = cut(deg)
    top = deg.agg(F.max("deg").alias("m")).first()["m"]
    if not top or top <= 0:
        raise ValueError("no edge with a positive weight")

    def step(rate: Callable[[Column], Column], force: float) -> Callable[[DataFrame], DataFrame]:
        def go(u: DataFrame) -> DataFrame:
            met = u.join(_spread(w, u, n_classes).select("id", F.col("x").alias("s")), "id").join(b.select("id", F.col("x").alias("b")), "id").join(deg, "id", "left")
            d = F.coalesce("deg", F.lit(0.0))
            return met.select("id", F.transform(F.arrays_zip(F.col("x").alias("x"), F.col("s").alias("s"), F.col("b").alias("b")), lambda z: z["x"] + rate(d) * (force * z["b"] - d * z["x"] + z["s"])).alias("x"))

        return go

    u = iterate(b.select("id", zeros(n_classes).alias("x")), step(lambda d: F.when(d > 0, 1 / d).otherwise(0.0), 1.0), steps)
    u = u.select("id", F.zip_with("x", _array(want / share), lambda a, c: a * c).alias("x"))
    for _ in range(outer):
        u = cut(iterate(u, step(lambda d: F.lit(1.0 / top), mu), inner))
        s = np.ones(n_classes)
        for _ in range(volume_steps):
            got = {r["c"]: r["n"] for r in u.groupBy(argmax(F.zip_with("x", _array(s), lambda a, c: a * c)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
            new = np.clip(s + d_tau * (want - np.array([got.get(c, 0) for c in range(n_classes)]) / max(1, sum(got.values()))), *limits)
            if np.array_equal(new, s):
                break
            s = new
        pick = argmax(F.zip_with("x", _array(s), lambda a, c: a * c))
        u = u.select("id", pick.alias("c")).select("id", F.array(*[F.when(F.col("c") == c, 1.0).otherwise(0.0) for c in range(n_classes)]).alias("x"))
    return u


def p_laplace(edges: DataFrame, labels: DataFrame, n_classes: int, p: float = 3.0, steps: int = 10, eps: float = 1e-12, tol: float = 1e-8, max_iter: int = 200) -> DataFrame:
    """Rounds of weighted harmonic solves with weights w |f_i - f_j|^(p - 2), one class against the rest; softmax of the scores."""
    if p < 2:
        raise ValueError("p is at least 2")
    labels = cut(labels)
    w, outs = cut(affinity(edges)), None
    for c in range(n_classes):
        two = labels.select("id", F.when(F.col("y") < 0, -1).when(F.col("y") == c, 0).otherwise(1).alias("y"))
        f = laplace_learning(w, two, 2, tol, max_iter)
        for _ in range(steps if p > 2 else 0):
            s, t = f.select(F.col("id").alias("src"), F.col("x")[0].alias("fs")), f.select(F.col("id").alias("dst"), F.col("x")[0].alias("ft"))
            again = w.join(s, "src").join(t, "dst").select("src", "dst", (F.col("w") * F.pow(F.abs(F.col("fs") - F.col("ft")) + 1e-6, p - 2) + eps).alias("w"))
            half = laplace_learning(cut(again), two, 2, tol, max_iter).select("id", F.col("x").alias("n"))
            f = cut(f.join(half, "id").select("id", F.zip_with("x", "n", lambda a, b: a + (b - a) / (p - 1)).alias("x")))
        one = f.select("id", F.col("x")[0].alias(f"_{c}"))
        outs = one if outs is None else outs.join(one, "id")
    from tessera.functions.vectors import softmax

    return outs.select("id", softmax(F.array(*[f"_{c}" for c in range(n_classes)])).alias("x"))


def predictions(scores: DataFrame) -> DataFrame:
    return scores.select("id", argmax("x").alias("p"))


