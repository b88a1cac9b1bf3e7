"""Methods that work on a whole problem: a cut is fetched behind a check of its size, else refused; dynamic
label propagation needs memory for the edges and a few states alone, at any size."""

from __future__ import annotations

from collections import deque
from tempfile import TemporaryFile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.local import Sparse, fetched, framed, placed
from tessera.operators.propagate import affinity, cut, drop

MAX_NODES, MAX_EDGES = 200_000, 2_000_000


def _fetch(edges: DataFrame, labels: DataFrame, most: int = MAX_NODES) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = labels.select("id", "y").orderBy("id").limit(most + 1).collect()
    found = edges.select("src", "dst", "w").limit(MAX_EDGES + 1).collect()
    if len(rows) > most or len(found) > MAX_EDGES:
        raise ValueError("the graph is too large for this method")
    at = {r["id"]: i for i, r in enumerate(rows)}
    cols = [np.array([f(r) for r in found]) for f in (lambda r: at[r["src"]], lambda r: at[r["dst"]], lambda r: r["w"])]
    return [r["id"] for r in rows], np.array([r["y"] for r in rows]), *cols


def _frame(labels: DataFrame, ids: list, x: np.ndarray) -> DataFrame:
    return labels.sparkSession.createDataFrame([(i, row.tolist()) for i, row in zip(ids, x.astype(float), strict=True)], "id long, x array<double>")


def min_cut(n: int, arcs: list[tuple[int, int, int]], s: int, t: int) -> np.ndarray:
    """The source side of a least cut, by blocking flows: levels by breadth, then paths by depth without recursion."""
    head, to, cap = [[] for _ in range(n)], [], []
    for a, b, c in arcs:
        for u, v, w in ((a, b, c), (b, a, 0)):
            head[u].append(len(to))
            to.append(v)
            cap.append(w)
    while True:
        level, queue = [-1] * n, deque([s])
        level[s] = 0
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([v >= 0 for v in level])
        at, path, u = [0] * n, [], s
        while True:
            if u == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                cutoff = next(i for i, e in enumerate(path) if cap[e] == 0)
                path, u = path[:cutoff], to[path[cutoff] ^ 1]
                continue
            while at[u] < len(head[u]) and not (cap[head[u][at[u]]] > 0 and level[to[head[u][at[u]]]] == level[u] + 1):
                at[u] += 1
            if at[u] < len(head[u]):
                path.append(head[u][at[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def graph_mincut(edges: DataFrame, labels: DataFrame, scale: float = 1000.0, least: int = 1) -> DataFrame:
    """Two classes: a least cut between their labelled nodes; hard scores, the greater class on the source side."""
    ids, y, src, dst, w = _fetch(edges, labels)
    classes = sorted(set(y[y >= 0].tolist()))
    if len(classes) != 2:
        raise ValueError("two labelled classes are needed")
    cap = np.maximum(np.rint(w * scale).astype(int), least)
    n, inf = len(ids), int(cap.sum()) + 1
    arcs = list(zip(src.tolist(), dst.tolist(), cap.tolist(), strict=True)) + [(n, i, inf) for i in np.nonzero(y == classes[1])[0]] + [(i, n + 1, inf) for i in np.nonzero(y == classes[0])[0]]
    side = min_cut(n + 2, arcs, n, n + 1)[:n].astype(float)
    return _frame(labels, ids, np.stack([1 - side, side], axis=1))


def _local(edges: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids ascending, their classes, and (row, column, weight) of the edges by row and column, in numpy: 24 bytes an edge, fetched in parts."""
    nodes = cut(labels.select(F.col("id").cast("long").alias("id"), F.col("y").cast("long").alias("y")))
    ids, y = fetched(nodes, "id")
    order = np.argsort(ids, kind="stable")
    ids, y = ids[order], y[order]
    found = cut(edges.select(F.col("dst").cast("long").alias("dst"), F.col("src").cast("long").alias("src"), F.col("w").cast("double").alias("w")))
    dst, src, w = fetched(found, "dst")
    dst, src = placed(ids, dst), placed(ids, src)
    order = np.lexsort((src, dst))
    drop(nodes)
    drop(found)
    return ids, y, dst[order], src[order], w[order]


class _Pile:
    """Arrays of one shape on a file of the driver, the last on top: what a method looks back at needs no memory."""

    def __init__(self, shape: tuple[int, int]) -> None:
        self.shape, self.file = shape, TemporaryFile()  # noqa: SIM115

    def put(self, at: int, x: np.ndarray) -> None:
        self.file.seek(at * x.nbytes)
        self.file.write(np.ascontiguousarray(x).data)

    def get(self, at: int) -> np.ndarray:
        self.file.seek(at * 8 * self.shape[0] * self.shape[1])
        return np.fromfile(self.file, float, self.shape[0] * self.shape[1]).reshape(self.shape)


def dynamic_label_propagation(edges: DataFrame, labels: DataFrame, n_classes: int, k: int = 10, alpha: float = 0.05, lam: float = 0.1, steps: int = 30) -> DataFrame:
    """Y <- P_t Y with clamp; P_t <- P (P_t + alpha Y Y') P' + lam I, P keeping the k greatest entries of a row.

    Rows of Y are divided by their sums, and P_t by its greatest row sum where that exceeds 1: else Y Y' grows without bound.

    P_t is dense and never made. Its product with a few columns unrolls to products with P', down to P_0, and with P up
    again; one more column gives its row sums. This takes steps^2 sparse products with n_classes + 1 columns on the
    driver, which holds the edges and a few states; the states looked back at lie on a file.
    """
    ids, y, row, col, w = _local(affinity(edges), labels)
    n = len(ids)
    deg = np.bincount(row, w, n)
    if (deg <= 0).any():
        raise ValueError("isolated nodes")
    w = w / deg[row]
    p0 = Sparse(row, col, w, n)
    order = np.lexsort((col, -w, row))
    kept = order[np.arange(len(order)) - p0.starts[row] < k]
    row, col, w = row[kept], col[kept], w[kept]
    w = w / np.maximum(np.bincount(row, w, n), 1e-12)[row]
    p, back = Sparse(row, col, w, n), Sparse(col, row, w, n)
    y0 = (y[:, None] == np.arange(n_classes)).astype(float)
    f, known, most = y0.copy(), y >= 0, []
    past, down = _Pile((n, n_classes)), _Pile((n, n_classes + 1))
    for t in range(steps):
        g = np.concatenate([f, np.ones((n, 1))], axis=1)
        for s in range(t, 0, -1):
            down.put(s, g)
            g = back @ g
        h = p0 @ g
        for s in range(t):
            then = past.get(s)
            h += alpha * (then @ (then.T @ g))
            g = down.get(s + 1)
            h = p @ h + lam * g
            if s == t - 1:
                most.append(max(1.0, h[:, -1].max()))
            h /= most[s]
        new = h[:, :-1]
        new = new / np.maximum(new.sum(1, keepdims=True), 1e-300)
        new[known] = y0[known]
        past.put(t, f)
        f = new
    return framed(labels.sparkSession, ids, f)


def tsvm(nodes: DataFrame, rounds: int = 10, epochs: int = 5, rate: float = 0.1, c_l: float = 1.0, c_max: float = 1.0, l2: float = 1.0, balance: bool = True) -> DataFrame:
    """Two classes, rows (id, x, y): a linear SVM by subgradients whose unlabelled rows count more and more; (id, x).

    Gradients are sums over tasks; the model is a vector on the driver. Labels of the pool are its signs, and if all
    have one sign, as many of the least sure as the labelled share asks for get the other.
    """
    rows = cut(nodes.select("id", F.col("x").cast("array<double>").alias("x"), F.when(F.col("y") == 1, 1.0).when(F.col("y") == 0, -1.0).otherwise(0.0).alias("t")))
    d = rows.select(F.size("x").alias("n")).first()["n"]
    share = rows.filter("t <> 0").agg(F.avg(F.when(F.col("t") > 0, 1.0).otherwise(0.0)).alias("s")).first()["s"]
    if share is None:
        raise ValueError("no labelled row")
    w, b = np.zeros(d), 0.0
    for i in range(rounds + 1):
        c_u = 0.0 if i == 0 else min(c_max, 1e-3 * 10 ** (i - 1))
        cutoff = 0.0
        if c_u and balance:
            r = _margins(rows, w, b).filter("t = 0").agg(F.count_if(F.col("f") >= 0).alias("p"), F.count(F.lit(1)).alias("n"), F.percentile_approx("f", max(0.0, 1 - share)).alias("q")).first()
            cutoff = r["q"] if r["n"] and r["p"] in (0, r["n"]) else 0.0
        for _ in range(epochs):
            n, gw, gb = 0, np.zeros(d), 0.0
            for r in rows.select("x", "t").mapInPandas(_hinge(w, b, cutoff, c_l, c_u), "n long, g array<double>, b double").collect():  # a row a task
                n, gw, gb = n + r["n"], gw + np.array(r["g"]), gb + r["b"]
            n = max(n, 1)
            w, b = w - rate * (l2 * w - gw / n) / (1 + i), b + rate * (gb / n) / (1 + i)
    one = F.when(F.col("f") >= 0, 1.0).otherwise(0.0)
    return _margins(rows, w, b).select("id", F.array(1.0 - one, one).alias("x"))


def _margins(rows: DataFrame, w: np.ndarray, b: float) -> DataFrame:
    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(np.stack(x.to_numpy()) @ w + b) if len(x) else pd.Series([], dtype=float)

    return rows.withColumn("f", of("x"))


def _hinge(w: np.ndarray, b: float, cutoff: float, c_l: float, c_u: float):
    """Sums of the subgradient over the rows inside the margin; rows without a label have the sign of their own margin."""

    def go(batches):
        n, g, gb = 0, np.zeros(len(w)), 0.0
        for pdf in batches:
            if len(pdf):
                x, t = np.stack(pdf["x"].to_numpy()).astype(float), pdf["t"].to_numpy()
                f = x @ w + b
                sign = np.where(t != 0, t, np.where(f >= cutoff, 1.0, -1.0))
                c = np.where(t != 0, c_l, c_u) * ((sign * f < 1) & (np.where(t != 0, c_l, c_u) > 0)) * sign
                n, g, gb = n + int(np.count_nonzero(c)), g + c @ x, gb + c.sum()
        yield pd.DataFrame({"n": [n], "g": [g.tolist()], "b": [float(gb)]})

    return go
