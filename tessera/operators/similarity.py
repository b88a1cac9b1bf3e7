"""Similarity joins: exact k nearest neighbours and epsilon pairs by blocks, and anchor graphs.

Rows are dealt to blocks; a task holds two blocks and multiplies them with BLAS. Every pair of blocks is met once for
each direction that is asked for; nothing is broadcast, and no task holds more than two blocks. Epsilon pairs skip
pairs of blocks that a projection proves to be farther apart than epsilon. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.seeds import ticket
from tessera.functions.vectors import as_double, dot

BLOCK_ROWS = 4096
#: Rows of an anchor's tile, rows of a panel that stays in a cache, and parts into which the rows of a key are dealt.
TILE_ROWS, PANEL, SALTS = 2048, 64, 64
PAIR = "src long, dst long, d double"


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norm = lambda x: np.maximum(np.linalg.norm(x, axis=1), 1e-12)
        return 1.0 - (a @ b.T) / norm(a)[:, None] / norm(b)[None, :]
    if metric == "euclidean":
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))
    raise ValueError(f"unknown metric {metric!r}")


def _blocked(df: DataFrame, blocks: int, id_col: str, x_col: str) -> DataFrame:
    """Rows without an id, or whose vector is null or holds a null, are near nothing; an id that is no whole number is an error."""
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be whole numbers")
    v = F.col(x_col)
    df = df.filter(F.col(id_col).isNotNull() & F.coalesce(~F.exists(v, lambda e: e.isNull()), F.lit(False)))
    return df.select(F.col(id_col).cast("long").alias("id"), as_double(x_col).alias("x"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))


def _paired(queries: DataFrame, base: DataFrame, blocks_q: int, blocks_b: int) -> DataFrame:
    """(q, b, side, id, x): each query block with each base block."""
    left = queries.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks_b - 1)))).select(F.col("block").alias("q"), "b", F.lit(0).alias("side"), "id", "x")
    right = base.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1)))).select("q", F.col("block").alias("b"), F.lit(1).alias("side"), "id", "x")
    return left.unionByName(right)


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", x_col: str = "x", itself: bool = False, block_rows: int | None = None, exact: bool = False) -> DataFrame:
    """(src, dst, d): the k base rows nearest to each query, distances ascending; a row is no neighbour of its own id unless `itself`; `exact`: as in exact_distances."""
    bq, bb = (max(1, math.ceil(n / (block_rows or BLOCK_ROWS))) for n in (queries.count(), base.count()))
    pairs = _paired(_blocked(queries, bq, id_col, x_col), _blocked(base, bb, id_col, x_col), bq, bb)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q, b = pdf[pdf["side"] == 0].sort_values("id"), pdf[pdf["side"] == 1].sort_values("id")
        if q.empty or b.empty:
            return pd.DataFrame({"src": [], "dst": [], "d": []})
        ids_q, ids_b = q["id"].to_numpy(), b["id"].to_numpy()
        x, y = np.stack(q["x"].to_numpy()).astype(float), np.stack(b["x"].to_numpy()).astype(float)
        d = exact_distances(x, y, metric)[0] if exact else distances(x, y, metric)
        if not itself:
            d[ids_q[:, None] == ids_b[None, :]] = np.inf
        d[~np.isfinite(d)] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]  # base rows are by id, so that ties go to the smaller
        got = np.take_along_axis(d, order, axis=1)
        keep = np.isfinite(got)
        return pd.DataFrame({"src": np.repeat(ids_q, order.shape[1])[keep.ravel()], "dst": ids_b[order.ravel()][keep.ravel()], "d": got.ravel()[keep.ravel()]})

    near = pairs.groupBy("q", "b").applyInPandas(best, PAIR)
    if bb == 1:
        return near
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return near.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def knn(nodes: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", x_col: str = "x", block_rows: int | None = None) -> DataFrame:
    return nearest(nodes, nodes, k, metric, id_col, x_col, block_rows=block_rows)


def epsilon_pairs(nodes: DataFrame, radius: float, metric: str = "euclidean", id_col: str = "id", x_col: str = "x") -> DataFrame:
    """(src, dst, d) for all ordered pairs at distance `radius` or less, without loops.

    Blocks are ranges of a projection to one direction. A projection never lengthens a euclidean distance, so two
    blocks whose ranges are farther apart than the radius hold no pair and are never brought together.
    """
    n = nodes.count()
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    rows = nodes.select(F.col(id_col).cast("long").alias("id"), as_double(x_col).alias("x"))
    if blocks > 1 and metric == "euclidean":
        d = rows.select(F.size("x").alias("n")).first()["n"]
        u = np.random.default_rng(5).normal(size=d)
        p = dot("x", F.array(*[F.lit(float(v)) for v in u / np.linalg.norm(u)]))
        rows = rows.withColumn("p", p)
        cuts = rows.approxQuantile("p", [i / blocks for i in range(1, blocks)], 0.1 / blocks)
        rows = rows.withColumn("block", F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda s, c: s + F.when(F.col("p") > c, 1).otherwise(0)))
    else:
        rows = rows.withColumns({"p": F.lit(0.0), "block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")})
    bounds = rows.groupBy("block").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    other = bounds.select(F.col("block").alias("b"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = bounds.join(F.broadcast(other), (F.col("block") <= F.col("b")) & (F.col("low2") <= F.col("high") + radius) & (F.col("low") <= F.col("high2") + radius))  # a row a block
    meet = meet.select(F.col("block").alias("a"), "b")
    left = rows.join(meet, F.col("block") == F.col("a")).select("a", "b", F.lit(0).alias("side"), "id", "x")
    right = rows.join(meet.filter("a <> b"), F.col("block") == F.col("b")).select("a", "b", F.lit(1).alias("side"), "id", "x")

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        q, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        alone = b.empty and pdf["a"].iloc[0] == pdf["b"].iloc[0]
        b = q if alone else b
        if q.empty or b.empty:
            return pd.DataFrame({"src": [], "dst": [], "d": []})
        d = distances(np.stack(q["x"].to_numpy()).astype(float), np.stack(b["x"].to_numpy()).astype(float), metric)
        i, j = np.nonzero(d <= radius)
        s, t, w = q["id"].to_numpy()[i], b["id"].to_numpy()[j], d[i, j]
        if alone:
            off = s != t
            s, t, w = s[off], t[off], w[off]
        else:
            s, t, w = np.concatenate([s, t]), np.concatenate([t, s]), np.concatenate([w, w])
        return pd.DataFrame({"src": s, "dst": t, "d": w})

    return left.unionByName(right).groupBy("a", "b").applyInPandas(close, PAIR)


def anchors(nodes: DataFrame, seed: int, n_anchors: int | None = None, id_col: str = "id") -> DataFrame:
    """Random anchors: max(10, round(sqrt n)) rows of least ticket, n at most."""
    n = nodes.count()
    m = min(n, n_anchors or max(10, round(math.sqrt(n))))
    return nodes.orderBy(ticket(seed, "anchor", id_col), id_col).limit(m)


def exact_distances(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows of a to rows of b, and the same from b's side: sums run from the first column to the last, as in SQL.

    Unlike products of blocks by BLAS, they depend on the two vectors alone, so that ties are ties wherever they are met.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    for i in range(0, len(a), PANEL):
        part = out[i : i + PANEL]
        term = np.empty_like(part)
        for c in range(a.shape[1]):
            if metric == "cosine":
                np.multiply(a[i : i + PANEL, c, None], columns[c], out=term)
            else:
                np.subtract(a[i : i + PANEL, c, None], columns[c], out=term)
                np.multiply(term, term, out=term)
            part += term
    if metric == "euclidean":
        np.sqrt(out, out=out)
        return out, out.T

    def norm(x: np.ndarray) -> np.ndarray:
        square = np.zeros(len(x))
        for c in range(x.shape[1]):
            square += x[:, c] * x[:, c]
        return np.maximum(np.sqrt(square), 1e-12)

    ra, rb = norm(a), norm(b)
    return 1.0 - out / ra[:, None] / rb[None, :], 1.0 - (out / rb[None, :] / ra[:, None]).T


def _least_in_rows(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least finite entries of each row; ties go to the first column."""
    if k < d.shape[1]:
        i, j = np.nonzero((d <= np.partition(d, k - 1, axis=1)[:, k - 1, None]) & np.isfinite(d))
    else:
        i, j = np.nonzero(np.isfinite(d))
    order = np.lexsort((j, d[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


def _least_ids(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, ids): the k least of the ids of a key, ascending, in two rounds so that a frequent key is no single task's."""
    least = lambda lists: F.slice(F.array_sort(lists), 1, k)
    first = df.groupBy(*keys, F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("_s")).agg(least(F.collect_list("id")).alias("ids"))
    return first.groupBy(*keys).agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))


def anchor_graph(nodes: DataFrame, k: int, seed: int, per_node: int = 5, n_anchors: int | None = None, metric: str = "cosine", limit: int | None = None, id_col: str = "id", x_col: str = "x") -> DataFrame:
    """(src, dst, d): of the rows that share one of their `per_node` nearest anchors, the k nearest; `limit` candidates of least id are looked at.

    The rows of an anchor are cut into tiles, and a task holds two tiles: candidates are never written as pairs, only
    the nearest of each row in each two tiles. Rows of equal vectors have the same anchors and the same distances: they
    go as one, with the k + 1 least of their ids, of which a row leaves itself out.
    """
    from tessera.operators.propagate import cut

    rows = nodes.select(F.col(id_col).alias("id"), as_double(x_col).alias("x"))
    anchored = anchors(rows, seed, n_anchors)
    if limit is not None:
        near = nearest(rows, anchored, per_node, metric, itself=True).select(F.col("src").alias("id"), F.col("dst").alias("anchor"))
        return _of_limited(rows, near, k, metric, limit)
    given = _blocked(rows, 1, "id", "x").select("id", F.transform("x", lambda v: v + 0.0).alias("x"))  # one zero
    distinct = cut(_least_ids(given, ["x"], k + 1).withColumn("node", F.monotonically_increasing_id()))  # once written, the numbers stay
    near = cut(nearest(distinct.select(F.col("node").alias("id"), "x"), anchored, per_node, metric, itself=True, exact=True).select(F.col("src").alias("n"), F.col("dst").alias("anchor")))
    tiles = near.groupBy(F.col("anchor").alias("a")).agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("tiles"))  # a row an anchor
    tiled = near.join(F.broadcast(tiles), F.col("anchor") == F.col("a")).withColumn("tile", F.pmod(F.xxhash64("n"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.join(distinct.select("node", F.col("ids")[0].alias("least"), "x"), F.col("n") == F.col("node"))
    tiled = tiled.select("anchor", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "least", "x")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["least", "node"])
        alone = pdf["low"].iloc[0] == pdf["high"].iloc[0]
        a = pdf[pdf["tile"] == pdf["low"]]
        b = a if alone else pdf[pdf["tile"] == pdf["high"]]
        if a.empty or b.empty:
            return pd.DataFrame({"src": [], "dst": [], "least": [], "d": []})
        there, back = exact_distances(np.stack(a["x"].to_numpy()).astype(float), np.stack(b["x"].to_numpy()).astype(float), metric)
        out = []
        for q, t, d in ((a, b, there), (b, a, back))[: 1 if alone else 2]:
            i, j = _least_in_rows(d, k + 1)
            out.append(pd.DataFrame({"src": q["node"].to_numpy()[i], "dst": t["node"].to_numpy()[j], "least": t["least"].to_numpy()[j], "d": d[i, j]}))
        return pd.concat(out)

    met = tiled.groupBy("anchor", "low", "high").applyInPandas(best, "src long, dst long, least long, d double")
    few = lambda lists: F.slice(F.array_sort(lists), 1, k + 1)
    top = met.groupBy("src").agg(few(F.collect_set(F.struct("d", "least", "dst"))).alias("top")).select("src", F.explode("top").alias("t")).select("src", "t.dst", "t.d")
    top = top.join(distinct.select(F.col("node").alias("dst"), F.explode("ids").alias("id")), "dst")
    top = cut(top.groupBy("src").agg(few(F.collect_list(F.struct("d", "id"))).alias("top")))
    digest = lambda c: (F.xxhash64(c).alias("d0"), F.xxhash64(F.lit(1), F.col(c)).alias("d1"))
    known = top.join(distinct.select(F.col("node").alias("src"), *digest("x")), "src").select("d0", "d1", "top")
    found = given.select("id", *digest("x")).join(known, ["d0", "d1"])
    others = F.slice(F.filter("top", lambda t: t["id"] != F.col("id")), 1, k)
    return found.select(F.col("id").alias("src"), F.explode(others).alias("t")).select("src", F.col("t.id").alias("dst"), F.col("t.d").alias("d"))


def _of_limited(rows: DataFrame, near: DataFrame, k: int, metric: str, limit: int) -> DataFrame:
    """Of an anchor no more than its limit + 1 least ids can be among a row's candidates of least id."""
    from tessera.functions.vectors import cosine_distance, euclidean

    least = _least_ids(near, ["anchor"], limit + 1).select("anchor", F.explode("ids").alias("dst"))
    pairs = near.withColumnRenamed("id", "src").join(least, "anchor").filter("src <> dst").select("src", "dst").distinct()
    pairs = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("_r") <= limit).drop("_r")
    d = cosine_distance("x", "y") if metric == "cosine" else euclidean("x", "y")
    met = pairs.join(rows.select(F.col("id").alias("src"), "x"), "src").join(rows.select(F.col("id").alias("dst"), F.col("x").alias("y")), "dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return met.select("src", "dst", d.alias("d")).withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")
