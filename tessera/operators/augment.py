"""Augmentation: row-local stochastic transforms, drawn from (seed, epoch, id, slot).

An operator is a function of a Column and a Draw to a Column; `augmented` chains some of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.seeds import normal, uniform


@dataclass(frozen=True)
class Draw:
    seed: int
    epoch: int
    id_col: str
    salt: str

    def uniform(self, *parts) -> Column:
        return uniform(self.seed, f"{self.salt}/{self.epoch}", self.id_col, *parts)

    def normal(self, *parts) -> Column:
        return normal(self.seed, f"{self.salt}/{self.epoch}", self.id_col, *parts)


def identity(x: Column, draw: Draw) -> Column:
    return x


def ensure_float32(x: Column, draw: Draw) -> Column:
    return x.cast("array<float>")


def gaussian_noise(x: Column, draw: Draw, sigma: float = 0.1) -> Column:
    return F.transform(x, lambda v, i: v + sigma * draw.normal(i))


def feature_dropout(x: Column, draw: Draw, p: float = 0.1) -> Column:
    return F.transform(x, lambda v, i: F.when(draw.uniform(i) < p, 0.0).otherwise(v))


def swap_noise(x: Column, draw: Draw, p: float = 0.15) -> Column:
    return F.transform(x, lambda v, i: F.when(draw.uniform(i) < p, draw.normal(i + 100_000)).otherwise(v))


def lowercase(x: Column, draw: Draw) -> Column:
    return F.lower(x)


def _words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def word_dropout(x: Column, draw: Draw, p: float = 0.1) -> Column:
    """Each word goes with probability p; if all would go, one stays."""
    w = _words(x)
    kept = F.filter(w, lambda v, i: draw.uniform(i) >= p)
    one = F.get(w, F.floor(draw.uniform(F.lit("one")) * F.size(w)).cast("int"))
    return F.when(F.size(w) == 0, x).when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(one)


def _swapped(a: Column, i: Column, j: Column) -> Column:
    return F.transform(a, lambda v, k: F.when(k == i, F.get(a, j)).when(k == j, F.get(a, i)).otherwise(v))


def _place(u: Column, n: Column) -> Column:
    return F.floor(u * n).cast("int")


def random_swap(x: Column, draw: Draw, n: int = 1) -> Column:
    """Two places, perhaps the same, change their words; n times."""
    w = _words(x)
    size, out = F.size(w), w
    for k in range(n):
        out = _swapped(out, _place(draw.uniform(F.lit(f"a{k}")), size), _place(draw.uniform(F.lit(f"b{k}")), size))
    return F.when(size < 2, x).otherwise(F.array_join(out, " "))


def token_mask(x: Column, draw: Draw, p: float = 0.1, mask_id: int = 1, pad_id: int = 0) -> Column:
    return F.transform(x, lambda t, i: F.when((t != pad_id) & (draw.uniform(i) < p), F.lit(mask_id).cast("long")).otherwise(t))


def token_swap(x: Column, draw: Draw, n: int = 1, pad_id: int = 0) -> Column:
    """Two different places that are no padding change their tokens; n times."""
    places = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) != pad_id)
    m, out = F.size(places), x
    for k in range(n):
        a = _place(draw.uniform(F.lit(f"a{k}")), m)
        b = (a + 1 + _place(draw.uniform(F.lit(f"b{k}")), m - 1)) % m
        out = _swapped(out, F.get(places, a), F.get(places, b))
    return F.when(m >= 2, out).otherwise(x)


def add_noise(x: Column, draw: Draw, sigma: float = 0.005) -> Column:
    return gaussian_noise(x, draw, sigma)


def time_shift(x: Column, draw: Draw, most: float = 0.1) -> Column:
    """Turned by up to this share of its length, either way."""
    n = F.size(x)
    by = F.pmod(F.floor((2 * draw.uniform(F.lit("shift")) - 1) * most * n).cast("int"), n)
    return F.when(n > 0, F.concat(F.slice(x, n - by + 1, F.greatest(by, F.lit(0))), F.slice(x, F.lit(1), n - by))).otherwise(x)


#: By name, with the parameters that they take.
OPS: dict[str, Callable[..., Column]] = {
    "core.identity": identity, "core.ensure_float32": ensure_float32, "tabular.gaussian_noise": gaussian_noise, "tabular.feature_dropout": feature_dropout, "tabular.swap_noise": swap_noise,
    "text.lowercase": lowercase, "text.word_dropout": word_dropout, "text.random_swap": random_swap, "text.token_mask": token_mask, "text.token_swap": token_swap,
    "audio.add_noise": add_noise, "audio.time_shift": time_shift, "graph.feature_mask": feature_dropout,
}


def register(name: str, op: Callable[..., Column]) -> None:
    if name in OPS:
        raise ValueError(f"{name} is taken")
    OPS[name] = op


def augmented(df: DataFrame, col: str, steps: list[tuple[str, dict]], seed: int, epoch: int = 0, id_col: str = "id", out: str | None = None) -> DataFrame:
    """The steps one after another; column by column, so that no draw is made twice."""
    name = out or col
    df = df.withColumn(name, F.col(col))
    for k, (op, params) in enumerate(steps):
        if op not in OPS:
            raise ValueError(f"unknown operator {op!r}; there are {sorted(OPS)}")
        df = df.withColumn(name, OPS[op](F.col(name), Draw(seed, epoch, id_col, f"{k}:{op}"), **params))
    return df


def weak_and_strong(df: DataFrame, col: str, weak: list, strong: list, seed: int, second: bool = False, **kw) -> DataFrame:
    """Columns weak and strong by the same seed; a second strong one by the next seed."""
    df = augmented(augmented(df, col, weak, seed, out="weak", **kw), col, strong, seed, out="strong", **kw)
    return augmented(df, col, strong, seed + 1, out="strong2", **kw) if second else df


def edge_dropout(edges: DataFrame, seed: int, p: float = 0.2, epoch: int = 0) -> DataFrame:
    return edges.filter(uniform(seed, f"edge_dropout/{epoch}", "src", "dst") >= p)


IMAGE_OPS = ("vision.random_horizontal_flip", "vision.gaussian_noise", "vision.cutout", "vision.random_crop_pad")


def image_augmented(df: DataFrame, image: str, op: str, seed: int, epoch: int = 0, id_col: str = "id", **params) -> DataFrame:
    """Pixels of struct(h, w, c, data), each image drawn from its id; by batches in numpy."""
    import hashlib

    def one(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        h, w, _ = a.shape
        if op == "vision.random_horizontal_flip":
            return a[:, ::-1] if rng.random() < params.get("p", 0.5) else a
        if op == "vision.gaussian_noise":
            return a + rng.normal(0, params.get("sigma", 0.05), a.shape)
        if op == "vision.cutout":
            a, size = a.copy(), params.get("length", 16)
            for _ in range(params.get("n_holes", 1)):
                y, x = int(rng.integers(h)), int(rng.integers(w))
                a[max(0, y - size // 2) : y + (size + 1) // 2, max(0, x - size // 2) : x + (size + 1) // 2] = 0
            return a
        if op == "vision.random_crop_pad":
            m = params.get("padding", 4)
            big = np.pad(a, ((m, m), (m, m), (0, 0)), mode="reflect")
            y, x = int(rng.integers(2 * m + 1)), int(rng.integers(2 * m + 1))
            return big[y : y + h, x : x + w]
        raise ValueError(f"unknown operator {op!r}")

    @F.pandas_udf("array<double>")
    def go(ids: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for i, hh, ww, cc, d in zip(ids, h, w, c, data, strict=True):
            rng = np.random.default_rng(int(hashlib.md5(f"{seed}|{op}|{epoch}|{i}".encode()).hexdigest()[:8], 16))
            out.append(one(np.asarray(d, float).reshape(hh, ww, cc), rng).ravel())
        return pd.Series(out)

    i = F.col(image)
    return df.withColumn(image, F.struct(i["h"].alias("h"), i["w"].alias("w"), i["c"].alias("c"), go(id_col, i["h"], i["w"], i["c"], i["data"]).alias("data")))
