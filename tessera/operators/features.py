"""Preprocessing steps: scalar, fitted and featurizing operators over columns.

A fitted step returns a model, a small table or a few numbers, fitted on the rows it is given and applied to others.
Missing tokens are fixed values: "" ? nan NaN NA N/A null None.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.seeds import drawn, normal
from tessera.functions.vectors import as_double, dot

MISSING = ["", "?", "nan", "NaN", "NA", "N/A", "null", "None"]
#: Columns of a fitted matrix step; a Gramian of more does not fit on the driver.
MAX_COLUMNS = 4096


def missing_to_null(c: str) -> Column:
    s = F.col(c).cast("string")
    return F.when(~F.trim(s).isin(MISSING), s)


def ensure_2d(df: DataFrame, cols: list[str], out: str = "x") -> DataFrame:
    """Columns, scalars or arrays of any depth, as one array of doubles."""
    parts = []
    for c in cols:
        kind, col = df.schema[c].dataType, F.col(c)
        if kind.typeName() == "string":
            raise TypeError(f"column {c} is no number")
        if kind.typeName() == "array":
            while kind.elementType.typeName() == "array":
                col, kind = F.flatten(col), kind.elementType
            parts.append(col.cast("array<double>"))
        else:
            parts.append(F.array(col.cast("double")))
    return df.withColumn(out, F.concat(*parts))


def cast_vector(df: DataFrame, x: str, dtype: str) -> DataFrame:
    """float16 is kept as float: there is no such type."""
    kind = {"float16": "float", "float32": "float", "float64": "double", "int64": "bigint", "int32": "int"}[dtype]
    return df.withColumn(x, F.col(x).cast(f"array<{kind}>"))


# labels


def label_classes(df: DataFrame, y: str = "y") -> DataFrame:
    """(label, idx): sorted labels, numbered from 0; a row a class."""
    classes = df.filter(F.col(y).isNotNull()).select(F.col(y).alias("label")).distinct()
    return classes.withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)


def encode_labels(df: DataFrame, y: str = "y", classes: DataFrame | None = None, split: str | None = None) -> DataFrame:
    """y as class numbers; given a split column, each split is numbered on its own."""
    if split:
        own = df.filter(F.col(y).isNotNull()).select(split, F.col(y).alias("label")).distinct()
        own = own.withColumn("idx", F.row_number().over(Window.partitionBy(split).orderBy("label")) - 1)
        return df.join(F.broadcast(own).withColumnRenamed(split, "_s"), (F.col(split) == F.col("_s")) & (F.col(y) == F.col("label")), "left").drop("_s", "label", y).withColumnRenamed("idx", y)
    classes = classes if classes is not None else label_classes(df, y)
    return df.join(F.broadcast(classes), F.col(y) == F.col("label"), "left").drop("label", y).withColumnRenamed("idx", y)


def onehot_labels(df: DataFrame, y: str = "y") -> DataFrame:
    """`onehot` over the sorted classes of labelled rows (y >= 0), and `is_labelled`."""
    classes = [r["y"] for r in df.filter(F.col(y) >= 0).select(F.col(y).alias("y")).distinct().orderBy("y").collect()]
    row = F.array(*[F.when(F.col(y) == c, 1).otherwise(0) for c in classes])
    return df.withColumns({"onehot": row, "is_labelled": F.coalesce(F.col(y) >= 0, F.lit(False))})


# tables


@dataclass(frozen=True)
class OneHot:
    """Numeric columns first, then a slot for each category (null is one), categories in order of their text."""

    numeric: list[str]
    categories: dict[str, list[str | None]]

    def apply(self, df: DataFrame, out: str = "x") -> DataFrame:
        numbers = [F.coalesce(missing_to_null(c).try_cast("double"), F.lit(float("nan"))) for c in self.numeric]
        flags = [F.when(missing_to_null(c).eqNullSafe(F.lit(v)), 1.0).otherwise(0.0) for c, values in self.categories.items() for v in values]
        return df.withColumn(out, F.array(*numbers, *flags))


def fit_onehot(df: DataFrame, cols: list[str]) -> OneHot:
    """A column is numeric if all its values that are not missing are numbers."""
    tests = [F.count_if(missing_to_null(c).isNotNull() & missing_to_null(c).try_cast("double").isNull()).alias(c) for c in cols]
    bad = df.agg(*tests).first()
    names = {}
    for c in cols:
        if bad[c]:
            found = [r["v"] for r in df.select(missing_to_null(c).alias("v")).distinct().limit(100_001).collect()]
            if len(found) > 100_000:
                raise ValueError(f"column {c} has too many categories")
            names[c] = sorted([v for v in found if v is not None]) + ([None] if None in found else [])
    return OneHot([c for c in cols if not bad[c]], names)


@dataclass(frozen=True)
class Scaler:
    mean: list[float]
    std: list[float]

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        parts = F.arrays_zip(as_double(x).alias("v"), F.array(*[F.lit(m) for m in self.mean]).alias("m"), F.array(*[F.lit(s or 1.0) for s in self.std]).alias("s"))
        return df.withColumn(x, F.transform(parts, lambda z: (z["v"] - z["m"]) / z["s"]))


def fit_scaler(df: DataFrame, x: str = "x") -> Scaler:
    """Means and population deviations; a constant column is only centred."""
    width = df.select(F.size(x).alias("n")).first()["n"]
    got = df.agg(*[f(F.col(x)[i].cast("double")).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return Scaler([got[f"m{i}"] for i in range(width)], [got[f"s{i}"] for i in range(width)])


@dataclass(frozen=True)
class Imputer:
    values: dict[str, float]
    indicators: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        flags = {f"{c}_missing": F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0) for c in self.values} if self.indicators else {}
        filled = {c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(v)) for c, v in self.values.items()}
        return df.withColumns({**flags, **filled})


def fit_imputer(df: DataFrame, cols: list[str], strategy: str = "mean", constant: float = 0.0, indicators: bool = False) -> Imputer:
    if strategy == "constant":
        return Imputer(dict.fromkeys(cols, float(constant)), indicators)
    v = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    how = {"mean": F.avg, "median": lambda x: F.percentile(x, 0.5), "most_frequent": lambda x: F.mode(x, True)}[strategy]
    got = df.agg(*[how(v[c]).alias(c) for c in cols]).first()
    return Imputer({c: float(got[c]) if got[c] is not None else 0.0 for c in cols}, indicators)


# text


def ensure_strings(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("None")))


def words(text: str) -> Column:
    """Lower-cased, parted at white space."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def padded(tokens: Column, length: int) -> tuple[Column, Column]:
    """The first `length` ids, padded with 0, and the mask."""
    ids = F.slice(tokens, 1, length)
    gap = F.array_repeat(F.lit(0).cast("long"), length - F.size(ids))
    mask = F.concat(F.transform(ids, lambda t: F.lit(1)), F.transform(gap, lambda t: F.lit(0)))
    return F.concat(ids, gap), mask.cast("array<tinyint>")


def hash_tokenized(df: DataFrame, text: str, length: int = 64, vocab: int = 30_000) -> DataFrame:
    """input_ids = 2 + first four bytes of the MD5 modulo (vocab - 2); 0 pads."""
    ids = F.transform(F.slice(words(text), 1, length), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % (vocab - 2) + 2)
    ids, mask = padded(ids, length)
    return df.withColumns({"input_ids": ids, "attention_mask": mask})


def fit_vocabulary(df: DataFrame, text: str, vocab: int, min_freq: int = 1) -> DataFrame:
    """(token, token_id): the vocab - 2 most frequent tokens, numbered from 2; ties by token."""
    counts = df.select(F.explode(words(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_freq)
    top = counts.orderBy(F.desc("n"), "token").limit(vocab - 2)
    return top.withColumn("token_id", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1).cast("long"))


#: A vocabulary sent to every executor has at most this many words.
MAX_VOCABULARY = 2_000_000


def vocabulary_tokenized(df: DataFrame, text: str, vocabulary: DataFrame, length: int = 64, id_col: str = "id") -> DataFrame:
    """As hash_tokenized, ids from the vocabulary, 1 for other words."""
    if vocabulary.count() > MAX_VOCABULARY:
        raise ValueError("the vocabulary is too large")
    known = F.broadcast(vocabulary.select("token", "token_id"))
    parts = df.select(id_col, F.posexplode(F.slice(words(text), 1, length)).alias("at", "token")).join(known, "token", "left")
    ids = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("token_id", F.lit(1)).alias("t")))).alias("s"))
    got = df.join(ids, id_col, "left").withColumn("_t", F.coalesce(F.transform("s", lambda p: p["t"]), F.expr("cast(array() as array<bigint>)"))).drop("s")
    ids, mask = padded(F.col("_t"), length)
    return got.withColumns({"input_ids": ids, "attention_mask": mask}).drop("_t")


def terms(df: DataFrame, text: str, ngrams: tuple[int, int] = (1, 1), id_col: str = "id") -> DataFrame:
    """(id, term, tf): runs of word characters, two at least, lower-cased, and n-grams of them."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    rows = df.select(id_col, tokens.alias("t"))
    grams = [F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), _gram(n))).otherwise(F.expr("cast(array() as array<string>)")) for n in range(ngrams[0], ngrams[1] + 1)]
    return rows.select(id_col, F.explode(F.concat(*grams)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def _gram(n: int):
    return lambda i: F.array_join(F.slice("t", i, n), " ")


def fit_idf(df: DataFrame, text: str, ngrams: tuple[int, int] = (1, 1), min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, id_col: str = "id") -> DataFrame:
    """(term, df, idf = ln((1 + n) / (1 + df)) + 1); max_features keeps the terms of greatest total frequency."""
    n = df.count()
    per = terms(df, text, ngrams, id_col).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    per = per.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if max_features:
        per = per.orderBy(F.desc("total"), "term").limit(max_features)
    return per.select("term", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf(df: DataFrame, text: str, idf: DataFrame, ngrams: tuple[int, int] = (1, 1), id_col: str = "id") -> DataFrame:
    """(id, term, weight): rows of length 1."""
    raw = terms(df, text, ngrams, id_col).join(idf.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, id_col).select(id_col, "term", (F.col("w") / F.col("norm")).alias("weight"))


# matrices


def gramian(df: DataFrame, x: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """n, column sums and X'X, summed in tasks first. Non-finite entries must be gone."""

    def part(batches):
        n, s, g = 0, None, None
        for pdf in batches:
            if len(pdf):
                a = np.stack(pdf["x"].to_numpy()).astype(float)
                n, s, g = n + len(a), (0 if s is None else s) + a.sum(0), (0 if g is None else g) + a.T @ a
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    n, s, g = 0, 0, 0
    for r in df.select(as_double(x).alias("x")).mapInPandas(part, "n long, s array<double>, g array<double>").toLocalIterator():  # one row a task
        if len(r["s"]) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} columns")
        n, s, g = n + r["n"], s + np.array(r["s"]), g + np.array(r["g"])
    return n, s, g.reshape(len(s), len(s))


@dataclass(frozen=True)
class Linear:
    """x -> (x - mean) M, by blocks."""

    mean: np.ndarray
    matrix: np.ndarray
    fill: np.ndarray | None = None

    def apply(self, df: DataFrame, x: str = "x", out: str = "x") -> DataFrame:
        mean, matrix, fill = self.mean, self.matrix, self.fill if self.fill is not None else np.zeros_like(self.mean)

        @F.pandas_udf("array<double>")
        def go(col: pd.Series) -> pd.Series:
            if not len(col):
                return pd.Series([], dtype=object)
            a = np.stack(col.to_numpy()).astype(float)
            a = np.where(np.isfinite(a), a, fill)
            return pd.Series(list((a - mean) @ matrix))

        return df.withColumn(out, go(as_double(x)))


def _finite_means(df: DataFrame, x: str) -> np.ndarray:
    width = df.select(F.size(x).alias("n")).first()["n"]
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    got = df.agg(*[F.avg(finite(F.col(x)[i].cast("double"))).alias(str(i)) for i in range(width)]).first()
    return np.array([got[str(i)] or 0.0 for i in range(width)])


def _filled(df: DataFrame, x: str, fill: np.ndarray) -> DataFrame:
    pairs = F.arrays_zip(as_double(x).alias("v"), F.array(*[F.lit(float(m)) for m in fill]).alias("m"))
    return df.select(F.transform(pairs, lambda z: F.when(F.isnan(z["v"]) | (F.abs(z["v"]) == float("inf")) | z["v"].isNull(), z["m"]).otherwise(z["v"])).alias("x"))


def fit_pca(df: DataFrame, k: int, x: str = "x") -> Linear:
    """Top k directions (at most as many as columns and rows) of the centred data; each direction's largest entry is positive."""
    fill = _finite_means(df, x)
    n, s, g = gramian(_filled(df, x, fill))
    mean = s / n
    _, v = np.linalg.eigh(g - n * np.outer(mean, mean))
    v = v[:, ::-1][:, : max(1, min(k, n, len(s)))]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return Linear(mean, v, fill)


def fit_whitening(df: DataFrame, eps: float = 1e-5, x: str = "x") -> Linear:
    """ZCA: U diag(1 / sqrt(s + eps)) U' of the covariance over n."""
    n, s, g = gramian(df, x)
    mean = s / n
    value, u = np.linalg.eigh(g / n - np.outer(mean, mean))
    return Linear(mean, u @ np.diag(1 / np.sqrt(np.maximum(value, 0) + eps)) @ u.T)


def random_projection(df: DataFrame, k: int, seed: int, x: str = "x") -> Linear:
    """N(0, 1) / sqrt k, by Box and Muller from draws by place."""
    width = df.select(F.size(x).alias("n")).first()["n"]
    u, v = (np.array([[drawn(seed, f"projection/{s}", i, j) for j in range(k)] for i in range(width)]) for s in "ra")
    return Linear(np.zeros(width), np.sqrt(-2 * np.log(u + 2.0**-33)) * np.cos(2 * np.pi * v) / math.sqrt(k))


def stub_embedding(df: DataFrame, c: str, seed: int = 0, size: int = 8, id_col: str = "id", out: str = "embedding") -> DataFrame:
    """A stand-in for an encoder: normals from the content and the id."""
    return df.withColumn(out, F.array(*[normal(seed, f"stub{i}", F.col(c).cast("string"), id_col) for i in range(size)]))


def encoded(df: DataFrame, c: str, encoder, out: str = "embedding") -> DataFrame:
    """Any encoder with load() on a worker and encode(list) -> array of rows."""
    from collections.abc import Iterator

    @F.pandas_udf("array<double>")
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder.load()
        for b in batches:
            yield pd.Series([list(map(float, row)) for row in model.encode(b.tolist())])

    return df.withColumn(out, go(c))


def auto_embedding(df: DataFrame, c: str, **stub) -> DataFrame:
    """Numbers pass; text and paths go to the stub encoder."""
    kind = df.schema[c].dataType
    if kind.typeName() == "array" and kind.elementType.typeName() != "string":
        return df.withColumn("embedding", as_double(c))
    return stub_embedding(df, c, **stub)


# images: struct<h int, w int, c int, data array<double>>, data in height, width, channel order


IMAGE = "struct<h: int, w: int, c: int, data: array<double>>"


def _image(df: DataFrame, image: str, h: Column, w: Column, c: Column, data: Column) -> DataFrame:
    return df.withColumn(image, F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"), c.cast("int").alias("c"), data.alias("data")))


def _at(image: str, y: Column, x: Column, c: Column) -> Column:
    i = F.col(image)
    return F.get(i["data"], (y * i["w"] + x) * i["c"] + c)


def channels_order(df: DataFrame, image: str, to: str) -> DataFrame:
    """Data between height-width-channel (nhwc) and channel-height-width (nchw)."""
    i = F.col(image)
    h, w, c, n = i["h"], i["w"], i["c"], F.sequence(F.lit(0), F.size(i["data"]) - 1)
    if to == "nchw":
        data = F.transform(n, lambda k: F.get(i["data"], (F.floor((k % (h * w)) / w) * w + k % w) * c + F.floor(k / (h * w))))
    else:
        data = F.transform(n, lambda k: F.get(i["data"], (k % c) * h * w + F.floor(k / c)))
    return _image(df, image, h, w, c, data)


def with_channels(df: DataFrame, image: str, k: int) -> DataFrame:
    """One channel is repeated; more are cut or padded with zeros."""
    i = F.col(image)
    n = F.sequence(F.lit(0), i["h"] * i["w"] * k - 1)
    data = F.transform(n, lambda q: F.when(i["c"] == 1, F.get(i["data"], F.floor(q / k).cast("int"))).when(q % k < i["c"], F.get(i["data"], (F.floor(q / k) * i["c"] + q % k).cast("int"))).otherwise(0.0))
    return _image(df, image, i["h"], i["w"], F.lit(k), data)


def resized(df: DataFrame, image: str, height: int, width: int) -> DataFrame:
    """Nearest: row r is row floor(r (h - 1) / (height - 1)); values become bytes."""
    i = F.col(image)
    pick = lambda k, n, m: F.floor(k * (n - 1) / max(1, m - 1)).cast("int") if m > 1 else F.lit(0)
    n = F.sequence(F.lit(0), height * width * i["c"] - 1)

    def value(q: Column) -> Column:
        y, x = F.floor(q / (width * i["c"])).cast("int"), (F.floor(q / i["c"]) % width).cast("int")
        return F.pmod(F.floor(_at(image, pick(y, i["h"], height), pick(x, i["w"], width), q % i["c"])), F.lit(256)).cast("double")

    return _image(df, image, F.lit(height), F.lit(width), i["c"], F.transform(n, value))


#: Means and deviations of the usual image set.
IMAGE_MEAN, IMAGE_STD = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]


def image_normalized(df: DataFrame, image: str, mean: list[float] = IMAGE_MEAN, std: list[float] = IMAGE_STD) -> DataFrame:
    i = F.col(image)
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    data = F.transform(i["data"], lambda v, k: (v - F.get(m, (k % i["c"]).cast("int"))) / F.get(s, (k % i["c"]).cast("int")))
    return _image(df, image, i["h"], i["w"], i["c"], data)


def squeezed(df: DataFrame, x: str) -> DataFrame:
    """An array of one array becomes that array."""
    return df.withColumn(x, F.col(x)[0])


# sound


def fixed_length(df: DataFrame, wave: str, n: int, where: str = "start") -> DataFrame:
    """Cut at start, centre or end to n samples, and padded with zeros behind."""
    x, size = F.col(wave), F.size(wave)
    begin = {"start": F.lit(1), "center": F.floor((size - n) / 2).cast("int") + 1, "end": size - n + 1}[where]
    return df.withColumn(wave, F.when(size > n, F.slice(x, begin, n)).otherwise(F.concat(x, F.array_repeat(F.lit(0.0).cast("double"), n - size))))


def wave_decoded(df: DataFrame, content: str = "content", out: str = "wave") -> DataFrame:
    """PCM WAV bytes (16 or 8 bits) to mono samples in -1 .. 1."""

    @F.pandas_udf("array<double>")
    def go(col: pd.Series) -> pd.Series:
        import io
        import wave

        rows = []
        for b in col:
            with wave.open(io.BytesIO(b)) as f:
                raw, width, channels = f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels()
            a = np.frombuffer(raw, "<i2") / 32768.0 if width == 2 else (np.frombuffer(raw, np.uint8) - 128.0) / 128.0
            rows.append(a.reshape(-1, channels).mean(1))
        return pd.Series(rows)

    return df.withColumn(out, go(content))


def log_mel(df: DataFrame, wave: str, rate: int = 16_000, n_fft: int = 400, hop: int = 160, n_mels: int = 64, top_db: float = 80.0, out: str = "mel") -> DataFrame:
    """Power spectrogram in triangular mel bands, in decibels down to top_db below the greatest."""
    mel = np.linspace(0, 2595 * math.log10(1 + rate / 2 / 700), n_mels + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up, down = (bins[None] - hz[:-2, None]) / np.diff(hz)[:-1, None], (hz[2:, None] - bins[None]) / np.diff(hz)[1:, None]
    bank, window = np.maximum(0, np.minimum(up, down)), np.hanning(n_fft + 1)[:-1]

    @F.pandas_udf("array<array<double>>")
    def go(col: pd.Series) -> pd.Series:
        rows = []
        for w in col:
            x = np.pad(np.asarray(w, float), (0, max(0, n_fft - len(w))))
            frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * window
            power = bank @ (np.abs(np.fft.rfft(frames, axis=1)) ** 2).T
            db = 10 * np.log10(np.maximum(power, 1e-10))
            rows.append(np.maximum(db, db.max() - top_db).tolist())
        return pd.Series(rows)

    return df.withColumn(out, go(wave))


def adjacency_payload(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Features, edges and weights of a graph as one payload of two tables."""
    return {"nodes": nodes, "edges": edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))}


def projected(df: DataFrame, vector: list[float], x: str = "x") -> Column:
    return dot(x, F.array(*[F.lit(float(v)) for v in vector]))
