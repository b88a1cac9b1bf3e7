"""Evaluation: metrics as conditional aggregates over (group, y, p) tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import argmax

NAN = float("nan")


def hard_labels(df: DataFrame, col: str) -> DataFrame:
    """Scores or one-hot rows become the place of their first greatest element; plain labels stay."""
    return df.withColumn(col, argmax(col)) if df.schema[col].dataType.typeName() == "array" else df


def accuracy(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    hit = F.when(F.col(y).eqNullSafe(F.col(p)), 1.0).otherwise(0.0)
    return df.groupBy(*(by or [])).agg(F.coalesce(F.avg(hit), F.lit(NAN)).alias("accuracy"))


def _real(df: DataFrame, y: str) -> DataFrame:
    kind = df.schema[y].dataType.typeName()
    return df.filter(F.col(y).isNotNull() & ~F.isnan(y)) if kind in ("double", "float") else df.filter(F.col(y).isNotNull())


def balanced_accuracy(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Mean recall over the classes of y; rows without a label are left out."""
    by = by or []
    recall = _real(df, y).groupBy(*by, y).agg(F.avg(F.when(F.col(y) == F.col(p), 1.0).otherwise(0.0)).alias("r"))
    return recall.groupBy(*by).agg(F.coalesce(F.avg("r"), F.lit(NAN)).alias("balanced_accuracy"))


def macro_f1(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Unweighted mean of F1 over the classes of y; a class that is only predicted does not count."""
    by = by or []
    rows = _real(df, y)
    true = rows.groupBy(*by, F.col(y).alias("_cls")).agg(F.count(F.lit(1)).alias("_true"), F.count_if(F.col(y) == F.col(p)).alias("_tp"))
    pred = rows.groupBy(*by, F.col(p).alias("_cls")).agg(F.count(F.lit(1)).alias("_pred"))
    f1 = 2.0 * F.col("_tp") / (F.col("_true") + F.coalesce("_pred", F.lit(0)))
    return true.join(pred, [*by, "_cls"], "left").withColumn("_f1", f1).groupBy(*by).agg(F.coalesce(F.avg("_f1"), F.lit(NAN)).alias("macro_f1"))


METRICS: dict[str, Callable[..., DataFrame]] = {"accuracy": accuracy, "balanced_accuracy": balanced_accuracy, "macro_f1": macro_f1}


def evaluate(df: DataFrame, names: list[str], y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """(by..., metric, value)."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; there are {sorted(METRICS)}")
    df, out = hard_labels(hard_labels(df, y), p), None
    for n in names:
        one = METRICS[n](df, y, p, by).select(*(by or []), F.lit(n).alias("metric"), F.col(n).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_parts(scores: DataFrame, assignment: DataFrame, names: list[str], parts: list[str], id_col: str = "id", y: str = "y") -> DataFrame:
    """Metrics of predictions (id, p) on the parts that are reported; truth comes from the assignment."""
    rows = assignment.filter(F.col("part").isin(*parts)).join(scores, id_col)
    return evaluate(rows, names, y, "p", ["part"])


def prediction_counts(df: DataFrame, p: str = "p") -> DataFrame:
    return df.groupBy(F.col(p).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def seed_sweep(runs: DataFrame) -> DataFrame:
    """Of runs (run, seed, status, split, metric, value): count, mean, population deviation, extremes and values of successful ones."""
    good = runs.filter(F.col("status") == "success")
    return good.groupBy("split", "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda x: x["value"]).alias("values"),
    )


def sweep_status(runs: DataFrame) -> DataFrame:
    ok, n = F.count_if(F.col("status") == "success"), F.count(F.lit(1))
    return runs.select("seed", "status").distinct().agg(F.when(ok == n, "success").when(ok > 0, "partial_failure").otherwise("failed").alias("status"))
