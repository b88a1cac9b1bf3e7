"""Splits, scarce labels and class imbalance. Same counts and invariants as drawn permutations, by tickets.

Class tables are small (a row per class) and may be held on the driver; rows never are. Rows with a null class form a
class of their own. Empty inputs give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranks import ranked
from tessera.functions.seeds import part_seed, ticket

#: Classes are a dimension; more are refused.
MAX_CLASSES = 100_000


class SamplingError(ValueError):
    """A plan that the data or the rules do not allow."""


def class_counts(df: DataFrame, y: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def _counts(df: DataFrame, y: str) -> list[tuple]:
    """(class, count) by class, null last."""
    found = [(r["y"], r["n"]) for r in class_counts(df, y).limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise SamplingError(f"more than {MAX_CLASSES} classes")
    return sorted(found, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0))


def largest_remainder(counts: list[int], target: int) -> list[int]:
    """floor(c * target / N), and one more for the largest remainders (ties: the earlier)."""
    total = sum(counts)
    if not total:
        return [0] * len(counts)
    exact = [c * target for c in counts]
    out = [e // total for e in exact]
    for i in sorted(range(len(counts)), key=lambda i: (-(exact[i] % total), i))[: target - sum(out)]:
        out[i] += 1
    return out


def _with_quota(df: DataFrame, y: str, classes: list, quota: list[int], seed: int, salt: str, id_col: str) -> DataFrame:
    """df with `_picked`: whether the row is among the first `quota` of its class by ticket."""
    schema = f"_qy {df.schema[y].dataType.simpleString()}, _quota long"
    table = F.broadcast(df.sparkSession.createDataFrame(list(zip(classes, quota, strict=True)), schema))
    rows = ranked(df, ticket(seed, salt, id_col), [y], [id_col]).join(table, F.col(y).eqNullSafe(F.col("_qy")), "left")
    return rows.withColumn("_picked", F.coalesce(F.col("_rank") < F.col("_quota"), F.lit(False))).select(*df.columns, "_picked")


def random_holdout(df: DataFrame, n_holdout: int, seed: int, id_col: str = "id", salt: str = "holdout") -> DataFrame:
    """df with `_picked` for n_holdout rows (none below 1, all from n on)."""
    return ranked(df, ticket(seed, salt, id_col), tie=[id_col]).withColumn("_picked", F.col("_rank") < n_holdout).select(*df.columns, "_picked")


def stratified_holdout(df: DataFrame, n_holdout: int, y: str, seed: int, id_col: str = "id", salt: str = "holdout") -> DataFrame:
    counts = _counts(df, y)
    n = sum(c for _, c in counts)
    quota = largest_remainder([c for _, c in counts], max(0, min(n_holdout, n)))
    return _with_quota(df, y, [k for k, _ in counts], quota, seed, salt, id_col)


def holdout_split(df: DataFrame, y: str | None, seed: int, test_fraction: float = 0.2, val_fraction: float = 0.1, id_col: str = "id") -> DataFrame:
    """df with `part`: test first, then val as a fraction of the rest; halves round to even."""
    if not (0 <= test_fraction < 1 and 0 <= val_fraction < 1):
        raise SamplingError("fractions are in [0, 1)")

    def cut(rows: DataFrame, n: int, salt: str) -> DataFrame:
        return stratified_holdout(rows, n, y, seed, id_col, salt) if y else random_holdout(rows, n, seed, id_col, salt)

    n = df.count()
    n_test = round(test_fraction * n)
    first = cut(df, n_test, "test").withColumnRenamed("_picked", "_test")
    n_val = round(val_fraction * (n - n_test))
    rest = cut(first.filter("not _test"), n_val, "val")
    test = first.filter("_test").withColumn("_picked", F.lit(False))
    part = F.when(F.col("_test"), "test").when(F.col("_picked"), "val").otherwise("train")
    return rest.unionByName(test).select(*df.columns, part.alias("part"))


def kfold(df: DataFrame, k: int, seed: int, y: str | None = None, id_col: str = "id", salt: str = "kfold") -> DataFrame:
    """df with `fold`: k parts in ticket order, the first of them one row larger; of each class if y is given."""
    if k < 2:
        raise SamplingError("k is at least 2")
    base, more = F.floor(F.col("_size") / k), F.col("_size") % k
    large = more * (base + 1)
    fold = F.when(F.col("_rank") < large, F.floor(F.col("_rank") / (base + 1))).otherwise(more + F.floor((F.col("_rank") - large) / F.greatest(base, F.lit(1))))
    return ranked(df, ticket(seed, salt, id_col), [y] if y else [], [id_col]).select(*df.columns, fold.cast("int").alias("fold"))


def kfold_split(df: DataFrame, k: int, fold: int, seed: int, y: str | None = None, val_fraction: float = 0.0, id_col: str = "id") -> DataFrame:
    """The fold is the test part; val is cut from the rest."""
    if not 0 <= fold < k:
        raise SamplingError("fold is in 0 .. k - 1")
    rows = kfold(df, k, seed, y, id_col)
    test = rows.filter(F.col("fold") == fold).drop("fold").withColumn("part", F.lit("test"))
    rest = holdout_split(rows.filter(F.col("fold") != fold).drop("fold"), y, seed, 0.0, val_fraction, id_col)
    return rest.unionByName(test)


@dataclass(frozen=True)
class Labelling:
    """How many labels, and how they are shared among classes."""

    mode: str = "fraction"
    value: float = 0.1
    strategy: str = "proportional"
    min_per_class: int = 1


def label_quota(counts: list[int], spec: Labelling) -> list[int]:
    """Labels of each class. First shares, then floors and caps, then repair towards the target, one class after another."""
    n, classes = sum(counts), len(counts)
    if spec.mode == "fraction":
        if not 0 < spec.value <= 1:
            raise SamplingError("a label fraction is in (0, 1]")
        target = round(spec.value * n)
    elif spec.mode in ("count", "per_class"):
        target = int(spec.value) * (classes if spec.mode == "per_class" else 1)
    else:
        raise SamplingError(f"unknown labelling mode {spec.mode!r}")
    target = max(0, min(n, target))
    by_size = sorted(range(classes), key=lambda i: (-counts[i], i))
    if spec.mode == "per_class":
        quota = [int(spec.value)] * classes
    elif spec.strategy == "balanced" and target and classes:
        quota = [target // classes] * classes
        for i in by_size[: target % classes]:
            quota[i] += 1
    else:
        quota = largest_remainder(counts, target)
    low = [spec.min_per_class if c >= spec.min_per_class else 0 for c in counts]
    quota = [min(max(q, f), c) for q, f, c in zip(quota, low, counts, strict=True)]
    gap = target - sum(quota)
    room = [c - q for c, q in zip(counts, quota, strict=True)] if gap > 0 else [q - f for q, f in zip(quota, low, strict=True)]
    key = room if gap > 0 else quota
    for i in sorted(range(classes), key=lambda i: (-key[i], i)):  # greedy, so a prefix of the order is used up
        step = min(abs(gap), max(0, room[i]))
        quota[i] += step if gap > 0 else -step
        gap += -step if gap > 0 else step
    return quota


def select_labelled(df: DataFrame, y: str, spec: Labelling, seed: int, id_col: str = "id") -> DataFrame:
    """df (the training rows) with `is_labelled`."""
    counts = _counts(df, y)
    quota = label_quota([c for _, c in counts], spec)
    return _with_quota(df, y, [k for k, _ in counts], quota, seed, "label", id_col).withColumnRenamed("_picked", "is_labelled")


def fixed_labelled(df: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """`is_labelled` for given ids, which are distinct and all there."""
    if len(set(ids)) != len(ids):
        raise SamplingError("duplicate ids")
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"_fixed {df.schema[id_col].dataType.simpleString()}")
    if wanted.join(df, F.col("_fixed") == F.col(id_col), "left_anti").limit(1).count():
        raise SamplingError("ids outside the training rows")
    return df.join(F.broadcast(wanted), F.col(id_col) == F.col("_fixed"), "left").withColumn("is_labelled", F.col("_fixed").isNotNull()).drop("_fixed")


def cap_per_class(df: DataFrame, y: str, cap: int, seed: int, id_col: str = "id") -> DataFrame:
    """At most `cap` rows of each class."""
    return ranked(df, ticket(seed, "cap", id_col), [y], [id_col]).filter(F.col("_rank") < cap).select(*df.columns)


def long_tail_quota(counts: list[int], alpha: float, min_per_class: int) -> list[int]:
    if not 0 < alpha < 1:
        raise SamplingError("alpha is in (0, 1)")
    out, top = [0] * len(counts), max(counts, default=0)
    for rank, i in enumerate(sorted(range(len(counts)), key=lambda i: (-counts[i], i))):
        out[i] = min(max(round(top * alpha**rank), min_per_class), counts[i])
    return out


def long_tail(df: DataFrame, y: str, alpha: float, seed: int, min_per_class: int = 1, id_col: str = "id") -> DataFrame:
    counts = _counts(df, y)
    quota = long_tail_quota([c for _, c in counts], alpha, min_per_class)
    return _with_quota(df, y, [k for k, _ in counts], quota, seed, "tail", id_col).filter("_picked").drop("_picked")


def unlabelled(train: DataFrame, labelled: DataFrame, id_col: str = "id") -> DataFrame:
    return train.join(labelled.select(id_col), id_col, "left_anti")


@dataclass(frozen=True)
class SamplingPlan:
    split: str = "holdout"
    test_fraction: float = 0.2
    val_fraction: float = 0.1
    k: int = 5
    fold: int = 0
    stratify: bool = True
    labelling: Labelling = Labelling()
    imbalance: str = "none"
    imbalance_on: str = "train"
    cap: int = 0
    alpha: float = 0.5
    respect_official: bool = True


def _imbalanced(df: DataFrame, plan: SamplingPlan, y: str, seed: int, id_col: str, where: str) -> DataFrame:
    if plan.imbalance == "none" or plan.imbalance_on != where:
        return df
    if plan.imbalance == "cap":
        return cap_per_class(df, y, plan.cap, seed, id_col)
    if plan.imbalance == "long_tail":
        return long_tail(df, y, plan.alpha, seed, id_col=id_col)
    raise SamplingError(f"unknown imbalance {plan.imbalance!r}")


def sample(df: DataFrame, plan: SamplingPlan, y: str, seed: int, id_col: str = "id", official: str | None = None) -> DataFrame:
    """(id, y, part, is_labelled) of each row that is kept.

    official names a column that is `train` or `test`: if it is respected, only val is cut from its training rows, and
    a k-fold's fold becomes val; else its test rows are left out, and the plan splits the training rows.
    """
    cols = [id_col, y]
    if official:
        train = df.filter(F.col(official) == "train").select(*cols)
        test = df.filter(F.col(official) == "test").select(*cols, F.lit("test").alias("part"))
    else:
        train, test = df.select(*cols), None
    by = y if plan.stratify else None
    keep = official is not None and plan.respect_official
    split_seed = part_seed(seed, "split")
    if plan.split == "holdout":
        parts = holdout_split(train, by, split_seed, 0.0 if keep else plan.test_fraction, plan.val_fraction, id_col)
    elif plan.split == "kfold":
        parts = kfold_split(train, plan.k, plan.fold, split_seed, by, 0.0 if keep else plan.val_fraction, id_col)
        if keep:
            parts = parts.withColumn("part", F.when(F.col("part") == "test", "val").otherwise(F.col("part")))
    else:
        raise SamplingError(f"unknown split {plan.split!r}")
    if keep:
        parts = parts.unionByName(test)
    rows = _imbalanced(parts.filter("part = 'train'").select(*cols), plan, y, part_seed(seed, "imbalance"), id_col, "train")
    marked = select_labelled(rows, y, plan.labelling, part_seed(seed, "label"), id_col)
    kept = _imbalanced(marked.filter("is_labelled").select(*cols), plan, y, part_seed(seed, "imbalance"), id_col, "labelled").select(id_col).withColumn("_lab", F.lit(True))
    train_rows = marked.drop("is_labelled").join(kept, id_col, "left").select(*cols, F.lit("train").alias("part"), F.coalesce("_lab", F.lit(False)).alias("is_labelled"))
    return train_rows.unionByName(parts.filter("part <> 'train'").select(*cols, "part", F.lit(False).alias("is_labelled")))


def graph_sample(nodes: DataFrame, plan: SamplingPlan, y: str, seed: int, id_col: str = "id", masks: dict[str, str] | None = None) -> DataFrame:
    """As sample, over nodes: official masks count only if train, val and test are all there; imbalance is ignored on train."""
    if masks and {"train", "val", "test"} <= set(masks) and plan.respect_official:
        part = F.when(F.col(masks["test"]), "test").when(F.col(masks["val"]), "val").when(F.col(masks["train"]), "train")
        parts = nodes.select(id_col, y, part.alias("part")).filter("part is not null")
        marked = select_labelled(parts.filter("part = 'train'").select(id_col, y), y, plan.labelling, part_seed(seed, "label"), id_col)
        rest = parts.filter("part <> 'train'").withColumn("is_labelled", F.lit(False))
        return marked.withColumn("part", F.lit("train")).select(id_col, y, "part", "is_labelled").unionByName(rest)
    from dataclasses import replace

    return sample(nodes, replace(plan, imbalance="none") if plan.imbalance_on == "train" else plan, y, seed, id_col)


def masks_of(assignment: DataFrame, id_col: str = "id") -> DataFrame:
    """Boolean columns from parts."""
    part = F.col("part")
    return assignment.select(id_col, *[(part == p).alias(f"{p}_mask") for p in ("train", "val", "test")], ((part == "train") & F.col("is_labelled")).alias("labelled_mask"), ((part == "train") & ~F.col("is_labelled")).alias("unlabelled_mask"))


def parts_of(masks: DataFrame, id_col: str = "id") -> DataFrame:
    part = F.when(F.col("train_mask"), "train").when(F.col("val_mask"), "val").when(F.col("test_mask"), "test")
    return masks.select(id_col, part.alias("part"), F.coalesce("labelled_mask", F.lit(False)).alias("is_labelled")).filter("part is not null")


def violations(assignment: DataFrame, universe: DataFrame, id_col: str = "id") -> DataFrame:
    """One row of counts that are all zero for a sound assignment."""
    per_id = assignment.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"))
    twice = per_id.agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("parts") > 1).alias("overlaps"))
    outside = assignment.join(universe.select(id_col), id_col, "left_anti").agg(F.count(F.lit(1)).alias("out_of_range"))
    labels = assignment.agg(F.count_if(F.col("is_labelled") & (F.col("part") != "train")).alias("labelled_outside_train"), F.count_if(~F.col("part").isin("train", "val", "test")).alias("unknown_part"))
    return twice.crossJoin(outside).crossJoin(labels)  # each is one row


def stats(assignment: DataFrame, y: str) -> DataFrame:
    """Rows by part and class, and by part over all classes."""
    return assignment.rollup("part", y).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_labelled").alias("n_labelled")).filter("part is not null")


def fit_scope(df: DataFrame, assignment: DataFrame, scope: str, id_col: str = "id") -> DataFrame:
    """The rows that a step may fit on."""
    where = {"train": "part = 'train'", "train_labeled": "part = 'train' and is_labelled", "train_unlabeled": "part = 'train' and not is_labelled", "val": "part = 'val'"}
    if scope not in where:
        raise SamplingError(f"unknown fit scope {scope!r}")
    return df.join(assignment.filter(where[scope]).select(id_col), id_col, "left_semi")
