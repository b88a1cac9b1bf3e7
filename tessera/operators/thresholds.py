"""Relational kernels of the deep methods over score tables (id, x: probabilities).

What a kernel keeps between steps (moving averages) is a small dict that the caller passes back in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import argmax, dot, norm, normalised, sharpened, softmax, total


def _map(values: dict[int, float]) -> Column:
    return F.create_map(*[F.lit(v) for k, x in sorted(values.items()) for v in (int(k), float(x))])


def pseudo(scores: DataFrame) -> DataFrame:
    return scores.withColumns({"p": argmax("x"), "conf": F.array_max("x")})


def fixmatch_mask(scores: DataFrame, threshold: float = 0.95, temperature: float = 0.5) -> DataFrame:
    """(id, p, mask): the label is the argmax of sharpened scores, the mask is taken before."""
    return scores.select("id", argmax(sharpened("x", temperature)).alias("p"), (F.array_max("x") >= threshold).cast("double").alias("mask"))


def masked_mean(df: DataFrame, loss: str = "loss", mask: str = "mask") -> DataFrame:
    return df.agg((F.sum(F.col(loss) * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1.0))).alias("loss"))


def cross_entropy(scores: DataFrame, y: str = "p") -> Column:
    return -F.log(F.greatest(F.get(F.col("x"), F.col(y)), F.lit(1e-12)))


def class_progress(state: DataFrame, n_classes: int, warm_up: bool = True) -> dict[int, float]:
    """Of (id, last: the last selected label or -1): each class's count over the greatest, never selected rows being one of the counts under warm-up."""
    counts = {r["last"]: r["n"] for r in state.groupBy("last").agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max([n for c, n in counts.items() if c >= 0 or warm_up], default=0)
    return {c: counts.get(c, 0) / top if top else 0.0 for c in range(n_classes)}


def flexmatch_threshold(progress: dict[int, float], threshold: float = 0.95) -> dict[int, float]:
    return {c: threshold * a / (2 - a) for c, a in progress.items()}


def class_mask(scores: DataFrame, limits: dict[int, float]) -> DataFrame:
    got = pseudo(scores)
    return got.select("id", "p", "conf", (F.col("conf") >= F.element_at(_map(limits), F.col("p"))).alias("mask"))


def mean_scores(scores: DataFrame, n_classes: int) -> list[float]:
    r = scores.agg(*[F.avg(F.col("x")[c]).alias(str(c)) for c in range(n_classes)]).first()
    return [r[str(c)] or 0.0 for c in range(n_classes)]


def _ema(old, new, m: float):
    if isinstance(new, list):
        return [m * a + (1 - m) * b for a, b in zip(old, new, strict=True)]
    return m * old + (1 - m) * new


def freematch_thresholds(scores: DataFrame, n_classes: int, state: dict | None = None, m: float = 0.999, quantile: float = 0.8) -> dict:
    """tau moves to the quantile of confidences, the class means to the mean scores; limits are tau times the class mean over the greatest."""
    state = state or {"tau": 1 / n_classes, "mean": [1 / n_classes] * n_classes}
    q = scores.select(F.percentile(F.array_max("x"), quantile).alias("q")).first()["q"]
    tau, mean = _ema(state["tau"], q, m), _ema(state["mean"], mean_scores(scores, n_classes), m)
    return {"tau": tau, "mean": mean, "limits": {c: tau * mean[c] / max(mean) for c in range(n_classes)}}


def softmatch_state(scores: DataFrame, n_classes: int, state: dict | None = None, m: float = 0.999) -> dict:
    """Moving mean and sample variance of confidences."""
    state = state or {"mu": 1 / n_classes, "var": 1.0}
    r = scores.select(F.array_max("x").alias("c")).agg(F.avg("c").alias("m"), F.var_samp("c").alias("v")).first()
    return {"mu": _ema(state["mu"], r["m"], m), "var": _ema(state["var"], r["v"] or 0.0, m)}


def softmatch_weight(scores: DataFrame, state: dict, n_sigma: float = 2.0) -> DataFrame:
    off = F.least(F.array_max("x") - state["mu"], F.lit(0.0))
    return scores.select("id", F.exp(-off * off / (2 * state["var"] / n_sigma**2)).alias("w"))


def aligned(scores: DataFrame, target: list[float], mean: list[float], floor: float = 1e-6) -> DataFrame:
    """Scores times target over their mean, normalised."""
    ratio = F.array(*[F.lit(t / max(m, floor)) for t, m in zip(target, mean, strict=True)])
    return scores.withColumn("x", normalised(F.zip_with("x", ratio, lambda a, b: a * b)))


def relative_threshold(labelled_scores: DataFrame, share: float = 0.95) -> float:
    return share * (labelled_scores.agg(F.avg(F.array_max("x")).alias("m")).first()["m"] or 0.0)


def adsh_thresholds(scores: DataFrame, majority: int, n_classes: int, cut_off: float = 0.95) -> dict[int, float]:
    """The majority class keeps the cut-off; another class takes as large a share of its rows, its limit being the last of them."""
    got = pseudo(scores).select("id", "p", "conf")
    r = got.filter(F.col("p") == majority).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("conf") >= cut_off).alias("k")).first()
    rho = r["k"] / r["n"] if r["n"] else 1.0
    per = got.withColumns({"r": F.row_number().over(Window.partitionBy("p").orderBy(F.desc("conf"), "id")), "n": F.count(F.lit(1)).over(Window.partitionBy("p"))})
    at = F.greatest(F.bround(F.col("n") * rho - 1), F.lit(0)) + 1
    found = {x["p"]: x["conf"] for x in per.filter(F.col("r") == at).select("p", "conf").collect()}
    return {c: cut_off if c == majority else min(found.get(c, cut_off), cut_off) for c in range(n_classes)}


def adsh_selected(scores: DataFrame, limits: dict[int, float]) -> DataFrame:
    """(id, p, mask): the class whose score is greatest over its limit, taken from 1 on."""
    ratio = F.zip_with("x", F.array(*[F.lit(limits[c]) for c in sorted(limits)]), lambda a, b: a / b)
    return scores.select("id", argmax(ratio).alias("p"), (F.array_max(ratio) >= 1).alias("mask"))


def tsa_threshold(step: int, steps: int, n_classes: int, schedule: str = "linear") -> float:
    """From 1 / n_classes to 1 in the course of training."""
    t = min(max(step / steps, 0.0), 1.0)
    a = {"linear": t, "exp": math.exp((t - 1) * 5), "log": 1 - math.exp(-t * 5), "none": 1.0}[schedule]
    return a * (1 - 1 / n_classes) + 1 / n_classes if schedule != "none" else 1.0


def tsa_kept(labelled_scores: DataFrame, limit: float) -> DataFrame:
    """(id, kept): labelled rows whose score of their own class is still below the limit."""
    return labelled_scores.select("id", (F.get(F.col("x"), F.col("y")) < limit).alias("kept"))


def uda_mask(scores: DataFrame, threshold: float = 0.8, temperature: float = 0.4) -> DataFrame:
    return scores.select("id", (F.array_max(sharpened("x", temperature)) >= threshold).alias("mask"))


def mixup_weight(u: Column) -> Column:
    return F.greatest(u, 1 - u)


#: Rows of a queue unless another number is asked for, and at most.
QUEUE, MOST_QUEUED = 2560, 65_536


def smoothed_by_memory(scores: DataFrame, feats: str, queue: DataFrame, alpha: float = 0.9, temperature: float = 0.2, n_classes: int = 10) -> DataFrame:
    """alpha p + (1 - alpha) sum of queue scores weighted by exp(cos / T). The queue (feat, q) has a fixed size, which is checked."""
    if queue.limit(MOST_QUEUED + 1).count() > MOST_QUEUED:
        raise ValueError(f"a queue of more than {MOST_QUEUED} rows")
    rows = F.broadcast(queue.select("feat", "q"))
    cos = dot(feats, "feat") / (norm(feats) * norm("feat"))
    met = scores.crossJoin(rows).withColumn("a", F.exp(cos / temperature))  # the queue's fixed size bounds this
    s = met.groupBy("id").agg(F.sum("a").alias("t"), *[F.sum(F.col("a") * F.col("q")[c]).alias(f"_{c}") for c in range(n_classes)])
    mem = F.array(*[F.col(f"_{c}") / F.col("t") for c in range(n_classes)])
    return scores.join(s, "id").select("id", F.zip_with("x", mem, lambda a, b: alpha * a + (1 - alpha) * b).alias("x"))


def pseudo_graph(batch: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(src, dst, w): p p' within a batch (column batch), diagonal 1, entries from the threshold on, rows normalised."""
    a, b = batch.alias("a"), batch.alias("b")
    w = F.when(F.col("a.id") == F.col("b.id"), 1.0).otherwise(dot("a.x", "b.x"))
    met = a.join(b, F.col("a.batch") == F.col("b.batch")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), w.alias("w")).filter(F.col("w") >= threshold)
    return met.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))


def prototypes(feats: DataFrame, most: int = 256) -> DataFrame:
    """(cls, proto): the mean of the last `most` rows of each class by id."""
    last = feats.withColumn("_r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("id")))).filter(F.col("_r") <= most)
    d = feats.select(F.size("x").alias("n")).first()["n"]
    return last.groupBy("cls").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("proto"))


def semantic_scores(feats: DataFrame, protos: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(id, q): softmax of cosines to the prototypes, by class."""
    c = F.broadcast(protos.agg(F.array_sort(F.collect_list(F.struct("cls", "proto"))).alias("ps")))  # a row a class
    cos = F.transform("ps", lambda p: dot("x", p["proto"]) / (norm("x") * norm(p["proto"])) / temperature)
    return feats.crossJoin(c).select("id", softmax(cos).alias("q"))


def blended(scores: DataFrame, semantic: DataFrame, mean: list[float], power: float = 1.5) -> DataFrame:
    """(1 - v) p + v q, v by the row's class: mean ** (1 / power) over the greatest."""
    v = [m ** (1 / power) for m in mean]
    weight = F.element_at(_map({c: x / max(v) for c, x in enumerate(v)}), argmax("x"))
    return scores.join(semantic, "id").withColumn("v", weight).select("id", F.zip_with("x", "q", lambda a, b: (1 - F.col("v")) * a + F.col("v") * b).alias("x"))


def heads_agree(a: DataFrame, b: DataFrame, limit: float) -> DataFrame:
    """(id, p): two heads agree, and their mean confidence reaches the limit."""
    met = pseudo(a).select("id", "p", F.col("conf").alias("c1")).join(pseudo(b).select("id", F.col("p").alias("q"), F.col("conf").alias("c2")), "id")
    return met.filter((F.col("p") == F.col("q")) & ((F.col("c1") + F.col("c2")) / 2 >= limit)).select("id", "p")


def stable(passes: DataFrame, base: DataFrame, fraction: float) -> DataFrame:
    """Ids whose labels differ from base in at most floor(passes * fraction) of the passes (id, pass, p)."""
    met = passes.join(base.select("id", F.col("p").alias("b")), "id").groupBy("id").agg(F.count_if(F.col("p") != F.col("b")).alias("off"), F.count(F.lit(1)).alias("n"))
    return met.filter(F.col("off") <= F.floor(F.col("n") * fraction)).select("id")


def smeared(y: Column, n_classes: int, draw, sigma: float = 0.05) -> Column:
    """One-hot with positive normal noise, normalised; draw(slot) is a N(0, 1) Column."""
    return normalised(F.array(*[F.when(y == c, 1.0).otherwise(0.0) + F.greatest(sigma * draw(c), F.lit(0.0)) for c in range(n_classes)]))


def teacher_signal(before: DataFrame, after: DataFrame, state: float = 0.0, m: float = 0.99) -> dict:
    """The fall of the student's labelled cross-entropy, less its moving average. Tables (id, x, y)."""
    ce = lambda df: df.agg(F.avg(cross_entropy(df, "y")).alias("l")).first()["l"]
    d = ce(before) - ce(after)
    return {"signal": d - state, "average": m * state + (1 - m) * d}


def ensembled(state: DataFrame, scores: DataFrame, t: int, alpha: float = 0.6) -> DataFrame:
    """(id, z, x): z = alpha z + (1 - alpha) p, the target being z / (1 - alpha ** (t + 1))."""
    met = scores.join(state.select("id", "z"), "id", "left")
    z = F.zip_with("x", F.coalesce("z", F.transform("x", lambda v: F.lit(0.0))), lambda p, o: alpha * o + (1 - alpha) * p)
    return met.select("id", z.alias("z")).withColumn("x", F.transform("z", lambda v: v / (1 - alpha ** (t + 1))))


def consistency(a: DataFrame, b: DataFrame, step: int, warm: int) -> DataFrame:
    """Mean squared difference of scores, ramped up linearly."""
    met = a.join(b.select("id", F.col("x").alias("o")), "id")
    d = total(F.zip_with("x", "o", lambda p, q: (p - q) * (p - q))) / F.size("x")
    return met.agg((F.avg(d) * min(step / warm if warm else 1.0, 1.0)).alias("loss"))


def entropy(x) -> Column:
    return -total(F.transform(F.col(x) if isinstance(x, str) else x, lambda v: F.when(v > 0, v * F.log(v)).otherwise(0.0)))


def js_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, js): entropy of the mean less the mean entropy."""
    met = a.join(b.select("id", F.col("x").alias("o")), "id")
    mean = F.zip_with("x", "o", lambda p, q: (p + q) / 2)
    return met.select("id", (entropy(mean) - (entropy("x") + entropy("o")) / 2).alias("js"))


def kl_to_mean(views: DataFrame) -> DataFrame:
    """Of views (id, view, x): (id, kl), the mean divergence of the views from their mean."""
    d = views.select(F.size("x").alias("n")).first()["n"]
    mean = views.groupBy("id").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("m"))
    kl = total(F.zip_with("x", "m", lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)))
    return views.join(mean, "id").groupBy("id").agg(F.avg(kl).alias("kl"))


def support_scores(feats: DataFrame, support: DataFrame, n_classes: int, temperature: float = 0.1, max_support: int = 100_000) -> DataFrame:
    """(id, x): softmax over cosines to a labelled support set (id, x, y), summed by class."""
    if support.limit(max_support + 1).count() > max_support:
        raise ValueError("the support set is too large")
    s = F.broadcast(support.select(F.col("x").alias("s"), F.col("y").alias("sy")))
    met = feats.crossJoin(s).withColumn("e", F.exp(dot("x", "s") / (norm("x") * norm("s")) / temperature))  # bounded by the support's size
    t = met.groupBy("id").agg(*[F.sum(F.when(F.col("sy") == c, F.col("e")).otherwise(0.0)).alias(f"_{c}") for c in range(n_classes)])
    return t.select("id", normalised(F.array(*[f"_{c}" for c in range(n_classes)])).alias("x"))


def edge_softmax(edges: DataFrame, logit: str = "l") -> DataFrame:
    """(src, dst, a): softmax over the edges of each destination. Maxima and sums are aggregates, so hubs are no single task's."""
    top = edges.groupBy("dst").agg(F.max(logit).alias("_m"))
    e = edges.join(top, "dst").withColumn("_e", F.exp(F.col(logit) - F.col("_m")))
    s = e.groupBy("dst").agg(F.sum("_e").alias("_s"))
    return e.join(s, "dst").select("src", "dst", (F.col("_e") / F.col("_s")).alias("a"))


def hop_rings(edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """(src, dst, hop): nodes at exactly so many steps."""
    seen = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("hop"))
    step = edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    ring, out = seen, None
    for h in range(1, hops + 1):
        ring = ring.join(step, F.col("dst") == F.col("a")).select("src", F.col("b").alias("dst"), F.lit(h).alias("hop")).distinct().join(seen.select("src", "dst"), ["src", "dst"], "left_anti")
        seen = seen.unionByName(ring)
        out = ring if out is None else out.unionByName(ring)
    return out


def ring_means(rings: DataFrame, x: DataFrame, size: int) -> DataFrame:
    """(id, hop, x): the mean over each ring."""
    met = rings.join(x.select(F.col("id").alias("dst"), "x"), "dst")
    return met.groupBy(F.col("src").alias("id"), "hop").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(size)]).alias("x"))


def structural_groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, grp): nodes with equal sets of neighbours share the least id of theirs."""
    sets = edges.filter("src <> dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.xxhash64("dst").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("dst", F.lit(1))).alias("b"), F.count(F.lit(1)).alias("n"))
    least = sets.groupBy("a", "b", "n").agg(F.min("id").alias("grp"))
    return nodes.select("id").join(sets.join(least, ["a", "b", "n"]).select("id", "grp"), "id", "left").select("id", F.coalesce("grp", "id").alias("grp"))


def early_stop(losses: list[float], patience: int) -> int:
    """The step after which training ends: no fall by more than 1e-9 for `patience` steps."""
    best, since = math.inf, 0
    for i, v in enumerate(losses):
        best, since = (v, 0) if v < best - 1e-9 else (best, since + 1)
        if since >= patience:
            return i
    return len(losses) - 1
