"""Edge algebra over edges(src, dst, w) and nodes(id).

Two conventions of degree exist on purpose: construction normalizes by source, diffusion by destination.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.seeds import fingerprint, ticket, uniform
from tessera.operators import similarity


def weighted(pairs: DataFrame, kind: str = "heat", sigma: float = 0.5, metric: str = "cosine") -> DataFrame:
    """Weights from distances d: 1, exp(-d^2 / 2 sigma^2), or 1 - d (cosine only)."""
    if kind == "binary":
        w = F.lit(1.0)
    elif kind == "heat":
        w = F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma))
    elif kind == "cosine" and metric == "cosine":
        w = 1.0 - F.col("d")
    else:
        raise ValueError(f"no weights {kind!r} for metric {metric!r}")
    return pairs.select("src", "dst", w.alias("w"))


def symmetrized(edges: DataFrame, how: str = "mutual") -> DataFrame:
    """Both directions of each pair with the mean weight if both are there; one alone is kept (or) or not (mutual). Loops stay once."""
    if how == "none":
        return edges.groupBy("src", "dst").agg(F.max("w").alias("w"))
    a, b, forth = F.least("src", "dst"), F.greatest("src", "dst"), F.col("src") <= F.col("dst")
    pair = edges.groupBy(a.alias("a"), b.alias("b")).agg(F.max(F.when(forth, F.col("w"))).alias("f"), F.max(F.when(~forth, F.col("w"))).alias("g"))
    loop, both = F.col("a") == F.col("b"), F.col("f").isNotNull() & F.col("g").isNotNull()
    if how == "mutual":
        pair = pair.filter(loop | both)
    elif how != "or":
        raise ValueError(f"unknown symmetrization {how!r}")
    w = F.when(both, (F.col("f") + F.col("g")) / 2).otherwise(F.coalesce("f", "g"))
    ends = F.when(loop, F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")))).otherwise(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t"))))
    return pair.select(F.explode(ends).alias("e"), w.alias("w")).select(F.col("e.s").alias("src"), F.col("e.t").alias("dst"), "w")


def with_loops(edges: DataFrame, nodes: DataFrame, w: float = 1.0) -> DataFrame:
    """A loop for each node that has none."""
    has = edges.filter("src = dst").select(F.col("src").alias("id"))
    new = nodes.select("id").join(has, "id", "left_anti")
    return edges.unionByName(new.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(w).alias("w")))


def degrees(edges: DataFrame, by: str = "src") -> DataFrame:
    return edges.groupBy(F.col(by).alias("id")).agg(F.sum("w").alias("degree"))


def normalized(edges: DataFrame, how: str = "rw", by: str = "src") -> DataFrame:
    """w / deg (rw) or w / sqrt(deg deg) (sym), degrees summed by source or destination; without a degree a weight is 0."""
    if how == "none":
        return edges
    deg = degrees(edges, by)
    inv = lambda c: F.when(F.col(c) > 0, 1 / F.col(c)).otherwise(0.0)
    if how == "rw":
        own = deg.select(F.col("id").alias(by), "degree")
        return edges.join(own, by).select("src", "dst", (F.col("w") * inv("degree")).alias("w"))
    if how == "sym":
        s, t = deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), deg.select(F.col("id").alias("dst"), F.col("degree").alias("dt"))
        met = edges.join(s, "src", "left").join(t, "dst", "left")
        return met.select("src", "dst", (F.col("w") * F.sqrt(F.coalesce(inv("ds"), F.lit(0.0))) * F.sqrt(F.coalesce(inv("dt"), F.lit(0.0)))).alias("w"))
    raise ValueError(f"unknown normalization {how!r}")


def degree_summary(edges: DataFrame, nodes: DataFrame, by: str = "src") -> DataFrame:
    """Of the number of edges at each node."""
    counts = edges.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("k"))
    k = F.coalesce("k", F.lit(0))
    return nodes.select("id").join(counts, "id", "left").agg(F.min(k).alias("min"), F.avg(k).alias("mean"), F.max(k).alias("max"), F.count_if(k == 0).alias("zero"))


def coalesced(edges: DataFrame, how: str = "sum") -> DataFrame:
    return edges.groupBy("src", "dst").agg({"sum": F.sum, "max": F.max}[how]("w").alias("w"))


def induced(edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with new ids 0.., edges among them by new ids). Ids are numbered by rank over ranges of the old ones."""
    ids = kept.select("id").distinct()
    bucket = F.floor(F.col("id") / 65536)
    per = ids.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_below", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))  # a row for 65536 ids
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("id"))
    new = ids.withColumn("_b", bucket).withColumn("_r", inside).join(per, "_b").select("id", (F.col("_below") + F.col("_r") - 1).alias("new_id"))
    s, t = new.select(F.col("id").alias("src"), F.col("new_id").alias("s")), new.select(F.col("id").alias("dst"), F.col("new_id").alias("t"))
    return new, edges.join(s, "src").join(t, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"), "w")


def sparsified(edges: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Each edge with probability `fraction`; if none is drawn, the one of least ticket."""
    drawn = edges.filter(uniform(seed, "sparsify", "src", "dst") < fraction)
    if drawn.limit(1).count():
        return drawn
    return edges.orderBy(ticket(seed, "sparsify", "src", "dst")).limit(1)


def with_weight(edges: DataFrame, w: float = 1.0) -> DataFrame:
    return edges.withColumn("w", F.coalesce("w", F.lit(w)) if "w" in edges.columns else F.lit(w))


def spmm(edges: DataFrame, x: DataFrame, size: int) -> DataFrame:
    """(id, x): out[dst] = sum of w * x[src], arrays of `size` doubles. Sums are combined before the shuffle."""
    met = edges.join(x.select(F.col("id").alias("src"), "x"), "src")
    sums = [F.sum(F.col("w") * F.col("x")[i]).alias(f"_{i}") for i in range(size)]
    return met.groupBy(F.col("dst").alias("id")).agg(*sums).select("id", F.array(*[f"_{i}" for i in range(size)]).alias("x"))


@dataclass(frozen=True)
class GraphSpec:
    scheme: str = "knn"
    metric: str = "cosine"
    k: int = 30
    radius: float = 0.5
    weights: str = "heat"
    sigma: float = 0.5
    symmetrize: str = "mutual"
    self_loops: bool = True
    normalize: str = "rw"
    n_anchors: int | None = None
    per_node: int = 5
    candidate_limit: int | None = None
    seed: int = 0
    block_rows: int | None = None

    @classmethod
    def from_dict(cls, d: dict) -> GraphSpec:
        unknown = set(d) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        return cls(**d).validated()

    def validated(self) -> GraphSpec:
        checks = [
            (self.scheme in ("knn", "epsilon", "anchor"), "scheme"), (self.metric in ("cosine", "euclidean"), "metric"), (self.k >= 1, "k"), (self.radius > 0, "radius"),
            (self.weights in ("binary", "heat", "cosine"), "weights"), (self.weights != "cosine" or self.metric == "cosine", "weights"), (self.sigma > 0, "sigma"),
            (self.symmetrize in ("none", "or", "mutual"), "symmetrize"), (self.normalize in ("none", "rw", "sym"), "normalize"), (self.per_node >= 1, "per_node"),
        ]
        for ok, what in checks:
            if not ok:
                raise ValueError(f"bad {what}")
        return self

    def fingerprint(self) -> str:
        return fingerprint(asdict(self))


def raw_pairs(nodes: DataFrame, spec: GraphSpec) -> DataFrame:
    if spec.scheme == "knn":
        return similarity.knn(nodes, spec.k, spec.metric, block_rows=spec.block_rows)
    if spec.scheme == "epsilon":
        return similarity.epsilon_pairs(nodes, spec.radius, spec.metric)
    return similarity.anchor_graph(nodes, spec.k, spec.seed, spec.per_node, spec.n_anchors, spec.metric, spec.candidate_limit)


def build_graph(nodes: DataFrame, spec: GraphSpec) -> DataFrame:
    """Pairs, weights, symmetry, loops, normalization, in this order; edges with a weight that is not finite fail."""
    edges = symmetrized(weighted(raw_pairs(nodes, spec), spec.weights, spec.sigma, spec.metric), spec.symmetrize)
    if spec.self_loops:
        edges = with_loops(edges, nodes)
    edges = normalized(edges, spec.normalize, "src")
    bad = F.isnan("w") | (F.abs("w") == float("inf"))
    return edges.withColumn("w", F.when(bad, F.raise_error(F.lit("a weight is not finite")).cast("double")).otherwise(F.col("w")))
