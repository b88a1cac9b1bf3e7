"""The iterative and the trained methods of SURVEY 2.10 and 2.11 on the driver's tables, and walks with their SQL twins."""

from pyspark.sql import functions as F

from tessera.functions.seeds import sql_uniform
from tessera.operators import classifiers as C
from tessera.operators import deep as D
from tessera.operators import propagate as P
from tessera.operators import small as Z
from tessera.operators import walks as W
from tessera.queries import query, table
from tessera.queries.graphs import HEAT, SEED, _graph, _heat, _labels, _nodes


def _graph_and_labels(spark, d):
    """All vectors, their graph, the class of every fifth."""
    from tessera.operators.edges import GraphSpec, build_graph

    rows = _nodes(spark, d)
    labels = rows.select("id", F.when(F.col("id") % 5 == 0, F.col("y")).otherwise(-1).alias("y"))
    return rows, P.cut(build_graph(rows, GraphSpec(k=8, symmetrize="or", normalize="none", self_loops=False))), labels


def _first_or_rest(labels):
    """For methods of two classes: the first against all others."""
    return labels.select("id", F.when(F.col("y") < 0, -1).when(F.col("y") == 0, 0).otherwise(1).alias("y"))


GIVEN = f"""{HEAT}, g AS MATERIALIZED (SELECT src, dst, avg(w) AS w FROM (SELECT src, dst, w FROM h UNION ALL SELECT dst, src, w FROM h) GROUP BY 1, 2), dg AS MATERIALIZED (SELECT dst AS id, sum(w) AS g FROM g GROUP BY 1),
sn AS MATERIALIZED (SELECT src, dst, w / sqrt(a.g * b.g) AS w FROM g JOIN dg a ON a.id = src JOIN dg b ON b.id = dst), cls AS (SELECT unnest(range(10)) AS c),
y AS MATERIALIZED (SELECT id, c, y AS lab, id % 5 = 0 AS known, CASE WHEN id % 5 = 0 AND y = c THEN 1.0 ELSE 0.0 END AS v FROM n, cls)"""


def _solved(b: str, product: str, steps: int = 60) -> str:
    """Conjugate gradients from zero, unrolled: b has (id, c, v); product gives A p from a state s (id, c, x, r, p)."""
    out = f"b AS MATERIALIZED ({b}), s0 AS MATERIALIZED (SELECT id, c, 0.0::DOUBLE AS x, v::DOUBLE AS r, v::DOUBLE AS p FROM b)"
    for i in range(steps):
        out += f""", a{i} AS MATERIALIZED ({product.replace("STATE", f"s{i}")}),
k{i} AS MATERIALIZED (SELECT c, CASE WHEN sum(p * ap) > 0 THEN sum(r * r) / sum(p * ap) ELSE 0 END AS al, sum(r * r) AS rr FROM a{i} GROUP BY 1),
t{i} AS MATERIALIZED (SELECT id, c, x + al * p AS x, r - al * ap AS r, p, rr FROM a{i} JOIN k{i} USING (c)),
u{i} AS MATERIALIZED (SELECT c, CASE WHEN any_value(rr) > 0 THEN sum(r * r) / any_value(rr) ELSE 0 END AS be FROM t{i} GROUP BY 1),
s{i + 1} AS MATERIALIZED (SELECT id, c, x, r, r + be * p AS p FROM t{i} JOIN u{i} USING (c))"""
    return out + f", f AS MATERIALIZED (SELECT id, c, x FROM s{steps})"


SENT = "(SELECT e.dst AS id, c, sum(e.w * p) AS q FROM {edges} e JOIN STATE ON STATE.id = e.src GROUP BY 1, 2)"
BEST = "SELECT id, CAST(c AS INTEGER) AS p FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY x DESC, c) AS k FROM {}) WHERE k = 1"
LAPLACE = _solved(
    "SELECT y.id, y.c, coalesce(q, 0) AS v FROM y LEFT JOIN (SELECT dst AS id, c, sum(w * v) AS q FROM g JOIN y ON y.id = src AND known GROUP BY 1, 2) USING (id, c) WHERE NOT known",
    "SELECT STATE.*, g * p - coalesce(q, 0) AS ap FROM STATE JOIN dg USING (id) LEFT JOIN " + SENT.format(edges="g") + " USING (id, c)",
)
LAZY = _solved(
    "SELECT id, 0 AS c, CASE WHEN id % 5 <> 0 THEN 0.0 WHEN y = 0 THEN -1.0 ELSE 1.0 END AS v FROM n",
    "SELECT STATE.*, p - 0.99 * coalesce(q, 0) AS ap FROM STATE LEFT JOIN " + SENT.format(edges="sn") + " USING (id, c)",
)
POISSON = _solved(
    "SELECT id, c, CASE WHEN known THEN v - avg(CASE WHEN known THEN v END) OVER (PARTITION BY c) ELSE 0 END AS v FROM y",
    "SELECT STATE.*, p - coalesce(q, 0) + 1e-6 * p + avg(p) OVER (PARTITION BY c) AS ap FROM STATE LEFT JOIN " + SENT.format(edges="sn") + " USING (id, c)",
)


WALK = f"""{HEAT}, nb AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS deg FROM h),
w0 AS MATERIALIZED (SELECT id || '/' || w AS walk, id AS node FROM n, (SELECT unnest(range(2)) AS w))"""
for t in (1, 2, 3):
    WALK += f""", w{t} AS MATERIALIZED (SELECT walk, nb.dst AS node FROM (SELECT walk, node, floor({sql_uniform(SEED, f"walk/{t}", "walk")} * (SELECT max(deg) FROM nb x WHERE x.src = node)) AS pick FROM w{t - 1}) v JOIN nb ON nb.src = v.node AND nb.k = v.pick)"""
WALK += ", s AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT walk, {t} AS pos, node FROM w{t}" for t in range(4)) + "), co AS MATERIALIZED (SELECT a.node AS a, b.node AS b, count(*) AS n FROM s a JOIN s b ON a.walk = b.walk AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 2 GROUP BY 1, 2)"


def _counts(spark, d):
    return W.cooccurrence(W.walks(_heat(spark, d), _nodes(spark, d), 4, 2, SEED), 2)


@query(f"WITH {WALK} SELECT a, b, n FROM co")
def cooccurrence(spark, d):
    return _counts(spark, d)


@query(f"WITH {WALK}, r AS (SELECT a, sum(n) AS r FROM co GROUP BY 1), c AS (SELECT b, sum(n) AS c FROM co GROUP BY 1), v AS (SELECT a, b, ln(n * (SELECT sum(n) FROM co)::DOUBLE / (r * c)) AS v FROM co JOIN r USING (a) JOIN c USING (b)) SELECT a, b, round(v, 6) AS v FROM v WHERE v > 0")
def ppmi(spark, d):
    return W.ppmi(_counts(spark, d)).withColumn("v", F.round("v", 6))


@query()
def struct_view(spark, d):
    return W.struct_view(_heat(spark, d), _nodes(spark, d), 16, 4, 2, 2, SEED)


@query(f"WITH {GIVEN}, {LAPLACE}, e AS (SELECT * FROM f UNION ALL SELECT id, c, v FROM y WHERE known) {BEST.format('e')}")
def laplace_learning(spark, d):
    _, edges, labels = _graph_and_labels(spark, d)
    return P.predictions(P.laplace_learning(edges, labels, 10))


@query(f"WITH {GIVEN}, {LAZY} SELECT id, CASE WHEN x >= 0 THEN 1 ELSE 0 END AS p FROM f")
def lazy_random_walk(spark, d):
    _, edges, labels = _graph_and_labels(spark, d)
    return P.predictions(P.lazy_random_walk(edges, _first_or_rest(labels)))


@query(f"WITH {GIVEN}, {POISSON} {BEST.format('f')}")
def poisson_learning(spark, d):
    _, edges, labels = _graph_and_labels(spark, d)
    return P.predictions(P.poisson_learning(edges, labels, 10))


@query()
def poisson_mbo(spark, d):
    _, edges, labels = _graph_and_labels(spark, d)
    return P.predictions(P.poisson_mbo(edges, labels, 10, steps=20, outer=2, inner=5))


@query()
def graph_mincut(spark, d):
    _, edges, labels = _graph_and_labels(spark, d)
    return P.predictions(Z.graph_mincut(edges, _first_or_rest(labels)))


@query()
def dynamic_label_propagation(spark, d):
    _, edges, labels = _graph_and_labels(spark, d)
    return P.predictions(Z.dynamic_label_propagation(edges, labels, 10))


@query()
def tsvm(spark, d):
    rows, _, labels = _graph_and_labels(spark, d)
    return P.predictions(Z.tsvm(rows.drop("y").join(_first_or_rest(labels), "id")))


@query()
def sgc(spark, d):
    return P.predictions(D.sgc(_graph(spark, d), _nodes(spark, d).select("id", "x"), _labels(spark, d), 10, 64))


@query()
def appnp(spark, d):
    x = _nodes(spark, d).select("id", "x")
    return P.predictions(D.appnp(_graph(spark, d), x, _labels(spark, d), 10, 3, base=C.GaussianNB()))


@query()
def fixmatch(spark, d):
    from tessera.operators.augment import weak_and_strong

    rows = _nodes(spark, d).select("id", "x")
    both = weak_and_strong(rows, "x", [("core.identity", {})], [("tabular.gaussian_noise", {"sigma": 0.05})], SEED)
    known = rows.join(_labels(spark, d).filter("y >= 0"), "id")
    model = D.train("fixmatch", known, both.select("id", F.col("weak").alias("x")), both.select("id", F.col("strong").alias("x")), 10, rounds=1, base=C.Student(steps=5), threshold=0.2)
    return C.predicted(model.scores(rows)).select("id", "p")


@query("SELECT user_id % 50 AS uri, max(event_id) AS kept FROM events GROUP BY 1")
def catalog_latest(spark, d):
    from tessera.sources.store import latest

    rows = table(spark, d, "events").select((F.col("user_id") % 50).alias("uri"), F.col("event_id").alias("created_at"))
    return latest(rows).select("uri", F.col("created_at").alias("kept"))
