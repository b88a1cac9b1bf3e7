"""SURVEY 2.6, 2.8 and 2.10 on the driver's tables."""

from pyspark.sql import functions as F

from tessera.functions.seeds import sql_ticket, sql_uniform
from tessera.operators import edges as E
from tessera.operators import metrics as M
from tessera.operators import propagate as P
from tessera.operators import sampling as S
from tessera.operators import similarity as K
from tessera.queries import query, table

SEED, DEG = 7, 8


def _nodes(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))


N = "n AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label AS y FROM embeddings), m AS MATERIALIZED (SELECT *, greatest(sqrt(list_dot_product(x, x)), 1e-12) AS r FROM n)"
COS = "1.0 - list_dot_product(a.x, b.x) / a.r / b.r"
KNN = f"{N}, k AS MATERIALIZED (SELECT src, dst, d FROM (SELECT a.id AS src, b.id AS dst, {COS} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {COS}, b.id) AS r FROM m a JOIN m b ON a.id <> b.id) WHERE r <= {DEG})"
HEAT = f"{KNN}, h AS MATERIALIZED (SELECT src, dst, exp(-d * d / 0.5) AS w FROM k)"


@query(f"WITH {KNN} SELECT src, dst, round(d, 6) AS d FROM k")
def knn_cosine(spark, d):
    return K.knn(_nodes(spark, d), DEG).withColumn("d", F.round("d", 6))


@query(f"WITH {N} SELECT src, dst, round(d, 6) AS d FROM (SELECT a.id AS src, b.id AS dst, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM m a JOIN m b ON a.id <> b.id) WHERE r <= {DEG}")
def knn_euclidean(spark, d):
    return K.knn(_nodes(spark, d), DEG, "euclidean").withColumn("d", F.round("d", 6))


@query(f"WITH {N} SELECT a.id AS src, b.id AS dst, round(list_distance(a.x, b.x), 6) AS d FROM m a JOIN m b ON a.id <> b.id WHERE list_distance(a.x, b.x) <= 1.15")
def epsilon_graph(spark, d):
    return K.epsilon_pairs(_nodes(spark, d), 1.15).withColumn("d", F.round("d", 6))


@query(f"""WITH {N}, c AS (SELECT count(*) AS n FROM n), t AS MATERIALIZED (SELECT * FROM (SELECT m.*, row_number() OVER (ORDER BY {sql_ticket(SEED, 'anchor', 'id')}, id) AS k FROM m), c WHERE k <= greatest(10, round_even(sqrt(c.n), 0))),
o AS MATERIALIZED (SELECT id, anchor FROM (SELECT a.id, b.id AS anchor, row_number() OVER (PARTITION BY a.id ORDER BY {COS}, b.id) AS r FROM m a, t b) WHERE r <= 3),
p AS MATERIALIZED (SELECT DISTINCT l.id AS src, r.id AS dst FROM o l JOIN o r ON l.anchor = r.anchor AND l.id <> r.id)
SELECT src, dst, round(d, 6) AS d FROM (SELECT src, dst, {COS} AS d, row_number() OVER (PARTITION BY src ORDER BY {COS}, dst) AS r FROM p JOIN m a ON a.id = src JOIN m b ON b.id = dst) WHERE r <= {DEG}""")
def anchor_graph(spark, d):
    return K.anchor_graph(_nodes(spark, d), DEG, SEED, 3).withColumn("d", F.round("d", 6))


def _knn(spark, d):
    return K.knn(_nodes(spark, d), DEG)


def _heat(spark, d):
    return E.weighted(_knn(spark, d))


def _r(df, *cols):
    return df.select(*[c for c in df.columns if c not in cols], *[F.round(c, 6).alias(c) for c in cols])


@query(f"WITH {HEAT} SELECT src, dst, round(w, 6) AS w FROM h")
def weight_heat(spark, d):
    return _r(_heat(spark, d), "w")


@query(f"WITH {KNN} SELECT src, dst, round(1.0 - d, 6) AS w FROM k")
def weight_cosine(spark, d):
    return _r(E.weighted(_knn(spark, d), "cosine"), "w")


SYM = "SELECT f.src, f.dst, (f.w + g.w) / 2 AS w FROM h f JOIN h g ON f.src = g.dst AND f.dst = g.src"
MUTUAL = f"{HEAT}, u AS MATERIALIZED ({SYM})"
LOOPS = f"{MUTUAL}, l AS MATERIALIZED (SELECT * FROM u UNION ALL SELECT id, id, 1.0 FROM n)"
RW = f"{LOOPS}, e AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM l)"


@query(f"WITH {MUTUAL} SELECT src, dst, round(w, 6) AS w FROM u")
def symmetrize_mutual(spark, d):
    return _r(E.symmetrized(_heat(spark, d)), "w")


@query(f"WITH {HEAT} SELECT src, dst, round(avg(w), 6) AS w FROM (SELECT src, dst, w FROM h UNION ALL SELECT dst, src, w FROM h) GROUP BY 1, 2")
def symmetrize_or(spark, d):
    return _r(E.symmetrized(_heat(spark, d), "or"), "w")


@query(f"WITH {LOOPS} SELECT src, dst, round(w, 6) AS w FROM l")
def self_loops(spark, d):
    return _r(E.with_loops(E.symmetrized(_heat(spark, d)), _nodes(spark, d)), "w")


def _graph(spark, d, normalize="none", **more):
    return E.build_graph(_nodes(spark, d), E.GraphSpec(k=DEG, normalize=normalize, **more))


@query(f"WITH {RW} SELECT src, dst, round(w, 6) AS w FROM e")
def build_graph(spark, d):
    return _r(_graph(spark, d, "rw"), "w")


@query(f"WITH {LOOPS}, g AS (SELECT src AS id, sum(w) AS g FROM l GROUP BY 1) SELECT src, dst, round(w / sqrt(a.g * b.g), 6) AS w FROM l JOIN g a ON a.id = src JOIN g b ON b.id = dst")
def normalize_sym_src(spark, d):
    return _r(_graph(spark, d, "sym"), "w")


@query(f"WITH {HEAT} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY dst), 6) AS w FROM h")
def normalize_rw_dst(spark, d):
    return _r(E.normalized(_heat(spark, d), "rw", "dst"), "w")


@query(f"WITH {MUTUAL}, c AS (SELECT n.id, count(u.src) AS k FROM n LEFT JOIN u ON n.id = u.src GROUP BY 1) SELECT min(k) AS min, round(avg(k), 6) AS mean, max(k) AS max, count(*) FILTER (WHERE k = 0) AS zero FROM c")
def degree_summary(spark, d):
    return E.degree_summary(E.symmetrized(_heat(spark, d)), _nodes(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {HEAT}, q AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n WHERE y < 4) SELECT a.k AS src, b.k AS dst, round(w, 6) AS w FROM h JOIN q a ON a.id = src JOIN q b ON b.id = dst")
def induced_subgraph(spark, d):
    return _r(E.induced(_heat(spark, d), _nodes(spark, d).filter("y < 4"))[1], "w")


@query("SELECT o_custkey AS src, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS dst, round(sum(o_totalprice), 2) AS w FROM orders GROUP BY 1, 2")
def coalesce_edges(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.substring("o_orderpriority", 1, 1).cast("long").alias("dst"), F.col("o_totalprice").alias("w"))
    return E.coalesced(rows).withColumn("w", F.round("w", 2))


@query(f"SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE {sql_uniform(SEED, 'sparsify', 'o_custkey', 'o_orderkey')} < 0.3")
def edge_sparsify(spark, d):
    return E.sparsified(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), 0.3, SEED)


@query(f"WITH {HEAT} SELECT dst AS id, c, round(sum(w * n.x[c + 1]), 6) AS f FROM h JOIN n ON n.id = src, (SELECT unnest(range(64)) AS c) GROUP BY 1, 2")
def spmm(spark, d):
    return _long(E.spmm(_heat(spark, d), _nodes(spark, d), 64))


#: Long tables (id, c, f) in SQL, arrays in Spark.
SEEDS = f"y0 AS MATERIALIZED (SELECT id, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, 'label', 'id')}, id) <= 5 THEN y ELSE -1 END AS y FROM n), cls AS (SELECT unnest(range(10)) AS c), y AS MATERIALIZED (SELECT id, c, y0.y AS lab, CASE WHEN y0.y = c THEN 1.0 ELSE 0.0 END AS v FROM y0, cls)"


def _labels(spark, d):
    rows = S.select_labelled(_nodes(spark, d), "y", S.Labelling("per_class", 5), SEED)
    return rows.select("id", F.when(F.col("is_labelled"), F.col("y")).otherwise(-1).alias("y"))


def _lp_sql(steps):
    out = f"WITH {RW}, {SEEDS}, p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY dst) AS w FROM e), f0 AS (SELECT id, c, v AS f FROM y)"
    for i in range(steps):
        out += f""", g{i} AS MATERIALIZED (SELECT y.id, y.c, y.lab, y.v, coalesce(sum(p.w * f.f), 0) AS f FROM y LEFT JOIN p ON p.dst = y.id LEFT JOIN f{i} f ON f.id = p.src AND f.c = y.c GROUP BY 1, 2, 3, 4),
f{i + 1} AS MATERIALIZED (SELECT id, c, CASE WHEN lab >= 0 THEN v WHEN sum(f) OVER (PARTITION BY id) > 0 THEN f / sum(f) OVER (PARTITION BY id) ELSE f END AS f FROM g{i})"""
    return out


def _long(scores, digits=6):
    return scores.select("id", F.posexplode("x").alias("c", "f")).select("id", "c", F.round("f", digits).alias("f"))


@query(_lp_sql(6) + " SELECT id, c, round(f, 6) AS f FROM f6")
def label_propagation_k(spark, d):
    return _long(P.label_propagation(_graph(spark, d, "rw"), _labels(spark, d), 10, 6, None))


@query(_lp_sql(10) + """, b AS (SELECT id, c FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY f DESC, c) AS r FROM f10) WHERE r = 1), j AS (SELECT n.y, b.c AS p FROM b JOIN n USING (id) JOIN y0 USING (id) WHERE y0.y < 0)
SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM j""")
def flagship(spark, d):
    """Five labels a class, a cosine graph, ten steps of propagation: accuracy on the rest."""
    labels = _labels(spark, d)
    got = P.predictions(P.label_propagation(_graph(spark, d, "rw"), labels, 10, 10, None))
    truth = _nodes(spark, d).select("id", "y").join(labels.filter("y < 0").select("id"), "id", "left_semi")
    return M.accuracy(truth.join(got, "id")).select(F.round("accuracy", 6).alias("accuracy"))


def _fp_sql(source, alpha, steps, edges):
    out = f"WITH {RW}, {SEEDS}, dg AS (SELECT dst AS id, sum(w) AS g FROM e GROUP BY 1), s AS MATERIALIZED ({edges}), b AS MATERIALIZED ({source}), f0 AS (SELECT id, c, v AS f FROM b)"
    for i in range(steps):
        out += f", f{i + 1} AS MATERIALIZED (SELECT b.id, b.c, {alpha} * coalesce(sum(s.w * f.f), 0) + (1 - {alpha}) * b.v AS f FROM b LEFT JOIN s ON s.dst = b.id LEFT JOIN f{i} f ON f.id = s.src AND f.c = b.c GROUP BY b.id, b.c, b.v)"
    return out + f" SELECT id, c, round(f, 6) AS f FROM f{steps}"


@query(_fp_sql("SELECT id, c, v FROM y", 0.9, 5, "SELECT src, dst, w / sqrt(a.g * b.g) AS w FROM e JOIN dg a ON a.id = src JOIN dg b ON b.id = dst"))
def label_spreading_k(spark, d):
    return _long(P.label_spreading(_graph(spark, d, "rw"), _labels(spark, d), 10, 5, 0.9, None))


WIDE = "n, (SELECT unnest(range(64)) AS c)"


@query(_fp_sql(f"SELECT id, c, n.x[c + 1] AS v FROM {WIDE}", 0.9, 3, "SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e"))
def diffusion_view_k(spark, d):
    return _long(P.diffusion_view(_graph(spark, d, "rw"), _nodes(spark, d).select("id", "x"), 64, 3, 0.1))


@query(f"WITH {RW}, dg AS (SELECT dst AS id, sum(w) AS g FROM e GROUP BY 1), s AS MATERIALIZED (SELECT src, dst, w / sqrt(a.g * b.g) AS w FROM e JOIN dg a ON a.id = src JOIN dg b ON b.id = dst), v AS MATERIALIZED (SELECT id, c, x[c + 1] AS v FROM {WIDE}), q AS (SELECT dst AS id, c, sum(w * v) AS q FROM s JOIN v ON v.id = src GROUP BY 1, 2) SELECT id, c, round(v - coalesce(q, 0), 6) AS f FROM v LEFT JOIN q USING (id, c)")
def laplacian_matvec(spark, d):
    return _long(P.laplacian(_graph(spark, d, "rw"), _nodes(spark, d).select("id", "x"), 64))
