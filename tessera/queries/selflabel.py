"""SURVEY 2.11, 2.12 and appendix A on the driver's tables. Scores are shares of event types by user."""

from pyspark.sql import functions as F

from tessera.functions.seeds import sql_ticket
from tessera.operators import classifiers as C
from tessera.operators import sampling as S
from tessera.operators import selflabel as L
from tessera.operators import similarity as K
from tessera.operators import thresholds as T
from tessera.queries import query, table
from tessera.queries.graphs import N

SEED = 7


def _nodes(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))
    marked = S.select_labelled(rows.select("id", "y"), "y", S.Labelling("per_class", 8), SEED).select("id", "is_labelled")
    return rows.join(marked, "id")


LAB = f"{N}, l AS MATERIALIZED (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, 'label', 'id')}, id) <= 8 AS known FROM n)"

#: Eight columns of scores that sum to 1, from vectors.
SC = "s AS MATERIALIZED (SELECT vec_id AS id, label AS y, [exp(4 * CAST(embedding[i + {o}] AS DOUBLE)) / list_sum([exp(4 * CAST(embedding[j + {o}] AS DOUBLE)) FOR j IN range(1, 6)]) FOR i IN range(1, 6)] AS x FROM embeddings)"
S0, S1 = SC.format(o=0), SC.format(o=5).replace("s AS MATERIALIZED", "t AS MATERIALIZED")
ARG = "list_position(x, list_max(x)) - 1"


def _scores(spark, d, offset=0):
    e = F.transform(F.slice(F.col("embedding").cast("array<double>"), offset + 1, 5), lambda v: F.exp(4 * v))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"), e.alias("x"))
    return rows.withColumn("x", F.transform("x", lambda v: v / F.aggregate("x", F.lit(0.0), lambda a, b: a + b)))


def _r(df, *cols, digits=6):
    return df.select(*[c for c in df.columns if c not in cols], *[F.round(c, digits).alias(c) for c in cols])


@query(f"""WITH {LAB}, d AS (SELECT a.id, b.id AS o, list_distance(a.x, b.x) AS d, lb.y FROM m a JOIN l la ON la.id = a.id AND NOT la.known JOIN l lb ON lb.known JOIN m b ON b.id = lb.id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS r FROM d) WHERE r <= 5), v AS (SELECT id, y, count(*) AS n FROM k GROUP BY 1, 2)
SELECT id, CAST(y AS INTEGER) AS p, n / 5.0 AS conf FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, y) AS r FROM v) WHERE r = 1""")
def knn_classify(spark, d):
    rows = _nodes(spark, d)
    return C.predicted(C.Knn().fit(rows.filter("is_labelled"), 10).scores(rows.filter("not is_labelled"))).select("id", "p", "conf")


NB = """, e AS MATERIALIZED (SELECT n.id, l.known, l.y, unnest(n.x) AS v, unnest(range(64)) AS i FROM n JOIN l USING (id)), g AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT var_pop(v) AS v FROM e WHERE known GROUP BY i)),
st AS MATERIALIZED (SELECT y, i, avg(v) AS mu, var_pop(v) + any_value(eps) AS var FROM e, g WHERE known GROUP BY 1, 2),
j AS MATERIALIZED (SELECT e.id, st.y, sum(-0.5 * ln(2 * pi() * var) - (v - mu) * (v - mu) / (2 * var)) AS s FROM e JOIN st USING (i) WHERE NOT known GROUP BY 1, 2),
q AS MATERIALIZED (SELECT id, y, exp(s - max(s) OVER (PARTITION BY id)) AS w FROM j), pr AS MATERIALIZED (SELECT id, y, w / sum(w) OVER (PARTITION BY id) AS w FROM q)"""


@query(f"WITH {LAB}{NB} SELECT id, CAST(y AS INTEGER) AS p, round(w, 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, y) AS r FROM pr) WHERE r = 1")
def gaussian_nb(spark, d):
    rows = _nodes(spark, d)
    return _r(C.predicted(C.GaussianNB().fit(rows.filter("is_labelled"), 10).scores(rows.filter("not is_labelled"))).select("id", "p", "conf"), "conf")


COUNTED = """, e AS MATERIALIZED (SELECT n.id, l.known, l.y, {value} AS v, i FROM (SELECT id, unnest(x) AS v0, unnest(range(64)) AS i FROM n) n JOIN l USING (id)),
pc AS MATERIALIZED (SELECT y, ln(count(*) / (SELECT count(*) FROM l WHERE known)::DOUBLE) AS prior, count(*) AS nc FROM l WHERE known GROUP BY 1), st AS MATERIALIZED (SELECT y, i, sum(v) AS s FROM e WHERE known GROUP BY 1, 2),
j AS MATERIALIZED (SELECT e.id, st.y, any_value(prior) + sum({term}) AS s FROM e JOIN (SELECT st.*, prior, nc, sum(s + 1) OVER (PARTITION BY y) AS t FROM st JOIN pc USING (y)) st USING (i) WHERE NOT known GROUP BY 1, 2),
pr AS MATERIALIZED (SELECT id, y, exp(s - max(s) OVER (PARTITION BY id)) / sum(exp(s)) OVER (PARTITION BY id) * exp(max(s) OVER (PARTITION BY id)) AS w FROM j)
SELECT id, CAST(y AS INTEGER) AS p, round(w, 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, y) AS r FROM pr) WHERE r = 1"""


def _classified(spark, d, model, value):
    rows = _nodes(spark, d).withColumn("x", F.transform("x", value))
    return _r(C.predicted(model.fit(rows.filter("is_labelled"), 10).scores(rows.filter("not is_labelled"))).select("id", "p", "conf"), "conf")


@query(f"WITH {LAB}" + COUNTED.format(value="abs(n.v0)", term="v * ln((st.s + 1) / t)"))
def multinomial_nb(spark, d):
    return _classified(spark, d, C.MultinomialNB(), lambda v: F.abs(v))


@query(f"WITH {LAB}" + COUNTED.format(value="CASE WHEN n.v0 > 0 THEN 1.0 ELSE 0.0 END", term="CASE WHEN v > 0 THEN ln((st.s + 1) / (nc + 2)) ELSE ln(1 - (st.s + 1) / (nc + 2)) END"))
def bernoulli_nb(spark, d):
    return _classified(spark, d, C.BernoulliNB(), lambda v: v)


@query(f"WITH {LAB}{NB}, b AS (SELECT id, CAST(y AS INTEGER) AS p, w AS conf FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, y) AS r FROM pr) WHERE r = 1 AND w >= 0.95) SELECT id, p FROM b")
def pseudo_label_round(spark, d):
    rows = _nodes(spark, d)
    return L.confident(C.GaussianNB().fit(rows.filter("is_labelled"), 10).scores(rows.filter("not is_labelled")), 0.95).select("id", "p")


@query(f"WITH {S0}, b AS (SELECT id, {ARG} AS p, list_max(x) AS conf FROM s) SELECT id, CAST(p AS INTEGER) AS p, round(conf, 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY conf DESC, id) AS r FROM b) WHERE r <= 3")
def top_per_class(spark, d):
    return _r(L.top_per_class(_scores(spark, d), 3), "conf")


@query(f"""WITH {S0}, b AS (SELECT id, id % 40 AS grp, y % 5 AS y, id % 4 = 0 AS known, {ARG} AS p, list_max(x) AS conf FROM s), dr AS (SELECT * FROM b WHERE NOT known AND conf >= 0.4),
v AS (SELECT grp, y AS p, 1.0 AS conf FROM b WHERE known UNION ALL SELECT grp, p, conf FROM dr), c AS (SELECT grp, p, count(*) AS n, avg(conf) AS conf FROM v GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS a, row_number() OVER (PARTITION BY grp ORDER BY n DESC, p) AS r FROM c)
SELECT b.id, CAST(w.p AS INTEGER) AS p, round(w.conf, 6) AS conf FROM b JOIN w ON b.grp = w.grp AND w.r = 1 AND a >= 2 AND n / a >= 0.5 WHERE NOT known AND b.conf < 0.4""")
def group_vote(spark, d):
    rows = _scores(spark, d).withColumns({"grp": F.col("id") % 40, "known": F.col("id") % 4 == 0})
    pool, known = rows.filter("not known"), rows.filter("known").select("grp", (F.col("y") % 5).alias("y"))
    return _r(L.group_votes(L.confident(pool, 0.4), known, pool, 2, 0.5), "conf")


@query(f"WITH {S0}, {S1}, b AS (SELECT id, {ARG} AS p, list_max(x) AS conf FROM s), c AS (SELECT id, {ARG} AS p, list_max(x) AS conf FROM t) SELECT 'a' AS view, id, CAST(p AS INTEGER) AS p FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY conf DESC, id) AS r FROM b) WHERE r <= 2 UNION ALL SELECT 'b', id, CAST(p AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY conf DESC, id) AS r FROM c) WHERE r <= 2")
def cotrain_round(spark, d):
    a, b = L.co_round(_scores(spark, d), _scores(spark, d, 5), 2)
    return a.select(F.lit("a").alias("view"), "id", "p").unionByName(b.select(F.lit("b").alias("view"), "id", "p"))


@query(f"WITH {S0}, {S1}, b AS (SELECT id, {ARG} AS p, list_max(x) AS c FROM s), c AS (SELECT id, {ARG} AS q, list_max(x) AS e FROM t) SELECT id, CAST(p AS INTEGER) AS p, round((c + e) / 2, 6) AS conf FROM b JOIN c USING (id) WHERE p = q AND c >= 0.3 AND e >= 0.3")
def tritrain_agree(spark, d):
    return _r(L.agreed(_scores(spark, d), _scores(spark, d, 5), 0.3), "conf")


@query("""WITH p AS (SELECT event_id AS id, user_id % 3 AS p0, event_id % 3 AS p1, CAST(floor(value) AS BIGINT) % 3 AS p2 FROM events), s AS (SELECT *, [CASE WHEN p0 = c THEN 0.5 ELSE 0 END + CASE WHEN p1 = c THEN 0.3 ELSE 0 END + CASE WHEN p2 = c THEN 0.2 ELSE 0 END FOR c IN range(3)] AS s FROM p)
SELECT id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS p, len([v FOR v IN s IF v = list_max(s)]) = 1 AS strict FROM s""")
def democratic_vote(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("p0"), (F.col("event_id") % 3).alias("p1"), (F.floor("value") % 3).alias("p2"))
    return L.weighted_majority(rows, [0.5, 0.3, 0.2], 3).select("id", "p", "strict")


@query(f"WITH {S0}, b AS (SELECT id, CASE WHEN x[1] >= x[2] THEN 0 ELSE 1 END AS p, greatest(x[1], x[2]) AS conf FROM s), r AS (SELECT *, row_number() OVER (ORDER BY conf, id) AS k, count(*) OVER () AS n FROM b) SELECT id, CASE WHEN k <= round_even(0.1 * n, 0) THEN 1 - p ELSE p END AS y FROM r")
def s4vm_flip(spark, d):
    rows = _scores(spark, d).withColumn("x", F.slice("x", 1, 2))
    return L.flipped(rows, round(0.1 * rows.count()))


@query(f"""WITH {N}, k AS MATERIALIZED (SELECT * FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM m a JOIN m b ON a.id <> b.id) WHERE r <= 5), u AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k),
c AS (SELECT y, count(*) / (SELECT count(*) FROM n)::DOUBLE AS p FROM n GROUP BY 1), o AS (SELECT a.id, any_value(a.y) AS y, sum(CASE WHEN a.y <> b.y THEN 1.0 ELSE 0.0 END) AS o, count(*) AS w FROM u JOIN n a ON a.id = src JOIN n b ON b.id = dst GROUP BY 1)
SELECT id, o, round((1 - p) * w, 6) AS mu, round(p * (1 - p) * w, 6) AS var FROM o JOIN c USING (y)""")
def cut_edge_stat(spark, d):
    rows = _nodes(spark, d).select("id", "x", "y")
    n = rows.count()
    shares = {r["y"]: r["count"] / n for r in rows.groupBy("y").count().collect()}
    return _r(L.cut_edge_test(L.knn_union(rows, 5), rows, shares).select("id", "o", "mu", "var"), "mu", "var")


@query(f"""WITH {LAB}, q AS MATERIALIZED (SELECT m.* FROM m JOIN l USING (id) WHERE known), d AS MATERIALIZED (SELECT a.id AS s, b.id AS t, list_distance(a.x, b.x) AS w FROM q a JOIN q b ON a.id <> b.id)
SELECT g.s AS src, g.t AS dst FROM d g WHERE NOT EXISTS (SELECT 1 FROM d e JOIN d f ON f.t = e.t WHERE e.s = g.s AND f.s = g.t AND e.w < g.w AND f.w < g.w)""")
def relative_neighbours(spark, d):
    return L.relative_neighbours(_nodes(spark, d).filter("is_labelled")).select("src", "dst")


@query(f"WITH {S0} SELECT id, round(pow(x[1], 2) / list_sum([v * v FOR v IN x]), 6) AS a, round(pow(x[5], 2) / list_sum([v * v FOR v IN x]), 6) AS b FROM s")
def sharpen(spark, d):
    from tessera.functions.vectors import sharpened

    got = _scores(spark, d).withColumn("q", sharpened("x", 0.5))
    return got.select("id", F.round(F.col("q")[0], 6).alias("a"), F.round(F.col("q")[4], 6).alias("b"))


@query(f"WITH {S0} SELECT id, CAST({ARG} AS INTEGER) AS p, CASE WHEN list_max(x) >= 0.35 THEN 1.0 ELSE 0.0 END AS mask FROM s")
def fixmatch_mask(spark, d):
    return T.fixmatch_mask(_scores(spark, d), 0.35)


@query(f"WITH {S0}, b AS (SELECT CASE WHEN list_max(x) >= 0.35 THEN {ARG} ELSE -1 END AS c FROM s), k AS (SELECT c, count(*) AS n FROM b GROUP BY 1), r AS (SELECT unnest(range(5)) AS c), a AS (SELECT r.c, coalesce(n, 0) / (SELECT max(n) FROM k) AS a FROM r LEFT JOIN k USING (c)) SELECT c AS cls, round(0.95 * a / (2 - a), 6) AS threshold FROM a")
def flexmatch_threshold(spark, d):
    got = T.fixmatch_mask(_scores(spark, d), 0.35)
    state = got.select("id", F.when(F.col("mask") == 1, F.col("p")).otherwise(-1).alias("last"))
    limits = T.flexmatch_threshold(T.class_progress(state, 5))
    return spark.createDataFrame([(c, round(v, 6)) for c, v in limits.items()], "cls long, threshold double")


@query(f"WITH {S0}, q AS (SELECT 0.9 * 0.2 + 0.1 * quantile_cont(list_max(x), 0.8) AS tau FROM s), e AS (SELECT unnest(x) AS v, unnest(range(5)) AS c FROM s), m AS (SELECT c, 0.9 * 0.2 + 0.1 * avg(v) AS m FROM e GROUP BY 1) SELECT c AS cls, round(tau * m / max(m) OVER (), 6) AS threshold FROM m, q")
def freematch_threshold(spark, d):
    got = T.freematch_thresholds(_scores(spark, d), 5, m=0.9)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in got["limits"].items()], "cls long, threshold double")


@query(f"WITH {S0}, q AS (SELECT 0.5 * 0.2 + 0.5 * avg(list_max(x)) AS mu, 0.5 * 1.0 + 0.5 * var_samp(list_max(x)) AS var FROM s) SELECT id, round(exp(-pow(least(list_max(x) - mu, 0), 2) / (2 * var / 4)), 6) AS w FROM s, q")
def softmatch_weight(spark, d):
    rows = _scores(spark, d)
    return _r(T.softmatch_weight(rows, T.softmatch_state(rows, 5, m=0.5)), "w")


@query(f"WITH {S0}, e AS (SELECT id, unnest(x) AS v, unnest(range(5)) AS c FROM s), m AS (SELECT c, avg(v) AS m FROM e GROUP BY 1), a AS (SELECT id, c, v * 0.2 / m AS w FROM e JOIN m USING (c)) SELECT id, c, round(w / sum(w) OVER (PARTITION BY id), 6) AS f FROM a")
def adamatch_align(spark, d):
    rows = _scores(spark, d)
    got = T.aligned(rows, [0.2] * 5, T.mean_scores(rows, 5))
    return got.select("id", F.posexplode("x").alias("c", "f")).select("id", "c", F.round("f", 6).alias("f"))


@query(f"""WITH {S0}, b AS (SELECT id, {ARG} AS p, list_max(x) AS conf FROM s), rho AS (SELECT count(*) FILTER (WHERE conf >= 0.35) / count(*)::DOUBLE AS rho FROM b WHERE p = 0), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY conf DESC, id) AS k, count(*) OVER (PARTITION BY p) AS n FROM b)
SELECT p AS cls, round(CASE WHEN p = 0 THEN 0.35 ELSE least(conf, 0.35) END, 6) AS threshold FROM r, rho WHERE k = CASE WHEN p = 0 THEN 1 ELSE greatest(round_even(n * rho - 1, 0), 0) + 1 END""")
def adsh_threshold(spark, d):
    got = T.adsh_thresholds(_scores(spark, d), 0, 5, 0.35)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in got.items()], "cls long, threshold double")


@query(f"WITH {S0} SELECT count(*) FILTER (WHERE x[y % 5 + 1] < 0.6) AS kept, count(*) FILTER (WHERE pow(list_max(x), 2.5) / list_sum([pow(v, 2.5) FOR v IN x]) >= 0.4) AS masked FROM s")
def uda_rules(spark, d):
    rows = _scores(spark, d).withColumn("y", (F.col("y") % 5).cast("int"))
    kept = T.tsa_kept(rows, T.tsa_threshold(1, 2, 5)).agg(F.count_if("kept").alias("kept"))
    return kept.crossJoin(T.uda_mask(rows, 0.4).agg(F.count_if("mask").alias("masked")))  # one row each


@query(f"WITH {S0}, {S1}, j AS (SELECT s.id, s.x AS a, t.x AS b, [(s.x[i] + t.x[i]) / 2 FOR i IN range(1, 6)] AS m FROM s JOIN t USING (id)) SELECT id, round(-list_sum([v * ln(v) FOR v IN m]) + (list_sum([v * ln(v) FOR v IN a]) + list_sum([v * ln(v) FOR v IN b])) / 2, 6) AS js FROM j")
def js_divergence(spark, d):
    return _r(T.js_divergence(_scores(spark, d), _scores(spark, d, 5)), "js")


@query(f"WITH {S0}, {S1}, j AS (SELECT [pow(s.x[i] - t.x[i], 2) FOR i IN range(1, 6)] AS q FROM s JOIN t USING (id)) SELECT round(avg(list_sum(q) / 5) * 0.5, 8) AS loss FROM j")
def consistency_loss(spark, d):
    return _r(T.consistency(_scores(spark, d), _scores(spark, d, 5), 5, 10), "loss", digits=8)


@query(f"WITH {S0}, p AS (SELECT a.id AS src, b.id AS dst, CASE WHEN a.id = b.id THEN 1.0 ELSE list_dot_product(a.x, b.x) END AS w FROM s a JOIN s b ON a.id // 50 = b.id // 50), k AS (SELECT * FROM p WHERE w >= 0.25) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM k")
def comatch_graph(spark, d):
    return _r(T.pseudo_graph(_scores(spark, d).withColumn("batch", F.floor(F.col("id") / 50)), 0.25), "w")


@query("WITH e AS (SELECT o_custkey AS src, o_orderdate AS dst, o_totalprice / 100000 AS l FROM orders) SELECT src, CAST(epoch(dst) AS BIGINT) AS dst, round(exp(l - max(l) OVER (PARTITION BY dst)) / sum(exp(l)) OVER (PARTITION BY dst) * exp(max(l) OVER (PARTITION BY dst)), 6) AS a FROM e")
def edge_softmax(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.unix_timestamp("o_orderdate").alias("dst"), (F.col("o_totalprice") / 100000).alias("l"))
    return _r(T.edge_softmax(rows), "a")


@query(f"WITH {N}, k AS MATERIALIZED (SELECT * FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY 1.0 - list_dot_product(a.x, b.x) / a.r / b.r, b.id) AS r FROM m a JOIN m b ON a.id <> b.id) WHERE r <= 3), two AS (SELECT DISTINCT a.src, b.dst FROM k a JOIN k b ON a.dst = b.src WHERE a.src <> b.dst) SELECT src, dst, 1 AS hop FROM k UNION ALL SELECT src, dst, 2 FROM two ANTI JOIN k USING (src, dst)")
def hop_rings(spark, d):
    rows = _nodes(spark, d)
    return T.hop_rings(K.knn(rows, 3), rows, 2)


def _loop(spark, d, f):
    rows = _nodes(spark, d)
    return f(rows.filter("is_labelled").select("id", "x", "y"), rows.filter("not is_labelled").select("id", "x"))


@query()
def self_training(spark, d):
    return _loop(spark, d, lambda a, b: L.self_training(a, b, 10, rounds=3).labelled.select("id", "y"))


@query()
def setred(spark, d):
    return _loop(spark, d, lambda a, b: L.setred(a, b, 10, rounds=1, graph="knn").labelled.select("id", "y"))


@query()
def tri_training(spark, d):
    return _loop(spark, d, lambda a, b: C.predicted(L.tri_training(a, b, 10, rounds=1)["models"][0].scores(b)).select("id", "p"))


@query()
def softmax_student(spark, d):
    return _loop(spark, d, lambda a, b: C.predicted(C.Student(steps=10).fit(a, 10).scores(b)).select("id", "p"))


@query()
def logreg(spark, d):
    return _loop(spark, d, lambda a, b: C.predicted(C.build("logreg").fit(a, 10).scores(b)).select("id", "p"))


@query()
def ridge(spark, d):
    return _loop(spark, d, lambda a, b: C.predicted(C.Ridge().fit(a, 10).scores(b)).select("id", "p"))
