"""SURVEY 2.3 and 2.7 on the driver's tables."""

from pyspark.sql import functions as F

from tessera.functions.seeds import part_seed, sql_ticket, sql_uniform, uniform
from tessera.operators import metrics as M
from tessera.operators import sampling as S
from tessera.queries import query, table

SEED = 7


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("y"))


def _nodes(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"))


EV = "SELECT event_id AS id, event_type AS y FROM events"
NODES = "SELECT vec_id AS id, label AS y FROM embeddings"


@query("SELECT l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 1")
def class_counts(spark, d):
    return S.class_counts(table(spark, d, "lineitem"), "l_returnflag")


@query(f"WITH t AS ({EV}), r AS (SELECT id, row_number() OVER (ORDER BY {sql_ticket(SEED, 'holdout', 'id')}, id) AS k, count(*) OVER () AS n FROM t) SELECT id, k <= round_even(0.2 * n, 0) AS held FROM r")
def holdout_random(spark, d):
    df = _events(spark, d)
    return S.random_holdout(df, round(0.2 * df.count()), SEED).select("id", F.col("_picked").alias("held"))


def _quota_sql(rows, target):
    return f"""c AS (SELECT y, count(*) AS n FROM {rows} GROUP BY 1), s AS (SELECT sum(n) AS total, CAST({target} AS BIGINT) AS target FROM c),
    f AS (SELECT y, n, (n * target) // total AS base, (n * target) % total AS rest, target FROM c, s),
    q AS (SELECT y, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= target - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM f)"""


def _strat(rows, salt, target, flag):
    return f"""{_quota_sql(rows, target)}, k AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, salt, 'id')}, id) AS k FROM {rows})
    SELECT k.id, k.y, k.k <= q.quota AS {flag} FROM k JOIN q USING (y)"""


@query(f"WITH t AS ({EV}), {_strat('t', 'holdout', 'round_even(0.2 * sum(n), 0)', 'held')}")
def holdout_stratified(spark, d):
    df = _events(spark, d)
    return S.stratified_holdout(df, round(0.2 * df.count()), "y", SEED).withColumnRenamed("_picked", "held")


@query(f"""WITH t AS ({EV}), a AS (WITH {_strat('t', 'test', 'round_even(0.2 * sum(n), 0)', 'test')}), u AS (SELECT id, y FROM a WHERE NOT test), b AS (WITH {_strat('u', 'val', 'round_even(0.1 * sum(n), 0)', 'val')})
SELECT id, y, 'test' AS part FROM a WHERE test UNION ALL SELECT id, y, CASE WHEN val THEN 'val' ELSE 'train' END FROM b""")
def holdout_three_way(spark, d):
    return S.holdout_split(_events(spark, d), "y", SEED)


@query(f"WITH t AS ({EV}) SELECT id, CAST(ntile(5) OVER (ORDER BY {sql_ticket(SEED, 'kfold', 'id')}, id) - 1 AS INTEGER) AS fold FROM t")
def kfold_plain(spark, d):
    return S.kfold(_events(spark, d), 5, SEED).select("id", "fold")


@query(f"WITH t AS ({EV}) SELECT id, CAST(ntile(5) OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, 'kfold', 'id')}, id) - 1 AS INTEGER) AS fold FROM t")
def kfold_stratified(spark, d):
    return S.kfold(_events(spark, d), 5, SEED, "y").select("id", "fold")


@query(f"WITH t AS ({EV}), {_strat('t', 'label', 'round_even(0.01 * sum(n), 0)', 'is_labelled')}")
def label_fraction_proportional(spark, d):
    return S.select_labelled(_events(spark, d), "y", S.Labelling("fraction", 0.01), SEED)


@query(f"""WITH t AS ({EV}), c AS (SELECT y, count(*) AS n FROM t GROUP BY 1), q AS (SELECT y, 93 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY n DESC, y) <= 93 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM c),
k AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, 'label', 'id')}, id) AS k FROM t) SELECT k.id, k.y, k.k <= quota AS is_labelled FROM k JOIN q USING (y)""")
def label_count_balanced(spark, d):
    return S.select_labelled(_events(spark, d), "y", S.Labelling("count", 93, "balanced"), SEED)


@query(f"WITH t AS ({NODES}) SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, 'label', 'id')}, id) <= 5 AS is_labelled FROM t")
def label_per_class(spark, d):
    return S.select_labelled(_nodes(spark, d), "y", S.Labelling("per_class", 5), SEED)


@query(f"WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS y FROM lineitem) SELECT id, y FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, 'cap', 'id')}, id) AS k FROM t) WHERE k <= 500")
def imbalance_cap(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("y"))
    return S.cap_per_class(rows, "y", 500, SEED)


@query(f"""WITH t AS ({EV}), c AS (SELECT y, count(*) AS n FROM t GROUP BY 1), r AS (SELECT y, n, row_number() OVER (ORDER BY n DESC, y) - 1 AS rank, max(n) OVER () AS top FROM c),
q AS (SELECT y, least(greatest(round_even(top * pow(0.6, rank), 0), 1), n) AS quota FROM r), k AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, 'tail', 'id')}, id) AS k FROM t)
SELECT k.id, k.y FROM k JOIN q USING (y) WHERE k.k <= quota""")
def imbalance_long_tail(spark, d):
    return S.long_tail(_events(spark, d), "y", 0.6, SEED)


@query(f"WITH t AS ({NODES}) SELECT id, y FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, 'label', 'id')}, id) AS k FROM t) WHERE k > 5")
def unlabelled_anti(spark, d):
    rows = _nodes(spark, d)
    return S.unlabelled(rows, S.select_labelled(rows, "y", S.Labelling("per_class", 5), SEED).filter("is_labelled"))


def _assigned(spark, d):
    return S.sample(_events(spark, d), S.SamplingPlan(labelling=S.Labelling("fraction", 0.05)), "y", SEED)


@query("SELECT 0 AS duplicates, 0 AS overlaps, 0 AS out_of_range, 0 AS labelled_outside_train, 0 AS unknown_part")
def split_violations(spark, d):
    return S.violations(_assigned(spark, d), _events(spark, d))


@query("""WITH n AS (SELECT count(*) AS n FROM events), t AS (SELECT n, CAST(round_even(0.2 * n, 0) AS BIGINT) AS test FROM n), v AS (SELECT *, CAST(round_even(0.1 * (n - test), 0) AS BIGINT) AS val FROM t)
SELECT 'test' AS part, test AS n, 0 AS n_labelled FROM v UNION ALL SELECT 'val', val, 0 FROM v UNION ALL SELECT 'train', n - test - val, CAST(round_even(0.05 * (n - test - val), 0) AS BIGINT) FROM v""")
def split_stats(spark, d):
    return S.stats(_assigned(spark, d), "y").filter("y is null").select("part", "n", "n_labelled")


@query(f"WITH t AS ({NODES}), p AS (SELECT id, y, CASE WHEN {sql_uniform(SEED, 'official', 'id')} < 0.25 THEN 'test' ELSE 'train' END AS part FROM t) SELECT part, count(*) AS n FROM p GROUP BY 1")
def official_split_kept(spark, d):
    rows = _nodes(spark, d).withColumn("official", F.when(uniform(SEED, "official", "id") < 0.25, "test").otherwise("train"))
    out = S.sample(rows, S.SamplingPlan(), "y", SEED, official="official")
    return out.groupBy(F.when(F.col("part") == "test", "test").otherwise("train").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH t AS ({NODES}), k AS (SELECT id, row_number() OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, 'label', 'id')}, id) AS k FROM t) SELECT id, true AS train_mask, false AS val_mask, false AS test_mask, k <= 5 AS labelled_mask, k > 5 AS unlabelled_mask FROM k")
def masks_from_parts(spark, d):
    rows = S.select_labelled(_nodes(spark, d), "y", S.Labelling("per_class", 5), SEED)
    return S.masks_of(rows.withColumn("part", F.lit("train")))


@query(f"WITH t AS ({NODES}), k AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_ticket(SEED, 'label', 'id')}, id) AS k FROM t) SELECT y, count(*) AS n FROM k WHERE k <= 5 GROUP BY 1")
def fit_scope_labelled(spark, d):
    rows = S.select_labelled(_nodes(spark, d), "y", S.Labelling("per_class", 5), SEED).withColumn("part", F.lit("train"))
    return S.class_counts(S.fit_scope(_nodes(spark, d), rows, "train_labeled"), "y")


def _predicted(spark, d):
    """Returns as classes; the line status, spoiled by a ticket, as a prediction."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("y"), F.col("l_linestatus").alias("g"))
    return li.withColumn("p", F.when(uniform(SEED, "spoil", "id") < 0.3, "N").otherwise(F.col("y")))


PRED = f"p0 AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS y, l_linestatus AS g FROM lineitem), p AS (SELECT id, y, g, CASE WHEN {sql_uniform(SEED, 'spoil', 'id')} < 0.3 THEN 'N' ELSE y END AS p FROM p0)"


@query(f"WITH {PRED} SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM p")
def accuracy(spark, d):
    return M.accuracy(_predicted(spark, d)).select(F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {PRED}, r AS (SELECT y, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY 1) SELECT round(avg(r), 9) AS balanced_accuracy FROM r")
def balanced_accuracy(spark, d):
    return M.balanced_accuracy(_predicted(spark, d)).select(F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


@query(f"""WITH {PRED}, t AS (SELECT g, y AS c, count(*) AS n, count(*) FILTER (WHERE y = p) AS tp FROM p GROUP BY 1, 2), q AS (SELECT g, p AS c, count(*) AS m FROM p GROUP BY 1, 2)
SELECT g, round(avg(2.0 * tp / (n + coalesce(m, 0))), 9) AS macro_f1 FROM t LEFT JOIN q USING (g, c) GROUP BY 1""")
def macro_f1(spark, d):
    return M.macro_f1(_predicted(spark, d), by=["g"]).select("g", F.round("macro_f1", 9).alias("macro_f1"))


@query(f"""WITH p AS (SELECT event_id AS id, event_type AS y, user_id % 2 = 0 AS even, CASE WHEN {sql_uniform(SEED, 'spoil', 'event_id')} < 0.3 THEN 'click' ELSE event_type END AS p FROM events)
SELECT CASE WHEN even THEN 'test' ELSE 'val' END AS part, 'accuracy' AS metric, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 9) AS value FROM p GROUP BY 1""")
def evaluate_by_part(spark, d):
    rows = _events(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id"), "id")
    rows = rows.withColumns({"part": F.when(F.col("user_id") % 2 == 0, "test").otherwise("val"), "p": F.when(uniform(SEED, "spoil", "id") < 0.3, "click").otherwise(F.col("y"))})
    out = M.evaluate_parts(rows.select("id", "p"), rows.select("id", "y", "part"), ["accuracy"], ["test", "val"])
    return out.withColumn("value", F.round("value", 9))


@query(f"WITH {PRED} SELECT p AS cls, count(*) AS n FROM p GROUP BY 1")
def prediction_counts(spark, d):
    return M.prediction_counts(_predicted(spark, d))


@query("""WITH r AS (SELECT user_id % 5 AS seed, event_type AS split, 'value' AS metric, avg(value) AS value FROM events WHERE user_id % 5 <> 3 GROUP BY 1, 2)
SELECT split, metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM r GROUP BY 1, 2""")
def sweep_aggregate(spark, d):
    runs = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("seed"), F.col("event_type").alias("split")).agg(F.avg("value").alias("value"))
    runs = runs.withColumns({"metric": F.lit("value"), "status": F.when(F.col("seed") == 3, "failed").otherwise("success")})
    return M.seed_sweep(runs).select("split", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


FIXED = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]


@query(f"SELECT vec_id AS id, label AS y, vec_id IN {tuple(FIXED)} AS is_labelled FROM embeddings")
def fixed_labels(spark, d):
    return S.fixed_labelled(_nodes(spark, d), FIXED)


@query(f"""WITH t AS (SELECT *, CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS part FROM ({NODES})), k AS (SELECT *, row_number() OVER (PARTITION BY part, y ORDER BY {sql_ticket(part_seed(SEED, 'label'), 'label', 'id')}, id) AS k FROM t)
SELECT id, y, part, part = 'train' AND k <= 4 AS is_labelled FROM k""")
def graph_sample_masks(spark, d):
    nodes = _nodes(spark, d).withColumns({"tr": F.col("id") % 3 == 0, "va": F.col("id") % 3 == 1, "te": F.col("id") % 3 == 2})
    plan = S.SamplingPlan(labelling=S.Labelling("per_class", 4))
    return S.graph_sample(nodes, plan, "y", SEED, masks={"train": "tr", "val": "va", "test": "te"})
