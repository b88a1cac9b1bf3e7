"""SURVEY 2.1 (filters), 2.4, 2.5 and 2.9 on the driver's tables."""

from pyspark.sql import functions as F

from tessera.functions.seeds import sql_ticket, sql_uniform, ticket
from tessera.operators import augment as A
from tessera.operators import features as X
from tessera.operators import views as V
from tessera.queries import query, table

SEED = 7


@query(f"SELECT id, y FROM (SELECT vec_id AS id, label AS y FROM embeddings WHERE label IN (1, 3)) ORDER BY {sql_ticket(SEED, 'limit', 'id')}, id LIMIT 40")
def class_filter_limit(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y")).filter(F.col("y").isin(1, 3))
    return rows.orderBy(ticket(SEED, "limit", "id"), "id").limit(40)


@query("SELECT event_id AS id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS y FROM events")
def labels_encode(spark, d):
    return X.encode_labels(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("y")))


@query("""WITH s AS (SELECT doc_id AS id, source IN ('src1', 'src2', 'src3') AS test, CASE WHEN source IN ('src1', 'src2', 'src3') AND lang = 'en' THEN 'fr' ELSE lang END AS y FROM documents)
SELECT id, CAST(dense_rank() OVER (PARTITION BY test ORDER BY y) - 1 AS INTEGER) AS y FROM s""")
def labels_encode_per_split(spark, d):
    test = F.col("source").isin("src1", "src2", "src3")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), test.alias("test"), F.when(test & (F.col("lang") == "en"), "fr").otherwise(F.col("lang")).alias("y"))
    return X.encode_labels(rows, "y", split="test").select("id", "y")


@query("SELECT vec_id AS id, [CASE WHEN label = c THEN 1 ELSE 0 END FOR c IN range(10)] AS onehot, true AS is_labelled FROM embeddings")
def labels_onehot(spark, d):
    return X.onehot_labels(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"))).select("id", "onehot", "is_labelled")


@query("""WITH c AS (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS cs FROM customer)
SELECT c_custkey AS id, round(c_acctbal, 4) AS v, [CASE WHEN c_mktsegment = k THEN 1.0 ELSE 0.0 END FOR k IN cs] AS flags FROM customer, c""")
def one_hot_mktsegment(spark, d):
    rows = table(spark, d, "customer")
    got = X.fit_onehot(rows, ["c_mktsegment", "c_acctbal"]).apply(rows)
    return got.select(F.col("c_custkey").alias("id"), F.round(F.col("x")[0], 4).alias("v"), F.slice("x", 2, 100).alias("flags"))


@query("SELECT p_partkey AS id, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS a, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS b FROM part")
def standard_scale(spark, d):
    rows = X.ensure_2d(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return X.fit_scaler(rows).apply(rows).select(F.col("p_partkey").alias("id"), F.round(F.col("x")[0], 6).alias("a"), F.round(F.col("x")[1], 6).alias("b"))


def _holes(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"))
    return rows


HOLES = "h AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders)"


@query(f"WITH {HOLES} SELECT id, round(coalesce(v, avg(v) OVER ()), 4) AS v, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS v_missing FROM h")
def impute_mean(spark, d):
    rows = _holes(spark, d)
    return X.fit_imputer(rows, ["v"], "mean", indicators=True).apply(rows).withColumn("v", F.round("v", 4))


@query(f"WITH {HOLES} SELECT id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM h)), 4) AS v FROM h")
def impute_median(spark, d):
    rows = _holes(spark, d)
    return X.fit_imputer(rows, ["v"], "median").apply(rows).withColumn("v", F.round("v", 4))


@query("WITH h AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS v FROM part), m AS (SELECT v FROM h WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) SELECT id, coalesce(h.v, m.v) AS v FROM h, m")
def impute_most_frequent(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("v"))
    return X.fit_imputer(rows, ["v"], "most_frequent").apply(rows)


@query("SELECT vec_id AS id, len(embedding) AS n, round(list_sum([CAST(v AS DOUBLE) FOR v IN embedding]), 6) AS s FROM embeddings")
def cast_float(spark, d):
    rows = X.cast_vector(table(spark, d, "embeddings"), "embedding", "float64")
    return rows.select(F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v), 6).alias("s"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, [l_quantity, l_extendedprice, CAST(l_linenumber AS DOUBLE)] AS x FROM lineitem")
def ensure_2d(spark, d):
    rows = X.ensure_2d(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"])
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "x")


W = r"list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT doc_id AS id, list_slice({W}, 1, 64) AS w FROM documents), i AS (SELECT id, [CAST('0x' || substr(md5(v), 1, 8) AS BIGINT) % 29998 + 2 FOR v IN w] AS k FROM t)
SELECT id, list_resize(k, 64, 0) AS input_ids, list_resize([CAST(1 AS TINYINT) FOR v IN k], 64, CAST(0 AS TINYINT)) AS attention_mask FROM i""")
def hash_tokenize(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return X.hash_tokenized(rows, "text", 64).select("id", "input_ids", "attention_mask")


VOCABULARY = 30_000
VOC = f"t AS (SELECT doc_id AS id, unnest({W}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY 1), v AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM c ORDER BY n DESC, token LIMIT {VOCABULARY - 2})"


@query(f"WITH {VOC} SELECT token, n, token_id FROM v")
def vocab_build(spark, d):
    return X.fit_vocabulary(table(spark, d, "documents"), "text", VOCABULARY)


@query(f"WITH {VOC}, s AS (SELECT doc_id AS id, list_slice({W}, 1, 256) AS w FROM documents), e AS (SELECT id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM s), g AS (SELECT id, list(coalesce(token_id, 1) ORDER BY pos) AS k FROM e LEFT JOIN v USING (token) GROUP BY 1) SELECT id, list_resize(k, 256, 0) AS input_ids FROM g")
def vocab_tokenize(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return X.vocabulary_tokenized(rows, "text", X.fit_vocabulary(rows, "text", VOCABULARY), 256).select("id", "input_ids")


@query(r"""WITH t AS (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), lambda w: length(w) >= 2)) AS term FROM documents), f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents), i AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM f, n GROUP BY term, n HAVING count(*) >= 3), w AS (SELECT id, term, tf * idf AS w FROM f JOIN i USING (term))
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""")
def tfidf_weights(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return X.tfidf(rows, "text", X.fit_idf(rows, "text", min_df=3)).withColumn("weight", F.round("weight", 6))


@query("SELECT item_id AS id, lower(text) AS text FROM benchmark")
def text_lower(spark, d):
    return A.augmented(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "text", [("text.lowercase", {})], SEED)


def _u(op, k, epoch, *parts):
    return sql_uniform(SEED, f"{k}:{op}/{epoch}", *parts)


@query(f"WITH w AS (SELECT item_id AS id, list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda w: w <> '') AS w FROM benchmark), e AS (SELECT id, unnest(w) AS t, unnest(range(len(w))) AS i FROM w) SELECT id, string_agg(t, ' ' ORDER BY i) AS text FROM e WHERE {_u('text.word_dropout', 0, 0, 'id', 'i')} >= 0.1 GROUP BY 1")
def word_dropout(spark, d):
    return A.augmented(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "text", [("text.word_dropout", {})], SEED)


@query(f"WITH t AS (SELECT doc_id AS id, list_slice({W}, 1, 64) AS w FROM documents), e AS (SELECT id, unnest(list_resize([CAST('0x' || substr(md5(v), 1, 8) AS BIGINT) % 29998 + 2 FOR v IN w], 64, 0)) AS k, unnest(range(64)) AS i FROM t) SELECT id, list(CASE WHEN k <> 0 AND {_u('text.token_mask', 0, 0, 'id', 'i')} < 0.1 THEN 1 ELSE k END ORDER BY i) AS input_ids FROM e GROUP BY 1")
def token_mask(spark, d):
    rows = X.hash_tokenized(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text", 64)
    return A.augmented(rows, "input_ids", [("text.token_mask", {})], SEED).select("id", "input_ids")


@query(f"WITH e AS (SELECT vec_id AS id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) SELECT id, round(sum(CASE WHEN {_u('tabular.feature_dropout', 0, 0, 'id', 'i')} < 0.1 THEN 0.0 ELSE CAST(v AS DOUBLE) END), 6) AS s FROM e GROUP BY 1")
def feature_dropout(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    got = A.augmented(rows, "x", [("tabular.feature_dropout", {})], SEED)
    return got.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("s"))


def _n(op, k, epoch, *parts):
    u, v = sql_uniform(SEED, f"{k}:{op}/{epoch}/r", *parts), sql_uniform(SEED, f"{k}:{op}/{epoch}/a", *parts)
    return f"sqrt(-2 * ln({u} + {2.0**-33!r})) * cos(2 * pi() * {v})"


@query(f"WITH e AS (SELECT vec_id AS id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) SELECT id, round(sum(CAST(v AS DOUBLE) + 0.1 * {_n('tabular.gaussian_noise', 0, 0, 'id', 'i')}), 5) AS s FROM e GROUP BY 1")
def gaussian_noise(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    got = A.augmented(rows, "x", [("tabular.gaussian_noise", {})], SEED)
    return got.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("s"))


@query(f"SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE {sql_uniform(SEED, 'edge_dropout/0', 'o_custkey', 'o_orderkey')} >= 0.2")
def edge_dropout(spark, d):
    return A.edge_dropout(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), SEED)


def _view(spark, d, views):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return V.with_views(rows, V.resolve(views, 64, SEED))


#: The draw itself, in SQL: half of the slots, by least uniform.
HALF = f"s AS (SELECT i, row_number() OVER (ORDER BY {sql_uniform(V.view_seed(SEED, 'view_a'), 'view', 'i')}, i) <= 32 AS mine FROM (SELECT unnest(range(64)) AS i))"


@query("SELECT vec_id AS id, [embedding[1], embedding[6], embedding[64]] AS a, embedding AS b FROM embeddings")
def view_indices(spark, d):
    return _view(spark, d, [V.View("a", "indices", [5, 0, 63]), V.View("b")]).select("id", "a", "b")


@query(f"WITH {HALF} SELECT vec_id AS id, list(embedding[i + 1] ORDER BY i) AS view_a FROM embeddings, s WHERE mine GROUP BY 1")
def view_random(spark, d):
    return _view(spark, d, V.two_views()).select("id", "view_a")


@query(f"WITH {HALF} SELECT vec_id AS id, list(embedding[i + 1] ORDER BY i) AS view_b FROM embeddings, s WHERE NOT mine GROUP BY 1")
def view_complement(spark, d):
    return _view(spark, d, V.two_views()).select("id", "view_b")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def _moments(rows, digits):
    """(i, j, v): covariances of the columns, i <= j."""
    one = rows.select("id", F.posexplode("x").alias("i", "a"))
    met = one.join(one.select("id", F.col("i").alias("j"), F.col("a").alias("b")), "id").filter("i <= j")
    return met.groupBy("i", "j").agg((F.round(F.covar_pop("a", "b"), digits) + F.lit(0.0)).alias("v"))


@query("""WITH e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), c AS (SELECT id, v - avg(v) OVER (PARTITION BY i) AS v FROM e), n AS (SELECT id, sum(v * v) AS v FROM c GROUP BY 1)
SELECT 'length' AS kind, id, NULL::INTEGER AS i, NULL::INTEGER AS j, round(v, 6) AS v FROM n UNION ALL SELECT 'covariance', NULL, a.i, b.i, 0.0 FROM (SELECT unnest(range(64))::INTEGER AS i) a JOIN (SELECT unnest(range(64))::INTEGER AS i) b ON a.i < b.i""")
def pca(spark, d):
    """All directions: lengths from the mean stay, and the new columns are not correlated."""
    rows = _vectors(spark, d)
    got = X.fit_pca(rows, 64).apply(rows)
    lengths = got.select(F.lit("length").alias("kind"), "id", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v), 6).alias("v"))
    return lengths.unionByName(_moments(got, 9).filter("i < j").select(F.lit("covariance").alias("kind"), F.lit(None).cast("long").alias("id"), "i", "j", "v"))


@query("""WITH e AS MATERIALIZED (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), c AS (SELECT id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM e)
SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END AS v FROM (SELECT unnest(range(64)) AS i) a JOIN (SELECT unnest(range(64)) AS i) b ON a.i <= b.i""")
def zca_whitening(spark, d):
    """The whitened columns have variance 1 and are not correlated (the floor on the variances aside)."""
    rows = _vectors(spark, d)
    return _moments(X.fit_whitening(rows, 1e-9).apply(rows), 5)


@query(f"""WITH e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), m AS (SELECT i, j, sqrt(-2 * ln({sql_uniform(SEED, 'projection/r', 'i', 'j')} + {2.0**-33!r})) * cos(2 * pi() * {sql_uniform(SEED, 'projection/a', 'i', 'j')}) / sqrt(8) AS w FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(8)) AS j))
SELECT id, j::INTEGER AS c, round(sum(v * w), 6) AS f FROM e JOIN m USING (i) GROUP BY 1, 2""")
def random_projection(spark, d):
    rows = _vectors(spark, d)
    got = X.random_projection(rows, 8, SEED).apply(rows)
    return got.select("id", F.posexplode("x").alias("c", "f")).select("id", "c", F.round("f", 6).alias("f"))


@query(f"WITH e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) SELECT id, round(sum(CASE WHEN {_u('tabular.swap_noise', 0, 0, 'id', 'i')} < 0.15 THEN {_n('tabular.swap_noise', 0, 0, 'id', 'i + 100000')} ELSE v END), 5) AS s FROM e GROUP BY 1")
def swap_noise(spark, d):
    got = A.augmented(_vectors(spark, d), "x", [("tabular.swap_noise", {})], SEED)
    return got.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("s"))


def _u1(op, part):
    return sql_uniform(SEED, f"0:{op}/0", "id", f"'{part}'")


SWAP = "[CASE WHEN k = a THEN w[b + 1] WHEN k = b THEN w[a + 1] ELSE w[k + 1] END FOR k IN range(len(w))]"


@query(f"WITH t AS (SELECT item_id AS id, text, list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda w: w <> '') AS w FROM benchmark), p AS (SELECT *, CAST(floor({_u1('text.random_swap', 'a0')} * len(w)) AS BIGINT) AS a, CAST(floor({_u1('text.random_swap', 'b0')} * len(w)) AS BIGINT) AS b FROM t) SELECT id, CASE WHEN len(w) < 2 THEN text ELSE array_to_string({SWAP}, ' ') END AS text FROM p")
def random_swap(spark, d):
    return A.augmented(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "text", [("text.random_swap", {})], SEED)


@query(f"""WITH t AS (SELECT doc_id AS id, list_slice({W}, 1, 64) AS w0 FROM documents), k AS (SELECT id, len(w0) AS m, list_resize([CAST('0x' || substr(md5(v), 1, 8) AS BIGINT) % 29998 + 2 FOR v IN w0], 64, 0) AS w FROM t),
p AS (SELECT *, CAST(floor({_u1('text.token_swap', 'a0')} * m) AS BIGINT) AS a, CAST(floor({_u1('text.token_swap', 'b0')} * (m - 1)) AS BIGINT) AS s FROM k), q AS (SELECT id, m, w, a, (a + 1 + s) % greatest(m, 1) AS b FROM p) SELECT id, CASE WHEN m >= 2 THEN {SWAP} ELSE w END AS input_ids FROM q""")
def token_swap(spark, d):
    rows = X.hash_tokenized(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text", 64)
    return A.augmented(rows, "input_ids", [("text.token_swap", {})], SEED).select("id", "input_ids")


@query(f"WITH t AS (SELECT id, embedding AS x, (CAST(floor((2 * {_u1('audio.time_shift', 'shift')} - 1) * 0.1 * 64) AS BIGINT) + 64) % 64 AS turn FROM (SELECT vec_id AS id, embedding FROM embeddings)) SELECT id, [x[(k - turn + 64) % 64 + 1] FOR k IN range(64)] AS x FROM t")
def time_shift(spark, d):
    return A.augmented(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), "x", [("audio.time_shift", {})], SEED)
