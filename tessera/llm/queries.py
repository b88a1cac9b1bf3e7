"""The queries of this subpackage, by name; SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, lattice, license_scan, mixing, packing, pii, quality, secret_scan, sharding, simhash
from tessera.llm.common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weight_of=mixing.cycle_521)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", *[F.get("passes", k)["slot"].alias(f"{w}_slot") for k, w in enumerate(("first", "second"))])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(r.name) for r in secret_scan.RULES])
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["ord"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["ord"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda x: x["ord"] < 3)), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
    )


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), sharding.tree(40))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs.select("doc_id", "text"), language.trained(docs))
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"], F.round(m["coverage"], 3)))
    return out.select(F.col("id").alias("doc_id"), F.size("matches").cast("long").alias("n_matches"), F.array_join(shown, ",").alias("matches"))


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(table(spark, sf_dir, "documents"), word_tokenizer(), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: Whoever runs this on real data passes a secret.
DEMO_KEY = "not-a-secret"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", "text", *[f"n_{k}" for k in pii.KINDS])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=64, radius=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lattice.near_links(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "n_bad_votes")


QUERIES = {
    "op1_mix": op1_mix,
    "op2_secrets": op2_secrets,
    "op3_shard": op3_shard,
    "op4_language": op4_language,
    "op5_license": op5_license,
    "op6_pack": op6_pack,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_lattice": op9_lattice,
    "op10_quality": op10_quality,
}
#: By brute force, where that is SQL. The others rest on hashes, automata, tokenizers or fitted models that SQL has not; tests/llm holds them against brute force in Python.
ORACLES: dict[str, str] = {
    "op9_lattice": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS MATERIALIZED (SELECT *, sqrt(list_dot_product(x, x)) AS r FROM v),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.r * b.r) >= 0.95),
w(id, o) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.id, p.b FROM w JOIN p ON p.a = w.o), c AS (SELECT id, min(o) AS component_id FROM w GROUP BY 1), l AS (SELECT a, count(*) AS k FROM p GROUP BY 1)
SELECT id AS vec_id, coalesce(k, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN l ON l.a = c.id""",
}
