"""Sharding by a hierarchical weighted hash tree: a key descends region, rack and shard levels by weighted hash draws.

At each node every child draws -ln(u) / weight with u hashed from key and child; the smallest draw wins, so a child
gets keys in proportion to its weight, and a key moves only between children of a node one of whose weights changes:
movement stays within the subtrees on the way to the change. A tree grows by a region of its own (`grow`), so that the
new shard takes keys only into itself.

Nulls: a null key is a key of its own, a null text has no bytes (size 16, CRC 0). Empty tables give an empty result;
repeated rows get a shard together and slots of their own. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import buckets_for, ranked


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int, shards_per_rack: int = 5, racks_per_region: int = 2) -> list[Leaf]:
    per_region = shards_per_rack * racks_per_region
    return [Leaf(i, i // per_region, i % per_region // shards_per_rack) for i in range(shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a new region."""
    return [*leaves, Leaf(max((x.shard for x in leaves), default=-1) + 1, max((x.region for x in leaves), default=-1) + 1, 0, weight)]


def _draw(key: Column, node: str, weight: float, seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), F.lit(node), F.coalesce(key.cast("string"), F.lit("\0null")))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)
    return -F.log(u) / weight


def _pick(key: Column, path: str, children: dict, seed: int) -> Column:
    """The winning child's name among {name: weight}."""
    drawn = [F.struct(_draw(key, f"{path}/{c}", w, seed).alias("t"), F.lit(int(c)).alias("c")) for c, w in children.items() if w > 0]
    return (F.least(*drawn) if len(drawn) > 1 else drawn[0])["c"]


def shard_of(df: DataFrame, key: Column, leaves: list[Leaf], out: str, seed: int = 17) -> DataFrame:
    """Add column `out`: the shard that the key comes down to. Each level is one expression over its node's children."""
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for x in leaves:
        regions.setdefault(x.region, {}).setdefault(x.rack, {})[x.shard] = x.weight
    weight = {r: sum(sum(s.values()) for s in racks.values()) for r, racks in regions.items()}
    df = df.withColumn("_region", _pick(key, "", weight, seed))
    racks = F.lit(None).cast("int")
    for r, kids in regions.items():
        racks = F.when(F.col("_region") == r, _pick(key, f"/{r}", {k: sum(s.values()) for k, s in kids.items()}, seed)).otherwise(racks)
    df = df.withColumn("_rack", racks)
    shards = F.lit(None).cast("int")
    for r, kids in regions.items():
        for k, leaves_here in kids.items():
            shards = F.when((F.col("_region") == r) & (F.col("_rack") == k), _pick(key, f"/{r}/{k}", leaves_here, seed)).otherwise(shards)
    return df.withColumn(out, shards.cast("int")).drop("_region", "_rack")


def assign(docs: DataFrame, leaves: list[Leaf], *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """id, size, text_crc32, shard, slot (0, 1, ... within the shard) and grown_shard (with one more shard), by row."""
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    base = shard_of(base, F.col("id"), leaves, "shard", seed)
    base = shard_of(base, F.col("id"), grow(leaves), "grown_shard", seed)
    buckets = buckets_for(docs.count())
    return ranked(base, ["shard"], [F.col("id"), F.col("text_crc32"), F.col("size")], F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets))).withColumnRenamed("rank", "slot").drop("before")


def write_shards(docs: DataFrame, leaves: list[Leaf], path: str, *, id_col: str = "doc_id", seed: int = 17, files_per_shard: int = 8) -> None:
    """Write the rows themselves, a folder per shard, each in several files."""
    placed = shard_of(docs, F.col(id_col), leaves, "_shard", seed)
    salt = F.pmod(F.xxhash64(id_col), F.lit(files_per_shard))
    placed.repartition(len(leaves) * files_per_shard, "_shard", salt).write.partitionBy("_shard").parquet(path)
