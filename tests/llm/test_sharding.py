import math
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from tessera.llm import sharding
from tests.llm.helpers import documents, frame


def test_slots_sizes_and_growth(spark):
    got = sharding.assign(frame(spark), sharding.tree(40)).toPandas()
    rows = documents()
    assert len(got) == len(rows)
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted(zip(got["id"].fillna(-1).astype(int), got["size"], got["text_crc32"], strict=True)) == want
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) <= {40}
    assert got.groupby(got["id"].fillna(-1))["shard"].nunique().max() == 1
    assert sharding.assign(frame(spark, []), sharding.tree(40)).count() == 0


def test_balance_and_movement_stay_in_the_changed_subtree(spark):
    keys = spark.range(40_000)
    leaves = sharding.tree(40)
    heavier = [sharding.Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 12 else 1.0) for x in leaves]
    both = sharding.shard_of(sharding.shard_of(keys, F.col("id"), leaves, "a"), F.col("id"), heavier, "b").toPandas()
    counts = both["a"].value_counts()
    assert len(counts) == 40 and 800 < counts.min() and counts.max() < 1200
    moved = both[both["a"] != both["b"]]
    assert (moved["b"] // 10 == 1).all()  # into the region of shard 12 only
    within = moved[moved["a"] // 10 == 1]
    assert (within["b"] // 5 == 2).all()  # within the region, into its rack only
    assert (within[within["a"] // 5 == 2]["b"] == 12).all()  # within the rack, to the shard itself


def test_files(spark, tmp_path):
    df = frame(spark)
    sharding.write_shards(df, sharding.tree(4), str(tmp_path / "out"), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()


def drawn(key, leaves, seed=17):
    """The descent for one key: at each node the child with the least exponential draw, by its weight."""
    text = "\0null" if key is None else str(key)

    def pick(path, children):
        def time(child):
            h = 42
            for part in (struct.pack("<i", seed), f"{path}/{child}".encode(), text.encode()):
                h = xxhash.xxh64_intdigest(part, h)
            return -math.log(((h >> 11) + 0.5) / 2**53) / sum(x.weight for x in children[child])

        return min(children, key=lambda c: (time(c), c))

    path, here = "", leaves
    for level in ("region", "rack", "shard"):
        children = {}
        for x in here:
            children.setdefault(getattr(x, level), []).append(x)
        best = pick(path, children)
        path, here = f"{path}/{best}", children[best]
    return here[0].shard


def test_draws_as_by_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "x"), (-5, None)], "doc_id long, text string"))
    leaves = [sharding.Leaf(x.shard, x.region, x.rack, 1.0 + x.shard % 3) for x in sharding.tree(40)]
    for tree in (sharding.tree(40), leaves):
        got = sharding.assign(docs, tree).collect()
        assert len(got) == docs.count()
        assert all(r["shard"] == drawn(r["id"], tree) and r["grown_shard"] == drawn(r["id"], sharding.grow(tree)) for r in got)
