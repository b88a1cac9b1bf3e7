"""Embedding near-duplicates by lattice hashing on E8.

A vector's direction is projected at random to 8 * `blocks` dimensions in each of several tables, and each 8 of them
are decoded to the nearest E8 lattice point: together they are the cell. A vector is entered in its own cell and in the
`probes` neighbouring cells it is nearest to (of the lattice's 240 shortest vectors). Entries are a key and a number;
cells with one entry are dropped, and only then do vectors travel to the cells they share. There they are verified by
their cosine in double precision. A pair that meets in several cells counts in one of them only: in the cell whose key
is the least that both have.

Equal vectors are collapsed first and count with their number. A cell with more than `TILE` vectors is cut into
tiles, and pairs of tiles are dealt to tasks. Tasks return link counts and a forest of links, never the pairs.

Tables, blocks, probes and scale are the same for any number of vectors, so that a link does not hang on how many other
rows there are: two blocks, with a recall of 0.99 of links at cosine 0.952 (simulated) and 6e-5 of all pairs as
candidates. A caller may give three blocks (`grid` names the parameters): 0.98, and 5e-6 of all pairs.

Nulls: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and name
themselves; so do vectors of another length. A null id takes part, but never names a component unless all its ids
are null. Empty tables give an empty result; repeated rows link with each other. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few, stored
from tessera.llm.graph import components
from tessera.llm.simhash import _unite

TILE = 512
#: Partners of a row up to which they are gathered pair by pair, and pairs at a time.
FEW, AT_ONCE = 24, 1 << 14
#: Cosines of a product of blocks that are as near to the threshold are taken again pair by pair, so that a link does not hang on the size of its cell.
EDGE = 1e-9


def grid(n: int) -> tuple[int, int, int, float]:
    """tables, blocks, probes, scale that a caller may give for n vectors: above ten million, cells of three blocks keep candidates few. Nothing chooses by it."""
    return (6, 2, 3, 0.65) if n <= 10_000_000 else (8, 3, 4, 0.55)


def shortest_vectors() -> np.ndarray:
    """The 240 lattice points next to zero."""
    whole = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array(whole + half, float)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum: round, and where the sum is odd, round the worst place the other way."""
    f = np.rint(x)
    odd = np.nonzero(f.sum(1) % 2)[0]
    off = x[odd] - f[odd]
    worst = np.abs(off).argmax(1)
    f[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: E8 is D8 together with D8 shifted by one half."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _hashed(points: np.ndarray, salt: int) -> np.ndarray:
    """A 63-bit key of rows of half-integers."""
    h = np.full(len(points), salt, np.uint64)
    for c in range(points.shape[1]):
        h = (h ^ (2 * points[:, c]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).astype(np.int64)


def cell_keys(unit: np.ndarray, tables: int, blocks: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Sorted keys of the cells of each row: for each table its own cell and the nearest neighbours."""
    near, out, n = shortest_vectors(), [], np.arange(len(unit))
    salt = unit.shape[1] << 32  # vectors of another length have cells of their own
    for t in range(tables):
        rng = np.random.default_rng([seed, t, unit.shape[1]])
        y = unit @ rng.normal(size=(unit.shape[1], 8 * blocks)) * scale
        home = np.concatenate([decode(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        out.append(_hashed(home, salt + t))
        gain = np.concatenate([(y - home)[:, 8 * b : 8 * b + 8] @ near.T for b in range(blocks)], axis=1)
        best = np.argpartition(-gain, probes, axis=1)[:, :probes]
        for p in range(probes):
            cell = home.copy()
            block, move = best[:, p] // len(near), near[best[:, p] % len(near)]
            for k in range(8):
                cell[n, 8 * block + k] += move[:, k]
            out.append(_hashed(cell, salt + t))
    return np.sort(np.stack(out, axis=1), axis=1)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of the lists, where each list starts among them, and its length."""
    lengths = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]), lengths


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _digest(c: str) -> list:
    """128 bits by which rows find their vector again."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), F.col(c))]


def _pairs(begin: np.ndarray, end: np.ndarray, unit: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with a cosine of `least` or more, j from begin[i] to end[i] - 1: few partners by gathering rows, many by products of blocks."""
    n = np.maximum(end - begin, 0)
    many = n > FEW
    rows = np.nonzero(~many & (n > 0))[0]
    ends = np.cumsum(n[rows])
    for at in range(0, int(ends[-1]) if len(rows) else 0, AT_ONCE):
        flat = np.arange(at, min(at + AT_ONCE, int(ends[-1])))
        k = np.searchsorted(ends, flat, side="right")
        i = rows[k]
        j = begin[i] + flat - (ends[k] - n[i])
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
        yield i[near], j[near]
    rows = np.nonzero(many)[0]
    for part in np.split(rows, np.nonzero((np.diff(rows) != 1) | (np.diff(end[rows]) != 0))[0] + 1) if len(rows) else []:
        for at in range(0, len(part), 256):  # rows of one cell, one after another
            i = part[at : at + 256]
            low = int(begin[i].min())
            cosine = unit[i] @ unit[low : int(end[i[0]])].T
            a, b = np.nonzero(cosine >= least - EDGE)
            i, j, cosine = i[a], b + low, cosine[a, b]
            sure = cosine >= least + EDGE
            for k in np.split(np.nonzero(~sure)[0], range(AT_ONCE, np.count_nonzero(~sure), AT_ONCE)):  # as few partners would be
                sure[k] = np.einsum("ij,ij->i", unit[i[k]], unit[j[k]]) >= least
            i, j = i[sure & (j >= begin[i])], j[sure & (j >= begin[i])]
            for k in range(0, len(i), 4096):
                yield i[k : k + 4096], j[k : k + 4096]


def near_links(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, tables: int = 6, blocks: int = 2, probes: int = 3, scale: float = 0.65, seed: int = 11) -> DataFrame:
    """(id, n_links, component) of each row: links at cosine `least` or more, and the least id they lead to."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    kind = "float" if vectors.select(v.alias("v")).dtypes[0][1] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(good, F.lit(False)), F.transform(v, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))).alias("v"))
    distinct = rows.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")  # once written, the numbers stay

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, starts, lengths = _flat(b.column(2))
            for d in np.unique(lengths):
                at = np.nonzero(lengths == d)[0]
                keys = cell_keys(_unit(flat[starts[at][:, None] + np.arange(d)[None, :]]), tables, blocks, probes, scale, seed)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at)) for k in range(3)], listed], ["node", "weight", "v", "keys"])

    cells = stored(distinct.select("node", "weight", "v").mapInArrow(entered, f"node long, weight long, v array<{kind}>, keys array<long>"), "cells")
    keyed = cells.select(F.explode("keys").alias("key"), F.col("node").alias("n"))
    shared = keyed.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k", F.ceil(F.col("c") / TILE).cast("int").alias("tiles"))
    met = stored(keyed.join(shared, F.col("key") == F.col("k")).select("key", "n", "tiles"), "shared-cells")
    tiled = cells.join(few(met), F.col("node") == F.col("n")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "weight", "keys", "v")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            lengths = pc.list_value_length(rows.column("v")).to_numpy()
            for d in np.unique(lengths):  # cells of several lengths only where keys happen to be equal
                if (out := links_of(rows.filter(pa.array(lengths == d)) if (lengths != d).any() else rows)) is not None:
                    yield out

        def links_of(rows: pa.Table) -> pa.RecordBatch | None:
            """All cells of the rows at once; each pair counts in its least cell only."""
            col = lambda k: rows.column(k).to_numpy()
            listed = lambda k: _flat(rows.column(k).combine_chunks())[0].reshape(rows.num_rows, -1)
            node, weight, keys, unit = col("node"), col("weight"), listed("keys"), _unit(listed("v"))
            key, low, high, tile = (col(k).astype(np.int64) for k in ("key", "low", "high", "tile"))
            place, count = np.arange(len(node)), np.zeros(len(node), np.int64)
            cell = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))])
            half = 2 * cell + (tile != low)  # of two tiles, each row of the first meets all of the second
            end = np.searchsorted(cell, cell, side="right")
            begin = np.where(low == high, place + 1, np.where(half % 2 == 0, np.searchsorted(half, 2 * cell + 1), end))
            parent = place.copy()
            for i, j in _pairs(begin, end, unit, least):
                lower = keys[i] < key[i][:, None]
                first = ~((keys[i][:, :, None] == keys[j][:, None, :]).any(2) & lower).any(1)
                i, j = i[first], j[first]
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                parent = _unite(parent, i, j)
            at = np.nonzero(count)[0]
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(count[at]), pa.array(node[parent[at]])], ["node", "n", "root"]) if len(at) else None

        rest: pa.Table | None = None
        for b in batches:
            now = pa.Table.from_batches([b])
            now = now if rest is None else pa.concat_tables([rest, now])
            marks = np.stack([now.column(k).to_numpy() for k in ("key", "low", "high")], axis=1)
            differs = (marks != marks[-1]).any(1) if len(marks) else np.zeros(0, bool)
            cut = int(np.nonzero(differs)[0][-1]) + 1 if differs.any() else 0  # the last cell may go on
            if cut:
                yield from cells_of(now.slice(0, cut).combine_chunks())
            rest = now.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from cells_of(rest)

    dealt = tiled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "tile", "node")
    found = stored(dealt.mapInArrow(verified, "node long, n long, root long"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = (
        distinct.select("node", "v", "weight", "least")
        .join(counts.withColumnRenamed("node", "_c"), F.col("node") == F.col("_c"), "left")
        .join(roots.select(F.col("node").alias("_r"), "root"), F.col("node") == F.col("_r"), "left")
        .select("v", "weight", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    )
    named = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(named, "root").select(*[x.alias(f"_{k}") for k, x in enumerate(_digest("v"))], (F.col("n") + F.col("weight") - 1).alias("n_links"), "component")
    rows = rows.select("id", F.col("v").isNull().alias("none"), *[x.alias(f"d{k}") for k, x in enumerate(_digest("v"))])
    met = rows.join(known, ~F.col("none") & (F.col("d0") == F.col("_0")) & (F.col("d1") == F.col("_1")), "left")
    return met.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("none"), F.col("id")).otherwise(F.col("component")).alias("component"))
