"""SimHash near-duplicates: banded candidates, compared bit-sliced.

A document's fingerprint has a bit for each hash bit that is set in over half its shingles. Distinct fingerprints are
dealt to bands (sets of bit positions); those with equal bits in a band meet. There the bit planes are stored
vertically, 64 fingerprints to a machine word, and each fingerprint is compared to whole words at once: planes that
differ are summed in carry-save bitwise counters, and a word is abandoned once all its lanes exceed the radius.
Each run of equal keys gives a forest of its links, never all pairs; components come from the forests.

`exact_bands` loses no pair: the bits are cut into radius + 3 blocks, and two fingerprints that differ in `radius`
bits agree in three blocks at least. For radii for which that is out of reach (`deduplicated`), documents meet by bands
of least hashes of their shingles instead, and links are verified on the shingles.

Nulls: a null or wordless text has fingerprint zero and is linked like any other; a null id takes part, but never
names a component unless all ids of it are null (then null). Empty tables give an empty result; repeated rows share
a fingerprint and stay separate rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tessera.llm.common import few, forget, let_go, numbered, stored, trim
from tessera.llm.graph import components

SEED = 42
#: Pairs of a fingerprint and a word of 64 others that are compared at a time, and planes between two looks for dead words.
PAIRS, STEP = 1 << 15, 8
#: Shingles whose bits are counted, and texts that are read, at a time.
SHINGLES, AT_ONCE = 4096, 1024
#: Fingerprints of one key above which they are cut into tiles.
TILE = 1 << 9


def exact_bands(bits: int, radius: int) -> list[list[int]]:
    """Bit positions of each band: every three of radius + 3 equal blocks."""
    blocks = [list(map(int, x)) for x in np.array_split(np.arange(bits), radius + 3)]
    return [a + b + c for a, b, c in combinations(blocks, 3)]


def shingle_hashes(text: bytes | None, shingle: int) -> list[int]:
    """XXH64 of each run of `shingle` words, lower-cased in A-Z; fewer words: of all of them; none: nothing."""
    words = (text or b"").lower().split()
    if not words:
        return []
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [h(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    return [h(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: list[int], bits: int = 64) -> bytes:
    """Big-endian bytes. Bits beyond the first 64 come from further mixes of the same hashes."""
    count, n = np.zeros(bits, np.int64), len(hashes)
    for at in range(0, n, SHINGLES):
        h = np.array(hashes[at : at + SHINGLES], np.uint64)
        if bits > 64:
            h = _mix(h[:, None] + np.arange(bits // 64, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
        count += np.unpackbits(h.reshape(len(h), -1).astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * count > n).tobytes()


def fingerprints(docs: DataFrame, *, shingle: int, bits: int = 64, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row; distinct: each shingle of a text counts once."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), shingle)
                fps.append(fingerprint(list(set(h)) if distinct else h, bits))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["id", "fp"])

    return base.mapInArrow(made, StructType([base.schema["id"], StructField("fp", BinaryType())]))


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: the sum and the carry of three bits in each lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _exceeds(c: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    gt, eq = over.copy(), ~over
    for j in reversed(range(len(c))):
        if radius >> j & 1:
            eq &= c[j]
        else:
            gt |= eq & c[j]
            eq &= ~c[j]
    return gt


def _near(planes: np.ndarray, bits: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, lanes within the radius) for pairs of a query (a row of bits) and a word of 64 rows (by plane)."""
    depth = max(3, int(radius).bit_length())
    none = np.zeros(len(query), np.uint64)
    c, over = [none.copy() for _ in range(depth)], none.copy()
    for p in range(0, planes.shape[1], STEP):
        x = [planes[word, p + k] ^ (np.uint64(0) - bits[query, p + k].astype(np.uint64)) for k in range(STEP)]
        twos, fours = [], []
        for k in range(0, STEP, 2):
            c[0], t = _csa(c[0], x[k], x[k + 1])
            twos.append(t)
        for k in (0, 2):
            c[1], f = _csa(c[1], twos[k], twos[k + 1])
            fours.append(f)
        c[2], carry = _csa(c[2], fours[0], fours[1])
        for j in range(3, depth):
            c[j], carry = c[j] ^ carry, c[j] & carry
        over |= carry
        dead = (~_exceeds(c, over, radius) & lanes) == 0
        if dead.any():
            live = ~dead
            query, word, lanes, over, c = query[live], word[live], lanes[live], over[live], [v[live] for v in c]
            if not len(query):
                break
    return query, word, ~_exceeds(c, over, radius) & lanes


def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union by least index of all links (a, b)."""
    while len(a):
        parent = _root(parent)
        a, b = parent[a], parent[b]
        differ = a != b
        a, b = a[differ], b[differ]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    return _root(parent)


def run_forest(fps: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int) -> np.ndarray:
    """The least row to which links lead; row i (fps: bytes) is compared to the rows begin[i] to end[i] - 1, all after it.

    A word of 64 rows that are all of the row's class already is passed over: a group of copies costs one comparison each.
    """
    n = len(fps)
    bits = np.unpackbits(fps, axis=1)
    padded = np.concatenate([bits, np.zeros((-n % 64, bits.shape[1]), np.uint8)])
    planes = np.ascontiguousarray(np.packbits(padded.reshape(-1, 64, bits.shape[1]), axis=1, bitorder="little").transpose(0, 2, 1)).view("<u8")[:, :, 0]
    first, last = begin >> 6, (end - 1) >> 6
    words = np.where(end > begin, last - first + 1, 0)
    ends, parent, ones = np.cumsum(words), np.arange(n), np.uint64(0xFFFFFFFFFFFFFFFF)
    held = np.arange(-n % 64 + n)
    lowest, highest = held.reshape(-1, 64).min(1), held.reshape(-1, 64).max(1)
    for at in range(0, int(ends[-1]) if n else 0, PAIRS):
        flat = np.arange(at, min(at + PAIRS, int(ends[-1])))
        query = np.searchsorted(ends, flat, side="right")
        word = first[query] + flat - (ends[query] - words[query])
        new = (lowest[word] != parent[query]) | (highest[word] != parent[query])
        query, word = query[new], word[new]
        low, high = np.maximum(begin[query] - 64 * word, 0), np.minimum(end[query] - 64 * word, 64)
        lanes = (ones << low.astype(np.uint64)) & (ones >> (64 - high).astype(np.uint64))
        query, word, lanes = _near(planes, bits, query, word, lanes, radius)
        hit = lanes != 0
        if hit.any():
            found = np.unpackbits(lanes[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(found)
            parent = _unite(parent, query[hit][k], 64 * word[hit][k] + lane)
            held[:n] = parent
            lowest, highest = held.reshape(-1, 64).min(1), held.reshape(-1, 64).max(1)
    return parent


def banded(unique: DataFrame, bands: list[list[int]]) -> DataFrame:
    """(key, c): a key for each band of each fingerprint (columns c, its number, and fp)."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(1).to_pylist()
            if not fps:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)
            for k, band in enumerate(bands):
                key = bits[:, band].astype(np.int64) @ (1 << np.arange(len(band), dtype=np.int64)) + (k << 48)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0)], ["key", "c"])

    return unique.select("c", "fp").mapInArrow(dealt, "key long, c long")


def _tiles(n: Column) -> Column:
    """As many tiles as keep both a tile and the copies of a row few: each row goes to all tiles."""
    return F.when(n > TILE, F.ceil(F.sqrt(n / 64))).otherwise(1).cast("int")


def links(keyed: DataFrame, unique: DataFrame, radius: int) -> DataFrame:
    """A forest (u, v) of the links among the numbers (c) that share a key; unique has the fingerprint (fp) of each number.

    Keys that only one number has are dropped before fingerprints travel. A key with more than TILE numbers is cut into
    tiles, and pairs of tiles are dealt to tasks.
    """
    shared = keyed.groupBy(F.col("key").alias("k")).agg(_tiles(F.count(F.lit(1))).alias("tiles"), F.min("c").alias("a"), F.max("c").alias("z")).filter("a <> z")
    met = keyed.join(shared.select("k", "tiles"), F.col("key") == F.col("k")).select("key", "c", "tiles")
    met = met.join(unique.select(F.col("c").alias("u"), "fp"), F.col("c") == F.col("u"))
    met = met.withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = met.select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "c", "fp")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(rows: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            """rows: key, low, high, tile, c."""
            run = np.zeros(len(rows), np.int64)
            run[1:] = np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(1))
            end, place = np.searchsorted(run, run, side="right"), np.arange(len(run))
            half = 2 * run + (rows[:, 3] != rows[:, 1])  # of two tiles, each row of the first meets all of the second
            begin = np.where(rows[:, 1] == rows[:, 2], place + 1, np.where(half % 2 == 0, np.searchsorted(half, 2 * run + 1), end))
            root = run_forest(fps, begin, end, radius)
            up = np.nonzero(root != place)[0]
            return pa.RecordBatch.from_arrays([pa.array(rows[up, 4]), pa.array(rows[root[up], 4])], ["u", "v"]) if len(up) else None

        rows, fps = None, None
        for b in batches:
            if not b.num_rows:
                continue
            now = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
            own = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(len(now), -1)
            rows, fps = (now, own) if rows is None else (np.concatenate([rows, now]), np.concatenate([fps, own]))
            cut = len(rows) - int(np.argmax((rows[::-1, :3] != rows[-1, :3]).any(1))) if (rows[:, :3] != rows[-1, :3]).any() else 0  # the last run may go on
            if cut:
                if (out := forest(rows[:cut], fps[:cut])) is not None:
                    yield out
                rows, fps = rows[cut:], fps[cut:]
        if rows is not None and (out := forest(rows, fps)) is not None:
            yield out

    dealt = tiled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "tile", "c")
    return dealt.mapInArrow(compared, "u long, v long")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, bits: int = 64, radius: int = 2, bands: list[list[int]] | None = None, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) of each row: component is the least id reached by links of `radius` bits or fewer."""
    known = stored(fingerprints(docs, shingle=shingle, bits=bits, distinct=distinct, id_col=id_col, text_col=text_col), "simhash")
    unique = known.groupBy("fp").agg(F.min("id").alias("least")).withColumn("c", F.monotonically_increasing_id())
    unique = stored(unique, "fingerprints")  # once written, the numbers stay
    found = components(links(banded(unique, bands or exact_bands(bits, radius)), unique, radius))
    joined = unique.join(found, F.col("c") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "c").alias("root"))
    joined = stored(joined, "classes")
    forget(unique)
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = joined.join(least, "root").select(F.col("fp").alias("k"), "component")
    return known.join(by_fp, F.col("fp") == F.col("k")).select("id", "fp", "component")


#: At a similarity of 0.8 the set cosine 2s / (1 + s) is 0.889, the angle 27.3 degrees, and 78 of 512 bits differ, give or take 8; small sets differ in up to 96. Candidates only: wide.
WIDE_BITS, WIDE_RADIUS = 512, 112
#: Bands of least hashes, by which candidates meet: at 0.8 all miss with a probability of (1 - 0.8 ** 4) ** 16 = 2e-4, at 0.82 of 6e-5.
COVER, COVER_WIDTH = 16, 4
#: Shingles of a group of candidates from which it is cut into tiles.
TILE_SHINGLES = 1 << 18
_FACTORS = np.random.default_rng(13).integers(0, 1 << 63, (COVER * COVER_WIDTH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def cover_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes under COVER_WIDTH orders."""
    least = np.full(COVER * COVER_WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SHINGLES):
        least = np.minimum(least, (hashes[None, at : at + SHINGLES] * _FACTORS).min(1))
    keys = np.arange(COVER, dtype=np.uint64)
    for column in least.reshape(COVER, COVER_WIDTH).T:
        keys = _mix(keys ^ column) + np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def verified_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Classes (least index) by pairs of left and right whose sets have a Jaccard similarity of 0.8 or more; pairs already of a class are passed over."""
    size = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark, parent = np.zeros(int(code.max()) + 1, bool), np.arange(len(sets))
    for i in left:
        own = code[start[i] : start[i + 1]]
        mark[own] = True
        rest = right[(5 * np.minimum(size[right], size[i]) >= 4 * np.maximum(size[right], size[i])) & (right != i)]
        step = 16
        while len(rest := rest[parent[rest] != parent[i]]):
            now, rest = rest[:step], rest[step:]
            ends = np.cumsum(size[now])
            at = np.arange(ends[-1]) + np.repeat(start[now] - (ends - size[now]), size[now])
            common = np.add.reduceat(mark[code[at]].astype(np.int64), ends - size[now])
            linked = now[9 * common >= 4 * (size[now] + size[i])]  # common >= 0.8 of the union
            if len(linked):
                parent = _unite(parent, np.full(len(linked), i), linked)
            step = min(4 * step, 256)
        mark[own] = False
    return parent


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, set, fp, cover, n) of each (row, id, text)."""
    let_go()
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):  # few sets at a time
            b = whole.slice(at, AT_ONCE)
            got = [shingle_set(t.as_py()) for t in b.column(2)]
            made = [
                pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in got], pa.binary()),
                pa.array([fingerprint(h, WIDE_BITS) for h in got], pa.binary()),
                pa.array([cover_keys(h) for h in got], pa.list_(pa.int64())),
                pa.array([len(h) for h in got], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["row", "id", "set", "fp", "cover", "n"])
        trim()


def similar_sets(rows: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(class, best) of each distinct set of five-word shingles of rows (`_row` tells them apart): classes by links of a Jaccard similarity of 0.8 or more; best: none, id, row of the set's row with the least id (null: last).

    Candidates share a band of least hashes and have fingerprints within WIDE_RADIUS, compared bit-sliced; whatever they
    lead to is one group, and all pairs of a group are verified on their sets, which travel once (a large group's: once a
    tile).
    """
    base = rows.select(F.col("_row").alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = StructType([base.schema["row"], base.schema["id"], StructField("set", BinaryType()), StructField("fp", BinaryType()), StructField("cover", ArrayType(LongType())), StructField("n", LongType())])
    known = stored(base.mapInArrow(read, out), "simhash")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("best")
    sets = known.groupBy("set").agg(best, F.min("fp").alias("fp"), F.min("cover").alias("cover"), F.min("n").alias("n"))
    sets = stored(sets.withColumn("c", F.xxhash64("fp")), "sets")  # equal numbers only make candidates
    forget(known)
    keyed = sets.select(F.explode("cover").alias("key"), "c")
    groups = components(links(keyed, sets.groupBy("c").agg(F.min("fp").alias("fp")), WIDE_RADIUS))
    members = sets.join(groups, F.col("c") == F.col("node"), "left").select("set", F.col("best.row").alias("first"), "n", F.coalesce("root", "c").alias("group"))
    members = stored(members, "candidates")
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("k"), F.ceil(F.sum("n") / TILE_SHINGLES).cast("int").alias("tiles")).filter("k > 1").select(F.col("group").alias("g"), "tiles")
    tiles = members.join(sizes, F.col("group") == F.col("g")).withColumn("tile", F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int"))
    tiles = stored(tiles.select("set", "first", "group", "tile", "tiles"), "tiles")
    forget(members)
    texts = base.select("row", "text").join(few(tiles), F.col("first") == F.col("row")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = texts.select("group", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "set", "text")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(run: list[tuple[int, bytes, np.ndarray]], cross: bool) -> pa.RecordBatch | None:
            tile, every = np.array([x[0] for x in run]), np.arange(len(run))
            left, right = (every[tile == tile.min()], every[tile != tile.min()]) if cross else (every, every)
            if len(run) < 2 or cross and not len(right):
                return None
            root = verified_links([x[2] for x in run], left, right)
            up = np.nonzero(root != every)[0]
            return pa.RecordBatch.from_arrays([pa.array([run[i][1] for i in up], pa.binary()), pa.array([run[root[i]][1] for i in up], pa.binary())], ["u", "v"]) if len(up) else None

        mark, run = None, []
        for b in batches:
            for at in range(0, b.num_rows, 64):  # few texts at a time
                for group, low, high, tile, key, text in zip(*[c.to_pylist() for c in b.slice(at, 64).columns], strict=True):
                    if (group, low, high) != mark:
                        if run and (out := linked(run, mark[1] != mark[2])) is not None:
                            yield out
                        mark, run = (group, low, high), []
                    run.append((tile, key, shingle_set(text)))
        if run and (out := linked(run, mark[1] != mark[2])) is not None:
            yield out

    dealt = tiled.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")
    found = components(dealt.mapInArrow(verified, "u binary, v binary"))
    return sets.join(found, F.col("set") == F.col("node"), "left").select(F.coalesce("root", "set").alias("class"), "best")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies (five-word shingles, Jaccard similarity 0.8 or more, and what such links lead to): of each group the row with the least id stays (null: last).

    Rows are dropped by a key of their own: unlike texts with one id, or with none, all stay. Texts without a word are
    no copies of each other: they all stay.
    """
    has = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    full = numbered(docs.filter(has), "_row", "rows")
    similar = similar_sets(full, id_col=id_col, text_col=text_col)
    kept = similar.groupBy("class").agg(F.min("best").alias("best")).select(F.col("best.row").alias("_kept"))
    return full.join(few(stored(kept, "kept")), F.col("_row") == F.col("_kept"), "left_semi").drop("_row").unionByName(docs.filter(~has))
