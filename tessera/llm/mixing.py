"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled and laid end to end; the stream, repeated as often as asked, is cut into
blocks of `block_tokens` words. A source may fill as many slots of the schedule as its target has blocks. The slots
of all sources together are the integers 0..N-1, each source owning one interval of them (the cumulative weights);
the schedule visits them in van der Corput order (bits reversed), so that any stretch of it is mixed nearly as the
whole. The slots of a source are ranked in visiting order and joined to its blocks by rank; the last block is cut
where the target is reached.

The slots of a document's words come with the result: sorted by them, documents are the mix.

Nulls: a null text has no words, a null source is a source of its own and comes last, a null id stays null.
Empty tables give an empty result; sources without words get target 0. Repeated rows stay separate rows. Other
columns of the input take part only in the shuffle order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, buckets_for, numbered, ranked, stored

BLOCK_TOKENS = 1024
#: Words of a partition of the mix.
FILE_WORDS = 2_000_000
#: Sources are a configured dimension, held on the driver; more are refused.
MAX_SOURCES = 100_000


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none above cap times its size; what is cut off is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0], float(total)
    while open_:
        rate = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * rate >= cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * rate
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def van_der_corput(v: np.ndarray, bits: int) -> np.ndarray:
    """The time at which slot v is visited: v with its bits reversed."""
    out, v = np.zeros_like(v), v.copy()
    for _ in range(bits):
        out = (out << 1) | (v & 1)
        v >>= 1
    return out


def schedule(spark, quotas: list[int]) -> DataFrame:
    """(src, time, rank): for each source as many slots as its quota, ranked in the order in which the schedule visits them; `time` orders all."""
    ends = np.cumsum([0, *quotas])[1:].astype(np.int64)
    n = int(ends[-1]) if len(ends) else 0
    bits = max(1, n.bit_length())

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(ends, v, side="right").astype(np.int32)), pa.array(van_der_corput(v, bits))], ["src", "time"])

    timed = spark.range(n).mapInArrow(slots, "src int, time long")
    low = max(0, bits - int(math.log2(buckets_for(n))))
    return ranked(timed, ["src"], [F.col("time")], F.shiftright("time", low)).select("src", "time", "rank")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_of: Callable[[int, str | None], float], share: float = 1.5, cap: float = 2.0, block_tokens: int = BLOCK_TOKENS, seed: int = 1, shuffled_by: list[str] | None = None) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, passes.

    weight_of(i, source) gives the weight of the i-th source by code point (null last). The mix holds `share` times
    all words; targets stop at `cap` times their source's size. `taken` counts the words the mix takes of a document,
    repeats included. `passes` has for each pass over the source the words taken in it and the slot of the schedule in
    which the document first comes up (null: nothing taken); sorted by slot, passes of all documents are the mix.
    Documents are shuffled by a hash of the columns shuffled_by (all).
    """
    spark = docs.sparkSession
    row_hash = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in shuffled_by or docs.columns if not isinstance(docs.schema[c].dataType, _unhashable())])
    sized = stored(docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_hash.alias("row_hash"),
    ), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    n_docs, sizes = sum(r["n"] for r in found), [int(r["s"]) for r in found]
    targets = water_fill(sizes, [weight_of(i, r["source"]) for i, r in enumerate(found)], share * sum(sizes), cap)
    words = [math.floor(t + 1e-6) for t in targets]
    quotas = [-(-w // block_tokens) for w in words]
    sources = F.broadcast(spark.createDataFrame(
        [(r["source"], i, sizes[i], targets[i], words[i]) for i, r in enumerate(found)],
        "s_source string, src int, source_size long, target double, target_words long",
    ))
    known = sized.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    buckets, epochs = buckets_for(n_docs), max(1, math.ceil(cap))
    placed = ranked(known, ["src"], [F.col("row_hash"), F.col("id"), F.col("size")], F.pmod(F.shiftrightunsigned("row_hash", 20), F.lit(buckets)), F.col("size"))
    slots = schedule(spark, quotas).select(F.col("src").alias("t_src"), F.col("rank").alias("t_slot"), "time")
    block = F.lit(block_tokens).cast("long")
    passes = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    passes = passes.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("before"))
    pieces = passes.withColumn("slot", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)))))
    # the join of blocks to slots: a block that no slot asks for is not taken
    got = pieces.join(slots, (F.col("src") == F.col("t_src")) & (F.col("slot") == F.col("t_slot")), "left")
    end = F.least(F.col("at") + F.col("size"), (F.col("slot") + 1) * block, F.col("target_words"))
    part = F.when(F.col("t_slot").isNotNull(), F.greatest(end - F.greatest(F.col("at"), F.col("slot") * block), F.lit(0))).otherwise(0)
    own = lambda e, v: F.when(F.col("epoch") == e, v)
    each = [x for e in range(epochs) for x in (F.sum(own(e, F.col("part"))).alias(f"w{e}"), F.min(own(e, F.when(F.col("part") > 0, F.col("time")))).alias(f"t{e}"))]
    return (
        got.withColumn("part", part.cast("long"))
        .groupBy("src", "rank", "id", "source", "size", "source_size", "target")
        .agg(F.sum("part").alias("taken"), *each)
        .select("id", "source", "size", "source_size", "target", "taken", F.array(*[F.struct(F.col(f"w{e}").alias("words"), F.col(f"t{e}").alias("slot")) for e in range(epochs)]).alias("passes"))
    )


def _unhashable():
    from pyspark.sql.types import MapType, VariantType

    return (MapType, VariantType)


def cycle_521(i: int, source: str | None) -> float:
    return (5.0, 2.0, 1.0)[i % 3]


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each once for every pass that takes at least half of its words; no columns added.

    Rows come in the order in which the schedule visits them: any stretch of the partitions written is mixed nearly as
    the whole. Documents without words are left out: the mix takes nothing of them.
    """
    rows = numbered(docs, "_mix_row", "mix-rows")
    taken = mix(rows, id_col="_mix_row", shuffled_by=docs.columns, weight_of=cycle_521, **options)
    due = taken.filter("size > 0").select(F.col("id").alias("_mix_id"), "size", F.explode("passes").alias("p"))
    due = stored(due.filter("2 * p.words >= size").select("_mix_id", F.col("size").alias("_mix_size"), F.col("p.slot").alias("_mix_slot")), "mix-due")
    all_ = due.agg(F.sum("_mix_size").alias("words"), F.max("_mix_slot").alias("top")).first()
    parts = -(-(all_["words"] or 1) // FILE_WORDS)
    place = F.floor(F.col("_mix_slot") * parts / ((all_["top"] or 0) + 1)).cast("int")  # slots are spread evenly
    met = rows.join(due, F.col("_mix_row") == F.col("_mix_id"))
    return met.repartitionById(parts, place).sortWithinPartitions("_mix_slot", "_mix_row").select(*docs.columns)
