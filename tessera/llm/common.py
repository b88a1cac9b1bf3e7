"""What several operators share: the shared work folder and distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Least number of buckets a key is split into, and rows a bucket may hold.
LEAST_BUCKETS, BUCKET_ROWS = 256, 50_000
#: Rows of up to about 60 bytes that are sent to every executor.
MOST_BROADCAST = 300_000


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A temporary one is set only where none is and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: a lost executor costs no recomputation, and the plan starts anew.

    Tables stay for the session, as results may be read late; they lie in a folder of the application and go with it.
    """
    spark = df.sparkSession
    home = f"{work_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_remove, spark, home)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, as what was made of them is stored itself."""
    for t in tables:
        _remove(t.sparkSession, t._stored_at)


_homes: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _of_one_file_table(df: DataFrame) -> bool:
    """Whether df is the rows of files, each once: columns chosen and rows filtered, nothing else."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.deterministic() and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.deterministic() and plan.nodeName() == "LogicalRelation"


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a column that tells its rows apart and stays when they are read again.

    Rows of Parquet files have their file and their place in it; those of other tables are numbered and written first.
    """
    if _of_one_file_table(df):
        with contextlib.suppress(AnalysisException):  # files of other kinds have no places
            at = df.metadataColumn("_metadata")
            return df.withColumn(column, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place")))
    return stored(df.withColumn(column, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place"))), name)


_held: dict[object, object] = {}


def held(key: object, make):
    """make() of this key, kept by a worker until another is asked for: workers serve many stages, and what one needs is no use to the next."""
    if key not in _held:
        let_go()
        _held[key] = make()
        trim()
    return _held[key]


def let_go() -> None:
    """Drop what a worker keeps; what needs memory and no model begins with it."""
    if _held:
        _held.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Hand freed memory back to the system: allocators keep it otherwise, and an executor's workers and its JVM share one limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def few(df: DataFrame) -> DataFrame:
    """A stored table, sent to every executor if it has up to MOST_BROADCAST rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def buckets_for(n_rows: int) -> int:
    return max(LEAST_BUCKETS, -(-n_rows // BUCKET_ROWS))


def ranked(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, weight: Column | None = None) -> DataFrame:
    """Add `rank` (0, 1, ... within keys) and, given a weight, `before` (weight of lower ranks of the key).

    Rows of a key follow bucket, then order. A task holds one bucket of one key, so a hot key is spread;
    only one row per key and bucket meets in the window over the bucket totals.
    """
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    rows = df.withColumns({"_bucket": bucket.cast("long"), "_weight": weight})
    totals = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_weight").alias("_w"))
    above = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_kb"),
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_w").over(above), F.lit(0)).alias("_w0"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = rows.withColumns({
        "_r": F.row_number().over(inside) - 1,
        "_s": F.coalesce(F.sum("_weight").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    on = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(totals, on).select(*df.columns, (F.col("_n0") + F.col("_r")).alias("rank"), (F.col("_w0") + F.col("_s")).alias("before"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
