"""Outputs of steps kept in a folder by the fingerprint of all that made them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class StepCache:
    """A folder of tables. A table without its _SUCCESS mark was left off in the middle: it counts as absent and is written again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hits, self.misses = 0, 0

    def path(self, key: str) -> str:
        return f"{self.folder}/{key}"

    def whole(self, key: str) -> bool:
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(key)}/_SUCCESS")
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def __call__(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self.whole(key):
            self.hits += 1
        else:
            self.misses += 1
            make().write.mode("overwrite").parquet(self.path(key))
        return self.spark.read.parquet(self.path(key))
