"""Beyond parity: a fitted model scores micro-batches, and class means of the scores run along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.classifiers import Fitted, predicted


def score_stream(stream: DataFrame, model: Fitted, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Each micro-batch (id, x, ...) goes to the sink with p and conf. Restarts go on where the checkpoint is."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(df.join(predicted(model.scores(df)).select("id", "p", "conf"), "id"), epoch)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, at: str = "ts", label: str = "p", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Predictions by window and class; rows that come later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), label).agg(F.count(F.lit(1)).alias("n"))
