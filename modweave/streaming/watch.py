"""Recompute on change: micro-batches over arriving fact tables, one at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

DEBOUNCE = "150 milliseconds"


def watch(spark: SparkSession, folder: str, schema: str, recompute: Callable[[SparkSession], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call ``recompute`` after each micro-batch of Parquet files that arrive in ``folder``.

    Changes within one trigger interval are one batch, batches run one after another, and changes that arrive meanwhile
    are the next one. The whole result is computed again each time. ``once`` stops when what is there has been seen.
    """
    rows = spark.readStream.schema(schema).parquet(folder)

    def batch(changed: DataFrame, _: int) -> None:
        if changed.limit(1).count():
            recompute(changed.sparkSession)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
