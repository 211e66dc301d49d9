"""Extension: the upsert of surviving records run over a stream of record files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from granary.operators.upserts import upsert_total_order


def upsert_stream(records: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Merge each micro-batch into the Parquet projection under ``target``; replayed batches change nothing.

    Each batch writes a new version folder named by its batch id, so a restart rewrites the version it was writing
    and readers of the version before are undisturbed.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{target}/v={number - 1}"
        incumbent = spark.read.parquet(before) if number else batch.limit(0)
        upsert_total_order(incumbent, batch, keys, order).write.mode("overwrite").parquet(f"{target}/v={number}")

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
