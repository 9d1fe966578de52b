"""Batches of landed records folded in as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.pipeline import run_batch
from ledgerloom.schemas import RAW
from ledgerloom.sources.tables import TableStore


def landed_records(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """RAW records of Parquet files as they land (with their seq)."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(
    records: DataFrame,
    store: TableStore,
    checkpoint: str,
    as_of: Callable[[int], str],
    stream: str | None = None,
    **options,
) -> StreamingQuery:
    """Start folding batches in; each becomes the next version of the store.

    The mark of a version names the stream and the batch, so a batch that was
    committed before a failure is not applied twice, and any other change of
    the store in between costs no batch. ``stream`` defaults to a name made of
    the checkpoint, which is what makes batch numbers unique.
    """
    name = stream or hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def fold(batch: DataFrame, batch_id: int) -> None:
        own = TableStore(batch.sparkSession, store.root)
        if not own.holds(name, batch_id):
            run_batch(own, batch, as_of(batch_id), stream=name, batch=batch_id, **options)

    return (
        records.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
