"""Folders of new candidate rows as a stream: each micro-batch is compared as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veridelta.plans.compare import DocumentComparison, from_texts


def watch(spark: SparkSession, folder: str, baseline: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, schema: str = "pair_id string, page_number int, text string", once: bool = False) -> StreamingQuery:
    """Compare Parquet files of candidate pages, as they arrive, with the baseline pages of the same
    pairs; sink(evidence, batch id) must be idempotent, as a batch may run again after a failure."""

    def run(batch: DataFrame, batch_id: int) -> None:
        wanted = batch.select("pair_id").distinct()
        mine = baseline.join(wanted, "pair_id", "left_semi")
        sink(DocumentComparison(*from_texts(batch, mine)).evidence(), batch_id)

    stream = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
