"""Pairs that arrive as a stream are compared batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.compare import compare_blocks


def compare_arrivals(pairs: DataFrame, blocks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Compare each micro-batch of the streaming table ``pairs`` with the static ``blocks``.

    Only the blocks of a batch's documents are read into the comparison, and what it keeps
    is released with the batch. Change counts go to ``out`` as Parquet, one folder for each batch id, so that a
    batch which is run again replaces its own result.
    """

    def each(batch: DataFrame, number: int) -> None:
        wanted = batch.select(F.explode(F.array("old_doc", "new_doc")).alias("doc_id")).distinct()
        made = compare_blocks(batch, blocks.join(wanted, "doc_id", "left_semi"))
        made.counts.write.mode("overwrite").parquet(f"{out}/batch={number}")
        made.release()

    return pairs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
