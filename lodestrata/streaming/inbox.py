"""The document inbox as a stream: files arrive, are known by content, pass the stages and end as processed, duplicate or failed.

Each micro-batch is one transaction over the registry: it is read, the batch's files are left-anti-joined by digest and the new version is
swapped in at the end, so that a batch that is run again after a failure finds its files unregistered or already done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import REGISTRY
from ..sources import store

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, inbox: str, pattern: str = "*.pdf") -> DataFrame:
    """The stream of files in a folder."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(inbox)


def process(batch: DataFrame, registry: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(documents, registry rows)`` of a batch; ``stage`` takes files (``path, content, md5``) and gives documents."""
    files = batch.withColumn("md5", F.md5("content"))
    fresh = store.unseen(files, registry)
    documents = stage(fresh)
    name = F.element_at(F.split("path", "/"), -1)
    gate = documents.select(F.col("filename"), (F.coalesce("page_count", F.lit(0)) > 0).alias("ok"))
    done = files.select(name.alias("filename"), "md5", "path").join(fresh.select("path", F.lit(True).alias("fresh")), "path", "left").join(gate, "filename", "left")
    status = F.when(F.col("fresh").isNull(), "duplicate").when(F.coalesce("ok", F.lit(False)), "processed").otherwise("failed")
    rows = done.select("filename", "md5", status.alias("status"), F.when(status == "failed", "no page could be read").alias("error"), F.current_timestamp().alias("at"))
    return documents, rows


def run_inbox(spark: SparkSession, inbox: str, state: str, out: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame] = store.parse_documents,
              pattern: str = "*.pdf", available_now: bool = True):
    """Starts the inbox; with ``available_now`` it handles what is there and stops. Documents go to ``out`` by batch number, the registry to ``state``."""
    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        registry = store.read_state(spark, state, REGISTRY)
        documents, rows = process(batch, registry, stage)
        documents.write.mode("overwrite").parquet(f"{out}/batch={number}")
        store.save_state(store.mark(registry, rows), state)
        batch.unpersist()

    writer = arrivals(spark, inbox, pattern).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
