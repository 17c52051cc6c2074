"""The whole way of a document, from the inbox into the graph, one micro-batch after another: parse, gate, extract, reconcile, ingest, route the file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import REGISTRY
from ..providers import Retry
from ..session import stage_scope, staged
from ..sources import store
from . import inbox

#: Files of one micro-batch: their names come to the driver, which moves them.
MOST_FILES = 1000


def move(spark: SparkSession, path: str, folder: str) -> bool:
    """A file into a folder of the same file system; whether it was there to be moved."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = jvm.org.apache.hadoop.fs.Path(folder)
    fs.mkdirs(target)
    goal = jvm.org.apache.hadoop.fs.Path(target, source.getName())
    if not fs.exists(source):
        return False
    fs.delete(goal, False)
    return bool(fs.rename(source, goal))


def route(spark: SparkSession, rows: DataFrame, paths: DataFrame, processed: str, quarantine: str) -> None:
    """Files by their status: processed and duplicates to one folder, failed ones to the other; what failed in ingestion stays for the next run."""
    joined = rows.join(paths, "filename").select("path", "status", "error")
    for r in joined.limit(MOST_FILES + 1).toLocalIterator():
        if r.status in ("processed", "duplicate"):
            move(spark, r.path, processed)
        elif not (r.error or "").startswith("ingestion"):
            move(spark, r.path, quarantine)


def run(spark: SparkSession, folder: str, state: str, checkpoint: str, processed: str, quarantine: str, extract: Callable[[DataFrame], object],
        ingest: Callable[[object], None], reconcile: Callable[[object], None] | None = None, stage: Callable[[DataFrame], DataFrame] = store.parse_documents,
        again: Retry = Retry(attempts=3), pattern: str = "*.pdf", available_now: bool = True):
    """Starts the pipeline. ``extract`` makes knowledge of parsed documents, ``reconcile`` and ``ingest`` take it; each is tried three times.

    A failed reconciliation is logged and passed over; a failed extraction marks the batch's documents failed, a failed ingestion too, but leaves their files.
    A batch that is run again finds its files registered, so nothing is ingested twice.
    """
    def handle(batch: DataFrame, number: int) -> None:
        with stage_scope(spark):
            files = staged(batch.limit(MOST_FILES + 1), "files")
            if files.count() > MOST_FILES:
                raise ValueError("more files than MOST_FILES in one micro-batch: set maxFilesPerTrigger")
            registry = store.read_state(spark, state, REGISTRY)
            documents, rows = inbox.process(files, registry, stage)
            good = staged(documents.where("page_count > 0"), "documents")
            rows = staged(rows, "rows")
            failed = None
            if good.limit(1).count():
                try:
                    known = again(extract, good)
                except Exception as e:
                    failed = f"extraction: {e}"
                if failed is None and reconcile is not None:
                    try:
                        again(reconcile, known)
                    except Exception as e:
                        print(f"reconciliation of batch {number} failed: {e}")
                if failed is None:
                    try:
                        again(ingest, known)
                    except Exception as e:
                        failed = f"ingestion: {e}"
            if failed is not None:
                was = F.col("status") == "processed"
                rows = rows.withColumn("error", F.when(was, F.lit(failed[:500])).otherwise(F.col("error"))).withColumn("status", F.when(was, "failed").otherwise(F.col("status")))
            store.save_state(store.mark(registry, rows), state)
            name = F.element_at(F.split("path", "/"), -1)
            route(spark, rows, files.select(name.alias("filename"), "path"), processed, quarantine)

    stream = spark.readStream.format("binaryFile").schema(inbox.FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", MOST_FILES).load(folder)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
