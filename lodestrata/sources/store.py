"""State on disk: tables that are swapped whole, append-only logs, the registry of files and parsed documents."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DOCUMENT, REGISTRY
from ..session import path_exists


def load_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a declared schema; a missing file is empty, broken lines are left out."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    held = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    return spark.read.schema(held).option("columnNameOfCorruptRecord", "_broken").json(path).where("_broken IS NULL").drop("_broken")


def save_state(df: DataFrame, path: str, keep: int = 3) -> str:
    """Writes a new version of a table and then points to it; readers see the old one or the new one. Returns the version's folder.

    The last ``keep`` versions stay.
    """
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    pointer = df.sparkSession.createDataFrame([(version,)], "current string")
    pointer.coalesce(1).write.mode("overwrite").json(f"{path}/_current")
    _drop_old(df.sparkSession, path, version, keep)
    return version


def _drop_old(spark: SparkSession, path: str, current: str, keep: int) -> None:
    """Removes all versions but the current one and the ``keep - 1`` written last before it, which a reader may still hold."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("v-") and s.getPath().getName() != current.rsplit("/", 1)[-1]]
    for s in sorted(held, key=lambda s: s.getModificationTime(), reverse=True)[max(0, keep - 1):]:
        fs.delete(s.getPath(), True)


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The current version of a table, or an empty one."""
    if not path_exists(spark, f"{path}/_current"):
        return spark.createDataFrame([], schema)
    version = spark.read.json(f"{path}/_current").head()["current"]
    return spark.read.schema(schema).parquet(version)


def migrate_domains(flat: DataFrame) -> DataFrame:
    """A flat table of names becomes the structured one: ``name, times_seen, parent``."""
    return flat if "times_seen" in flat.columns else flat.select("name", F.lit(1).alias("times_seen"), F.lit(None).cast("string").alias("parent"))


def current_model(cache: DataFrame, model: str) -> DataFrame:
    """Cached vectors of this model; those of another are dropped."""
    return cache.where(F.col("model") == model)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def recent(log: DataFrame, n: int = 10, order: str = "seq") -> DataFrame:
    """The last ``n`` entries, newest first."""
    return log.orderBy(F.desc(order)).limit(n)


def fingerprints(files: DataFrame) -> DataFrame:
    """``path, md5`` of binary files."""
    return files.select("path", F.md5("content").alias("md5"))


def unseen(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content is not registered yet; of equal ones the first by name."""
    w = Window.partitionBy("md5").orderBy("path")
    first = files.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.join(registry.where("status = 'processed'").select("md5"), "md5", "left_anti")


def mark(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """The registry after a batch: the last state of each file, errors cut to 500 characters."""
    both = registry.unionByName(batch.withColumn("error", F.substring("error", 1, 500)))
    w = Window.partitionBy("filename").orderBy(F.desc("at"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def registry_stats(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count(F.when(F.col("status") == "processed", 1)).alias("processed"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
                        F.count_distinct("md5").alias("fingerprints"))


def backlog(spark: SparkSession, inbox: str, pattern: str = "*.pdf") -> DataFrame:
    """All waiting files, not recursively: ``path, modificationTime, length, content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(inbox)


def plain_parser(name: str, content: bytes) -> dict:
    """The stand-in parser: form feeds part pages, the first line is the title."""
    text = content.decode("utf-8", "replace")
    pages = [{"page": i + 1, "text": p, "char_count": len(p), "section": None} for i, p in enumerate(text.split("\f"))] if text else []
    return {"title": text.strip().split("\n", 1)[0][:200] or None, "pages": pages, "tables": [], "ocr_pages": []}


def parse_documents(files: DataFrame, parser: Callable[[str, bytes], dict] = plain_parser,
                    ocr: Callable[[str, int], str] | None = None, least: int = 50) -> DataFrame:
    """Documents of the declared schema from binary files. A page with less than ``least`` characters is read by ``ocr``, if that gives more; tables
    of one row are left out; a file that cannot be parsed has no pages."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    doc = parser(name, bytes(content))
                except Exception:
                    doc = {"pages": [], "tables": [], "ocr_pages": []}
                read = []
                for p in doc["pages"]:
                    if ocr is not None and len((p["text"] or "").strip()) < least:
                        better = ocr(name, p["page"])
                        if len(better or "") > len(p["text"] or ""):
                            p["text"], p["char_count"] = better, len(better)
                            read.append(p["page"])
                n = len(doc["pages"])
                full = sum(bool((p["text"] or "").strip()) for p in doc["pages"])
                rows.append({"filename": name, "title": doc.get("title"), "author": doc.get("author"), "subject": doc.get("subject"), "page_count": n,
                             "tier": 1 if n < 10 else 2 if n < 50 else 3, "quality_score": round(full / n, 2) if n else 0.0,
                             "ocr_pages": [*doc.get("ocr_pages", []), *read], "pages": doc["pages"],
                             "tables": [t for t in doc.get("tables", []) if len(t["data"]) > 1]})
            yield pd.DataFrame(rows, columns=DOCUMENT.fieldNames())

    return files.select("path", "content").mapInPandas(run, DOCUMENT)


def evaluation_row(spark: SparkSession, metrics: dict) -> DataFrame:
    """A row of the self-evaluation log."""
    return spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "metrics string")


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)
