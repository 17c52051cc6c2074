"""The engine's own tables: their creation, the rules they keep, and whether they can be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DOCUMENT, EDGE, ENTITY, REGISTRY
from ..session import path_exists
from .store import read_state, save_state

POINT = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("type", T.StringType()),
    T.StructField("domain", T.StringType()), T.StructField("source_doc", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])
#: Name, schema and key of each table; the key is null-safe and unique.
TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "entities": (ENTITY, ("name", "type", "domain")),
    "edges": (EDGE, ("src_name", "src_type", "src_domain", "dst_name", "dst_type", "dst_domain", "rel_type")),
    "points": (POINT, ("vec_id",)),
    "documents": (DOCUMENT, ("filename",)),
    "registry": (REGISTRY, ("filename",)),
}


def create(spark: SparkSession, folder: str) -> list[str]:
    """Creates the tables that are missing, empty; gives their names. Running it again changes nothing."""
    made = []
    for name, (schema, _) in TABLES.items():
        if not path_exists(spark, f"{folder}/{name}/_current"):
            save_state(spark.createDataFrame([], schema), f"{folder}/{name}")
            made.append(name)
    return made


def violations(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that more than one row has, and how many: what a uniqueness constraint would refuse. Partial counts are combined before the shuffle."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def health(spark: SparkSession, folder: str) -> DataFrame:
    """``name, ok, rows, error`` of each table: whether its current version can be read, and how many rows it has."""
    out = []
    for name, (schema, _) in TABLES.items():
        try:
            there = path_exists(spark, f"{folder}/{name}/_current")
            out.append((name, there, read_state(spark, f"{folder}/{name}", schema).count() if there else 0, None if there else "missing"))
        except Exception as e:
            out.append((name, False, 0, str(e).split("\n")[0][:200]))
    return spark.createDataFrame(out, "name string, ok boolean, rows bigint, error string")
