"""Declared schemas and the fixture views over the driver's tables.

The views are given as SQL that Spark and the checking engine read alike; the engine's operators take DataFrames and know nothing
of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import table

EVIDENCE = T.StructType([
    T.StructField("source_doc", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("chunk_id", T.StringType()),
    T.StructField("excerpt", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("extracted_at", T.LongType())])
PAGE = T.StructType([
    T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("char_count", T.IntegerType()),
    T.StructField("section", T.StringType())])
TABLE_ON_PAGE = T.StructType([
    T.StructField("page", T.IntegerType()), T.StructField("data", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("text", T.StringType())])
DOCUMENT = T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("title", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("page_count", T.IntegerType()), T.StructField("tier", T.IntegerType()),
    T.StructField("quality_score", T.DoubleType()), T.StructField("ocr_pages", T.ArrayType(T.IntegerType())),
    T.StructField("pages", T.ArrayType(PAGE)), T.StructField("tables", T.ArrayType(TABLE_ON_PAGE))])
ENTITY = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("source_doc", T.StringType()), T.StructField("last_updated", T.TimestampType()),
    T.StructField("description", T.StringType()), T.StructField("evidence", T.ArrayType(EVIDENCE)), T.StructField("flagged", T.BooleanType()),
    T.StructField("superseded_by", T.StringType())])
EDGE = T.StructType([
    T.StructField("src_name", T.StringType()), T.StructField("src_type", T.StringType()), T.StructField("src_domain", T.StringType()),
    T.StructField("dst_name", T.StringType()), T.StructField("dst_type", T.StringType()), T.StructField("dst_domain", T.StringType()),
    T.StructField("rel_type", T.StringType()), T.StructField("source_doc", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(EVIDENCE)), T.StructField("created_at", T.TimestampType()), T.StructField("last_updated", T.TimestampType())])
REGISTRY = T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("md5", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()), T.StructField("at", T.TimestampType())])

# Views. Scaled integers keep confidences exact in both engines.
ENT_SQL = """SELECT p_partkey AS eid, p_name AS name, p_type AS type, p_brand AS domain, 0.5E0 + p_size / 100E0 AS confidence,
    'doc' || CAST(p_partkey % 50 AS VARCHAR) AS source_doc FROM part"""
EDG_SQL = """SELECT row_number() OVER (ORDER BY src, dst, rel_type) AS edge_id, src, dst, rel_type, confidence FROM (
    SELECT 'P' || CAST(l_partkey AS VARCHAR) AS src, 'S' || CAST(l_suppkey AS VARCHAR) AS dst,
        CASE l_returnflag WHEN 'R' THEN 'REFERENCES' WHEN 'A' THEN 'AUTHORED_BY' ELSE 'USES' END AS rel_type,
        max(1E0 - l_discount) AS confidence FROM lineitem GROUP BY 1, 2, 3
    UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'N' || CAST(s_nationkey AS VARCHAR), 'LOCATED_IN', 0.9E0 FROM supplier
    UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR), 'PART_OF', 0.95E0 FROM nation) e"""


def _spark(sql: str) -> str:
    return sql.replace("VARCHAR", "STRING")


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Driver tables by name."""
    return {n: table(spark, sf_dir, n) for n in names}


def fixture(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A view of the driver's tables from SQL that both engines read."""
    return spark.sql(_with_refs(_spark(sql), names), **views(spark, sf_dir, *names))


def _with_refs(sql: str, names: tuple[str, ...]) -> str:
    import re

    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return sql


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, ENT_SQL, "part")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with an id; the id comes from a hash and not from a global order."""
    own = fixture(spark, sf_dir, EDG_SQL.replace("row_number() OVER (ORDER BY src, dst, rel_type) AS edge_id, ", ""), "lineitem", "supplier", "nation")
    return own.withColumn("edge_id", F.concat_ws("|", "src", "dst", "rel_type"))
