"""Documents to chunks: pages, sections, tiers, sliding windows, priorities and what an extractor returns for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chunk_id, detect_section, section_weight

# Window and overlap in words, and sections left out, by tier.
WINDOWS = {1: (500, 50), 2: (800, 100), 3: (1200, 150)}
SKIPPED = {1: (), 2: ("references",), 3: ("references", "back_matter")}
LEAST_WORDS = 20


def pages_of(documents: DataFrame) -> DataFrame:
    """One row per page of a parsed document."""
    return documents.select("filename", "page_count", "tier", F.explode("pages").alias("p")).select("filename", "page_count", "tier", "p.*")


def quality_scores(pages: DataFrame) -> DataFrame:
    """Share of pages with text, two decimals."""
    return pages.groupBy("filename").agg(F.round(F.count(F.when(F.trim("text") != "", 1)) / F.count("*"), 2).alias("quality_score"))


def ocr_needed(pages: DataFrame, least: int = 50) -> DataFrame:
    """Pages with too little text to be anything but an image."""
    return pages.where(F.coalesce(F.length(F.trim("text")), F.lit(0)) < least)


def with_sections(pages: DataFrame) -> DataFrame:
    return pages.withColumn("section", detect_section("text", "page", "page_count"))


def chunk_windows(pages: DataFrame) -> DataFrame:
    """Word windows of each page by the document's ``tier``: ``filename, page, section, weight, window, text``.

    Windows start at every stride while words are left; under twenty words are dropped. All inside the JVM.
    """
    size = F.when(F.col("tier") == 1, 500).when(F.col("tier") == 2, 800).otherwise(1200)
    stride = F.when(F.col("tier") == 1, 450).when(F.col("tier") == 2, 700).otherwise(1050)
    skip = ((F.col("tier") == 2) & F.col("section").isin(*SKIPPED[2])) | ((F.col("tier") == 3) & F.col("section").isin(*SKIPPED[3]))
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    rows = pages.where(~F.coalesce(skip, F.lit(False))).withColumn("__w", words).where(F.size("__w") >= LEAST_WORDS)
    starts = F.sequence(F.lit(0), F.greatest(F.size("__w") - 1, F.lit(0)), stride)
    cut = rows.withColumn("__size", size).withColumn("__starts", starts).select(
        "*", F.posexplode("__starts").alias("window", "__start")).withColumn("__part", F.slice("__w", F.col("__start") + 1, F.col("__size")))
    return cut.where(F.size("__part") >= LEAST_WORDS).select(
        "filename", "tier", "page", "section", section_weight("section").alias("weight"), "window", F.array_join("__part", " ").alias("text"))


def priority_order(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """``chunk_index`` in each document: by weight first for the largest tier, else as they come; optionally the first ``most``."""
    weight = F.when(F.col("tier") == 3, -F.col("weight")).otherwise(0.0)
    w = Window.partitionBy("filename").orderBy(weight, "page", "window")
    out = chunks.withColumn("chunk_index", F.row_number().over(w) - 1)
    return out if most is None else out.where(F.col("chunk_index") < most)


def with_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id("filename", "page", "chunk_index", "text"))


def batches(chunks: DataFrame, size: int = 3) -> DataFrame:
    """The number of the extraction batch of each chunk."""
    return chunks.withColumn("batch", F.floor(F.col("chunk_index") / size))


def type_vote(mentions: DataFrame) -> DataFrame:
    """``name_key, type``: the most frequent type of each name, the first seen on ties."""
    n = mentions.groupBy("name_key", "type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy("name_key").orderBy(F.desc("n"), "first")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("name_key", "type")


def retype_relationships(rels: DataFrame, votes: DataFrame) -> DataFrame:
    """Relationship ends take the voted type of their name, where there is one."""
    a = votes.select(F.col("name_key").alias("__fk"), F.col("type").alias("__ft"))
    b = votes.select(F.col("name_key").alias("__tk"), F.col("type").alias("__tt"))
    out = rels.join(a, F.lower(F.trim("from_name")) == F.col("__fk"), "left").join(b, F.lower(F.trim("to_name")) == F.col("__tk"), "left")
    return out.withColumn("from_type", F.coalesce("__ft", "from_type")).withColumn("to_type", F.coalesce("__tt", "to_type")).drop("__fk", "__ft", "__tk", "__tt")


def first_occurrences(mentions: DataFrame) -> DataFrame:
    """The first mention of each name and type."""
    w = Window.partitionBy("name_key", "type").orderBy("seq")
    return mentions.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def well_formed(rows: DataFrame, *required: str) -> DataFrame:
    out = rows
    for c in required:
        out = out.where(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return out


def summaries(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` non-empty summaries of each document as one text."""
    held = rows.where(F.trim("summary") != "").groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("seq", "summary"))).alias("h"))
    return held.select("filename", F.array_join(F.slice("h.summary", 1, n), " ").alias("summary"))


def quality_gate(documents: DataFrame) -> DataFrame:
    """Documents with ``status``: rejected where there is neither a page nor a chunk."""
    return documents.withColumn("status", F.when((F.coalesce("page_count", F.lit(0)) == 0) & (F.coalesce("chunk_count", F.lit(0)) == 0), "rejected").otherwise("accepted"))


def vector_rows(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """Chunks and claims as one table of texts to encode, blank texts left out."""
    columns = ["text", "source_doc", "page"]
    return chunks.select(*columns, F.lit("chunk").alias("type")).unionByName(claims.select(*columns, F.lit("claim").alias("type"))).where(F.trim("text") != "")


def ingest_report(entities: DataFrame, rels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document what was extracted and written, and the share not written."""
    e = entities.groupBy("source_doc").agg(F.count("*").alias("entities"), F.count(F.when(F.col("written"), 1)).alias("entities_written"))
    r = rels.groupBy("source_doc").agg(F.count("*").alias("relationships"))
    c = chunks.groupBy("source_doc").agg(F.count("*").alias("chunks"))
    out = e.join(r, "source_doc", "full_outer").join(c, "source_doc", "full_outer").na.fill(0)
    rate = F.when(F.col("entities") > 0, 1 - F.col("entities_written") / F.col("entities")).otherwise(0.0)
    return out.withColumn("unwritten_rate", rate)
