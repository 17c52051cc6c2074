"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged, table
from . import canonical, cooccurrence, encoding, mixing, neighbours, repair, spans, splitting, subjects, variants


def _repair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return repair.repair(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "source_docs"), table(spark, sf_dir, "mentions"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repair(spark, sf_dir)[1].select("chunk_id", "kind", "token").distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as continuous paragraphs."""
    return repair.repaired(*_repair(spark, sf_dir))


def _lists(spark: SparkSession, sf_dir: str) -> dict[str, list]:
    return {"relationships": canonical.entries_of(table(spark, sf_dir, "relation_types"), ["synonyms"]),
            "entities": canonical.entries_of(table(spark, sf_dir, "domain_taxonomy"), ["label_fr", "synonyms"])}


_P2 = {"relationships": ("rel_id", "relation"), "entities": ("entity_id", "domain")}


def p2_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that is not null, not blank and not a canonical itself, with the entry meant."""
    lists, parts = _lists(spark, sf_dir), []
    for origin, (key, value) in _P2.items():
        rows = table(spark, sf_dir, origin).select(F.col(key).alias("record_id"), F.col(value).alias("value"))
        mapped = canonical.canonical_values(rows, "record_id", "value", lists[origin], keep=("value",))
        parts.append(mapped.where(F.col("canonical") != F.col("value"))  # a value that is an entry maps to itself; a blank one to null
                     .select(F.lit(origin).alias("origin"), "record_id", "value", "canonical"))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_mapped(spark, sf_dir).select("origin", "record_id", "canonical").distinct()


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that fit no entry and how many records hold them."""
    mapped = p2_mapped(spark, sf_dir)
    return mapped.where(F.col("canonical") == canonical.NONE).groupBy("origin", "value").agg(F.count("*").alias("records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "chunks")).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chunk; of repeated rows of a chunk one is taken."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "text", "page", "section").dropDuplicates(["chunk_id", "text"])
    return splitting.split_items(chunks)


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of every subject in every document."""
    return subjects.subject_shares(*(table(spark, sf_dir, t) for t in ("chunks", "source_docs", "doc_labels", "domain_taxonomy")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_shares(spark, sf_dir).where("share >= 0.2").select("source_doc", "subject")


def p4_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(p4_shares(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "vec_points")
    return neighbours.close_pairs(neighbours.nearest(points, 10, least=0.90, relax=6.0))


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumn("cosine", F.round("cosine", 6)).withColumn("rank", F.col("rank").cast("bigint"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar points of every usable point, whatever their cosine."""
    return _shown(neighbours.nearest(table(spark, sf_dir, "vec_points"), 10, relax=8.0))


def p5_neighbours_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within a domain, for the query set of ids divisible by 20."""
    points = table(spark, sf_dir, "vec_points").withColumn("domain", F.lower("domain"))
    return _shown(neighbours.nearest(points, 10, group_cols=("type", "domain"), relax=8.0, queries=F.col("vec_id") % 20 == 0))


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities in five or more common chunks, of a cosine of a half or more, with their lift."""
    return cooccurrence.pair_counts(table(spark, sf_dir, "mentions"), "chunk_id", cooccurrence.entity_key(), 5, 0.5).withColumn("lift", F.round("lift", 6))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pairs(spark, sf_dir).select("key_a", "key_b")


def p7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _lists(spark, sf_dir)["entities"]
    return variants.clusters(table(spark, sf_dir, "entities"), entries)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.same_pairs(p7_clusters(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def _p9_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts = mixing.token_counts(table(spark, sf_dir, "documents"))
    return counts, mixing.mix_plan(counts, table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p9_plan(spark, sf_dir)[1].where("short").select("source")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source was to be and what of it was drawn."""
    return mixing.mix_report(*_p9_plan(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), _p9_plan(spark, sf_dir)[1])


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fuzzy passages with how far their two extents agree."""
    docs = table(spark, sf_dir, "documents")
    found = staged(spans.passages(spans.matches(docs)), "passages")
    return spans.aligned(found, docs).drop("runs")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(spans.passages(spans.matches(table(spark, sf_dir, "documents"))))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = spans.shared_part(p10_found(spark, sf_dir), table(spark, sf_dir, "documents"))
    return shares.withColumn("n_chars", F.col("n_chars").cast("bigint")).withColumn("share", F.round("share", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_shares": p4_shares,
    "p4_composition": p4_composition,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p5_neighbours_domain": p5_neighbours_domain,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_found": p7_found,
    "p7_clusters": p7_clusters,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_mix": p9_mix,
    "p10_found": p10_found,
    "p10_passages": p10_passages,
    "p10_shares": p10_shares,
}

_P6 = """
WITH m AS (SELECT DISTINCT chunk_id, type || '::' || lower(trim(name)) AS k FROM mentions
           WHERE chunk_id IS NOT NULL AND trim(name) <> '' AND trim(type) <> ''),
n AS (SELECT k, count(*) AS n FROM m GROUP BY k),
p AS (SELECT a.k AS key_a, b.k AS key_b, count(*) AS n_ab FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.k < b.k
      GROUP BY 1, 2 HAVING count(*) >= 5)
"""

_P10 = """WITH w AS (SELECT doc_id, unnest(range(0, length(text) - 199)) AS i, text FROM documents WHERE length(text) >= 200),
    s AS (SELECT doc_id, i, md5(substr(text, i + 1, 200)) AS h FROM w),
    b AS (SELECT h FROM s GROUP BY h HAVING min(doc_id) <> max(doc_id)),
    c AS (SELECT DISTINCT doc_id, i FROM s SEMI JOIN b USING (h)),
    g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM c),
    k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM g),
    f AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM k GROUP BY doc_id, grp)
"""

SQL: dict[str, str] = {
    "p5_found": """WITH p AS (SELECT vec_id, type, CAST(embedding AS DOUBLE[64]) AS v FROM vec_points
        WHERE type IS NOT NULL AND len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
    n AS (SELECT a.vec_id AS a, b.vec_id AS b, array_cosine_similarity(a.v, b.v) AS c FROM p a JOIN p b ON a.type = b.type AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM n)
    SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE rn <= 10 AND c >= 0.90""",
    "p10_found": _P10 + "SELECT * FROM f",
    "p10_shares": _P10 + """SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(x.n, 0) AS BIGINT) AS shared_chars,
        round(CASE WHEN length(text) > 0 THEN coalesce(x.n, 0) * 1E0 / length(text) ELSE 0E0 END, 6) AS share
        FROM documents d LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS n FROM f GROUP BY 1) x USING (doc_id)""",
    "p5_neighbours_domain": """WITH p AS (SELECT vec_id, type, lower(domain) AS domain, CAST(embedding AS DOUBLE[64]) AS v FROM vec_points
        WHERE type IS NOT NULL AND domain IS NOT NULL AND len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
    n AS (SELECT a.vec_id AS id, b.vec_id AS other, array_cosine_similarity(a.v, b.v) AS c FROM p a JOIN p b ON a.type = b.type AND a.domain = b.domain AND a.vec_id <> b.vec_id
        WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 12) DESC, other) AS rn FROM n)
    SELECT id, other, round(c, 6) AS cosine, rn AS rank FROM r WHERE rn <= 10""",
    "p6_pairs": _P6 + """SELECT key_a, key_b, n_ab, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT chunk_id) FROM m) AS baskets,
        round(n_ab * (SELECT count(DISTINCT chunk_id) FROM m) / (CAST(x.n AS DOUBLE) * y.n), 6) AS lift
        FROM p JOIN n x ON x.k = key_a JOIN n y ON y.k = key_b WHERE 4 * n_ab * n_ab >= x.n * y.n""",
    "p6_found": _P6 + """SELECT key_a, key_b FROM p JOIN n x ON x.k = key_a JOIN n y ON y.k = key_b
        WHERE 4 * n_ab * n_ab >= x.n * y.n""",
}
