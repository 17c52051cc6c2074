"""Curation: decay, stale nodes, conflicts, the learning report and the digest's text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import alias_curve, decayed
from ..session import staged
from . import graph


def decay(entities: DataFrame, now: Column) -> DataFrame:
    """Entities with decayed confidence and whether that changed anything."""
    after = decayed("confidence", "last_updated", now)
    return entities.withColumn("decayed", after).withColumn("changed", F.coalesce(F.col("decayed") != F.col("confidence"), F.lit(False)))


def stale(entities: DataFrame, below: float = 0.3) -> DataFrame:
    return entities.where(F.col("confidence") < below).orderBy("confidence", "entity_id")


def top_entities(entities: DataFrame, n: int = 10) -> DataFrame:
    """The most confident entities that are not flagged."""
    kept = entities.where(~F.coalesce(F.col("flagged"), F.lit(False))) if "flagged" in entities.columns else entities
    return kept.where("confidence IS NOT NULL").orderBy(F.desc("confidence"), "name", "entity_id").limit(n)


def learn(aliases: DataFrame) -> DataFrame:
    """Aliases after a round of learning: the curve for those seen more than once, only upwards."""
    grown = F.when(F.col("times_seen") > 1, alias_curve("confidence", "times_seen")).otherwise(F.col("confidence"))
    return aliases.withColumn("learned", grown).withColumn("reinforced", F.col("learned") > F.col("confidence"))


def learning_report(aliases: DataFrame, unlinked: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: reinforced aliases, unlinked pairs, entity types and entities."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("k", F.lit(1))
    return (one(learn(aliases), F.count(F.when(F.col("reinforced"), 1)).alias("aliases_reinforced"))
            .join(one(unlinked, F.count("*").alias("unlinked_pairs")), "k")
            .join(one(stats, F.count("*").alias("types"), F.coalesce(F.sum("entities"), F.lit(0)).alias("entities")), "k").drop("k"))


@dataclass
class Curation:
    """What a curation run gives: the entities after it, one row of counts and the digest."""

    entities: DataFrame
    summary: DataFrame
    digest: DataFrame


def run(entities: DataFrame, edges: DataFrame, aliases: DataFrame, unlinked: DataFrame, at: str, conflict: str = "CONFLICTS_WITH",
        below: float = 0.3) -> Curation:
    """A whole curation: decay, then stale nodes, statistics, conflicts, top entities, sources and learning of what is left, and the digest of it all."""
    moved = decay(entities, F.lit(at).cast(entities.schema["last_updated"].dataType))
    after = staged(moved.withColumn("confidence", F.col("decayed")).drop("decayed"), "curated")
    unlinked, edges = staged(unlinked, "unlinked"), staged(edges, "edges")
    conflicts = staged(graph.conflict_edges(edges, after, conflict), "conflicts")
    stats, learned = graph.type_stats(after), learning_report(aliases, unlinked, graph.type_stats(after))
    one = lambda df, *aggs: df.agg(*aggs).withColumn("k", F.lit(1))
    summary = (one(after, F.count("*").alias("entities"), F.count(F.when(F.col("changed"), 1)).alias("decayed"), F.count(F.when(F.col("confidence") < below, 1)).alias("stale"))
               .join(one(edges, F.count("*").alias("relationships")), "k").join(one(conflicts, F.count("*").alias("conflicts")), "k")
               .join(learned.select("aliases_reinforced", "unlinked_pairs").withColumn("k", F.lit(1)), "k").drop("k"))
    return Curation(after, summary, digest(after, edges, conflicts, stale(after, below), unlinked, stats))


def digest(entities: DataFrame, edges: DataFrame, conflicts: DataFrame, low: DataFrame, unlinked: DataFrame, stats: DataFrame, top: int = 10) -> DataFrame:
    """``part, rank, line``: the digest's sections; within a section lines go by ``rank``. An empty section of findings says ``None``."""
    whole = graph.graph_stats(entities, edges)
    name = lambda c: F.coalesce(c, F.lit(""))
    ranked = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # noqa: E731 - short lists only
    line = lambda part, df, rank, text: df.select(F.lit(part).alias("part"), rank.cast("string").alias("rank"), text.alias("line"))

    def or_none(part: str, df: DataFrame, rank, text) -> DataFrame:
        empty = df.agg(F.count("*").alias("n")).where("n = 0")
        return line(part, df, rank, text).unionByName(line(part, empty, F.lit(""), F.lit("None")))

    sources = graph.count_by(entities, "source_doc")
    known = entities.groupBy(F.col("name").alias("entity"), F.col("source_doc").alias("doc1")).agg(F.max("type").alias("type"))
    disputed = conflicts.join(known, ["entity", "doc1"], "left")
    best = ranked(top_entities(entities, top), F.desc("confidence"), "name", "entity_id")
    pairs = ranked(unlinked.orderBy(F.desc("count"), "name_a", "name_b").limit(5), F.desc("count"), "name_a", "name_b")
    parts = [
        line("statistics", whole, F.lit(1), F.format_string("Total Entities: %d", "entities")),
        line("statistics", whole, F.lit(2), F.format_string("Total Relationships: %d", "relationships")),
        line("statistics", whole, F.lit(3), F.format_string("Average Confidence: %.2f", "avg_confidence")),
        line("sources", sources, F.lpad((F.lit(10 ** 12) - F.col("entity_count")).cast("string"), 14, "0"), F.format_string("- %s (%d entities)", "source_doc", "entity_count")),
        or_none("conflicts", disputed, F.col("entity"), F.format_string(
            "- [%s] %s: %s vs %s", F.coalesce("type", F.lit("UNKNOWN")), "entity", F.coalesce("doc1", F.lit("unknown")), F.coalesce("doc2", F.lit("unknown")))),
        or_none("stale", low, F.format_string("%.6f", "confidence"), F.format_string("- %s (%s) confidence:%.2f", name("name"), F.coalesce("type", F.lit("UNKNOWN")), "confidence")),
        line("top", best, F.lpad(F.col("rank").cast("string"), 4, "0"), F.format_string("- [%s] %s (confidence:%.2f, source:%s)", "type", "name", "confidence", "source_doc")),
        or_none("unlinked", pairs, F.col("rank"), F.format_string("- %s <-> %s (seen together %dx)", "name_a", "name_b", "count")),
        line("types", stats, F.col("type"), F.format_string("- %s: %d entities, avg confidence %.4f", "type", "entities", "avg_confidence"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_digest(lines: DataFrame, path: str) -> None:
    """The digest as one text file in a folder; it is a page long."""
    order = F.array_position(F.array(*[F.lit(p) for p in ("statistics", "sources", "conflicts", "stale", "top", "unlinked", "types")]), F.col("part"))
    lines.coalesce(1).sortWithinPartitions(order, "rank", "line").select("line").write.mode("overwrite").text(path)


def written_digest(lines: DataFrame, writers: list) -> str:
    """The digest as text by the first writer (a function of the lines as one text) that answers; without one the lines themselves.

    The lines of a digest are top lists and counts but for its sources, conflicts and stale nodes, of which ``MOST_LINES`` a part are shown.
    """
    order = Window.partitionBy("part").orderBy("rank", "line")
    shown = lines.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= MOST_LINES)
    text = "\n".join(f"{r.part}: {r.line}" for r in shown.orderBy("part", "__n").collect())
    for write in writers:
        try:
            return write(text)
        except Exception as e:
            print(f"a digest writer failed: {e}")
    return text


#: Lines of one part of a written digest.
MOST_LINES = 200
