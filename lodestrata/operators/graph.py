"""Entities and edges as DataFrames: endpoint joins, trails, upserts, rewrites and statistics.

Edges have ``edge_id, src, dst, rel_type, confidence``. Trails never use an edge twice but may pass a node twice, as in pattern
matching over relationships. Filters on edges are applied before the first join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

MOST_HOPS = 3


def link_endpoints(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships whose two endpoints exist by name and type; the others are dropped. No endpoint multiplies a row."""
    known = entities.where("name IS NOT NULL AND type IS NOT NULL").select("name", "type").distinct()
    src = known.select(F.col("name").alias("from_name"), F.col("type").alias("from_type"))
    dst = known.select(F.col("name").alias("to_name"), F.col("type").alias("to_type"))
    return rels.join(src, ["from_name", "from_type"], "left_semi").join(dst, ["to_name", "to_type"], "left_semi")


def usable_edges(edges: DataFrame, least: float = 0.0, exclude: list[str] | None = None) -> DataFrame:
    """Edges of ``least`` confidence whose type is not excluded; a null confidence is below every floor."""
    kept = edges.where(F.coalesce(F.col("confidence") >= least, F.lit(False)) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return kept.where(~F.col("rel_type").isin(exclude)) if exclude else kept


def neighbors(edges: DataFrame, anchors: DataFrame, hops: int = 2, least: float = 0.0, exclude: list[str] | None = None,
              trails: int | None = None, facts: int | None = None) -> DataFrame:
    """``anchor, related, chain array<string>, score, hops`` of every trail of 1 to ``hops`` edges from each anchor, either direction.

    ``anchors`` has a column ``anchor``; hops are clamped to 1..3. The score is the product of the edges' confidences.

    Where only the best are asked for, ``trails`` (the best trails of an anchor) or ``facts`` (the best related nodes of an anchor) says how many; then a trail is followed no
    further once it cannot come among them: longer trails score no higher (times the largest confidence, should one exceed 1), and of equals the shorter goes
    first. All trails that do come among them are in the result, so the best of it are the best of all.
    """
    hops = max(1, min(MOST_HOPS, hops))
    kept = usable_edges(edges, least, exclude).select(F.col("edge_id").cast("string").alias("edge_id"), "src", "dst", "rel_type", "confidence")
    ways = kept.select("edge_id", F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type", "confidence").unionByName(
        kept.where("src <> dst").select("edge_id", F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type", "confidence"))
    front = anchors.select("anchor").distinct().select(
        "anchor", F.col("anchor").alias("at"), F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("chain"),
        F.lit(1.0).alias("score"))
    pruned = hops > 1 and (trails is not None or facts is not None)
    if pruned:
        ways = staged(ways, "ways")
        most = max(1.0, ways.agg(F.max("confidence")).head()[0] or 1.0)
    found = None
    for n in range(1, hops + 1):
        step = front.join(ways, front["at"] == ways["a"]).where(~F.array_contains("used", F.col("edge_id")))
        front = step.select("anchor", F.col("b").alias("at"), F.concat("used", F.array("edge_id")).alias("used"),
                            F.concat("chain", F.array("rel_type")).alias("chain"), (F.col("score") * F.col("confidence")).alias("score"))
        if pruned and n < hops:
            front = staged(front, "trails")
        here = front.select("anchor", F.col("at").alias("related"), "chain", "score", F.lit(n).alias("hops")).where("related <> anchor")
        found = here if found is None else found.unionByName(here)
        if pruned and n < hops:
            front = front.join(_floors(found, trails, facts), "anchor", "left").where(
                F.col("floor").isNull() | (F.col("score") * most ** (hops - n) >= F.col("floor") - 1e-9)).drop("floor")
    return found.distinct()


def _floors(found: DataFrame, trails: int | None, facts: int | None) -> DataFrame:
    """``anchor, floor``: the score of the last that would count so far, for anchors that have so many."""
    rows, n = (found.distinct(), trails) if trails is not None else (found.groupBy("anchor", "related").agg(F.max("score").alias("score")), facts)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"))
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") == n).select("anchor", F.col("score").alias("floor"))


def top_paths(found: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` best trails of each anchor; ties by hops, name and chain."""
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "hops", "related", F.array_join("chain", ">"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def best_paths(found: DataFrame) -> DataFrame:
    """The best trail of each anchor and related node, without the anchor itself."""
    best = F.min_by(F.struct("chain", "score", "hops"), F.struct(-F.round("score", 12), "hops", F.array_join("chain", ">")))
    return found.where("related <> anchor").groupBy("anchor", "related").agg(best.alias("b")).select("anchor", "related", "b.*")


def top_facts(facts: DataFrame, most: int = 20) -> DataFrame:
    return facts.orderBy(F.desc("score"), "hops", "anchor", "related").limit(most)


def conflict_edges(edges: DataFrame, entities: DataFrame, rel_type: str = "CONFLICTS_WITH") -> DataFrame:
    """Both ends of every conflict edge, with the documents they come from."""
    kept = edges.where(F.col("rel_type") == rel_type)
    a = entities.select(F.col("name").alias("src"), F.col("source_doc").alias("doc1"))
    b = entities.select(F.col("name").alias("dst"), F.col("source_doc").alias("doc2"))
    return kept.join(a, "src").join(b, "dst").select(F.col("src").alias("entity"), F.col("dst").alias("other"), "doc1", "doc2")


def keyword_match(entities: DataFrame, edges: DataFrame, question: str, words: int = 5, per_word: int = 5, rels: int = 3) -> DataFrame:
    """Entities whose name holds one of the question's first long words, each with its first out-edges (none is fine)."""
    long = [w for w in question.lower().split() if len(w) > 4][:words]
    spark = entities.sparkSession
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(long)], "n int, word string")
    hits = entities.join(F.broadcast(asked), F.lower("name").contains(F.col("word")))
    order = Window.partitionBy("n").orderBy(F.desc("confidence"), "name", "type", F.coalesce("domain", F.lit("")), "entity_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_word)
    out = edges.select("src", F.concat("rel_type", F.lit(" -> "), "dst").alias("line"))
    lines = hits.join(out, hits["name"] == out["src"], "left").groupBy("n", "word", "entity_id", "name", "type", "source_doc", "confidence").agg(
        F.slice(F.array_sort(F.collect_set("line")), 1, rels).alias("relationships"))
    return lines


def upsert_entities(old: DataFrame, batch: DataFrame, key: tuple[str, ...] = ("name", "type", "domain"), bump: float = 0.05) -> DataFrame:
    """``key, confidence, source_doc, seen``: nodes after a batch.

    A known node seen with new evidence (another source) gains ``bump`` up to 1; with known evidence it keeps its confidence. A new one has the
    batch's. Keys compare null-safely. Of several rows of a key the first by source counts; each source of a batch bumps once.

    Rows are combined by key and source, then by key: no node gathers its sources, however many it has.
    """
    side = lambda df, new: df.select(*key, "source_doc", "confidence", F.lit(new).alias("__new"))
    of = lambda new, c: F.max(F.when(F.col("__new") == new, c))
    by_source = side(old, False).unionByName(side(batch, True)).groupBy(*key, "source_doc").agg(
        F.bool_or(~F.col("__new")).alias("__had"), F.bool_or("__new").alias("__got"), of(False, F.col("confidence")).alias("__oc"), of(True, F.col("confidence")).alias("__bc"))
    known = F.col("source_doc").isNotNull()
    whole = by_source.groupBy(*key).agg(
        F.max("__oc").alias("__oc"), F.max("__bc").alias("__bc"), F.count(F.when(known & F.col("__got") & ~F.col("__had"), 1)).alias("__fresh"),
        F.count(F.when(known, 1)).cast("int").alias("seen"), F.max(F.when(F.col("__got"), F.col("source_doc"))).alias("__bd"),
        F.max(F.when(F.col("__had"), F.col("source_doc"))).alias("__od"))
    confidence = F.when(F.col("__oc").isNull(), F.col("__bc")).when(F.col("__bc").isNull(), F.col("__oc")).otherwise(
        F.least(F.lit(1.0), F.col("__oc") + bump * F.col("__fresh")))
    return whole.select(*key, confidence.alias("confidence"), F.coalesce("__bd", "__od").alias("source_doc"), "seen")


def upsert_edges(old: DataFrame, batch: DataFrame, first_bump: bool = True, bump: float = 0.05) -> DataFrame:
    """Edges after a batch, by ``src, dst, rel_type``; ``created_at`` is kept, and with ``first_bump`` a first sight gains too."""
    key = ["src", "dst", "rel_type"]
    held = old.groupBy(*key).agg(F.max("confidence").alias("old_confidence"), F.min("at").alias("created_at"))
    new = batch.groupBy(*key).agg(F.max("confidence").alias("new_confidence"), F.max("at").alias("updated_at"))
    grown = F.least(F.lit(1.0), F.coalesce("old_confidence", "new_confidence") + bump)
    confidence = (F.when(F.col("new_confidence").isNull(), F.col("old_confidence"))
                  .when(F.col("old_confidence").isNull() & F.lit(not first_bump), F.col("new_confidence")).otherwise(grown))
    return held.join(new, key, "full_outer").select(
        *key, confidence.alias("confidence"), F.coalesce("created_at", "updated_at").alias("created_at"),
        F.coalesce("updated_at", "created_at").alias("last_updated"))


def tag_domain(entities: DataFrame, tags: DataFrame) -> DataFrame:
    """Entities with the domain that ``tags`` (name, type, new_domain) give them."""
    own = tags.groupBy("name", "type").agg(F.min("new_domain").alias("new_domain"))
    return entities.join(own, ["name", "type"], "left").withColumn("domain", F.coalesce("new_domain", "domain")).drop("new_domain")


def flag(entities: DataFrame, condition: Column, factor: float = 0.7) -> DataFrame:
    """Flags rows and lowers their confidence."""
    hit = F.coalesce(condition, F.lit(False))
    return entities.withColumn("flagged", hit).withColumn("confidence", F.when(hit, F.col("confidence") * factor).otherwise(F.col("confidence")))


def supersede(entities: DataFrame, verdicts: DataFrame, factor: float = 0.6) -> DataFrame:
    """Where the newer document won (``name, type, loser, winner``), the loser's node loses confidence and names its successor."""
    lost = verdicts.groupBy("name", "type", F.col("loser").alias("source_doc")).agg(F.min("winner").alias("superseded_by"))
    out = entities.join(lost, ["name", "type", "source_doc"], "left")
    return out.withColumn("confidence", F.when(F.col("superseded_by").isNotNull(), F.col("confidence") * factor).otherwise(F.col("confidence")))


def append_edges(pairs: DataFrame, rel_type: str, confidence: float) -> DataFrame:
    """New edges of one type and confidence for ``src, dst``; conflict edges (0.5) and links across domains (0.4) come so."""
    return pairs.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().select(
        "src", "dst", F.lit(rel_type).alias("rel_type"), F.lit(confidence).alias("confidence"))


def merge_nodes(entities: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after names are mapped to canonical ones (``name, canonical``); edges that fall together keep the best."""
    m = mapping.groupBy("name").agg(F.min("canonical").alias("canonical"))
    nodes = entities.join(m, "name", "left").withColumn("name", F.coalesce("canonical", "name")).groupBy("name", "type").agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("merged"))
    src = m.select(F.col("name").alias("src"), F.col("canonical").alias("s"))
    dst = m.select(F.col("name").alias("dst"), F.col("canonical").alias("d"))
    moved = edges.join(src, "src", "left").join(dst, "dst", "left").select(
        F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "rel_type", "confidence")
    return nodes, moved.groupBy("src", "dst", "rel_type").agg(F.max("confidence").alias("confidence"))


def graph_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, mean confidence and edges; zeros on an empty graph. Two one-row aggregates side by side."""
    nodes = entities.agg(F.count("*").alias("entities"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.lit(1).alias("k"))
    return nodes.join(edges.agg(F.count("*").alias("relationships"), F.lit(1).alias("k")), "k").drop("k")


def count_by(rows: DataFrame, column: str, name: str = "entity_count") -> DataFrame:
    """Rows by a non-null column, most first."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def type_stats(entities: DataFrame) -> DataFrame:
    """Count and mean confidence by type; a missing type is UNKNOWN, a missing confidence 0."""
    return entities.groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("type")).agg(
        F.count("*").alias("entities"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"))


def degrees(rels: DataFrame) -> DataFrame:
    """How many relationship ends each name has."""
    return rels.select(F.explode(F.array("from_name", "to_name")).alias("name")).where("name IS NOT NULL").groupBy("name").agg(
        F.count("*").alias("degree"))


def all_entities(entities: DataFrame, limit: int = 10_000) -> DataFrame:
    """Six columns of the first ``limit`` entities by name."""
    return entities.orderBy(F.asc_nulls_last("name"), "type", "entity_id").limit(limit).select("name", "type", "domain", "confidence", "source_doc", "last_updated")


def without_loops(edges: DataFrame) -> DataFrame:
    """Edges between different nodes."""
    return edges.where("src <> dst")
