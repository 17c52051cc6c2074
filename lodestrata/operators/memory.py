"""Memories that change record by record, as ordered folds per key.

Steps that round or clamp are not decomposable, so each key's events are folded in order by one ``aggregate``. A key's history is bounded by
how often one alias, entity or document is seen; hot keys only make that array longer, not the shuffle larger than the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import entity_key
from ..session import staged


def _history(rows: DataFrame, key: list[str], order: list[str], *fields: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("h"))


def alias_fold(events: DataFrame, least: float = 0.93) -> DataFrame:
    """``alias_key, canonical, confidence, times_seen`` after recordings ``alias_key, canonical, confidence, seq`` in order.

    Below ``least`` nothing is recorded. The same canonical adds a sighting and keeps the higher confidence; another one replaces it only
    with a higher confidence and starts anew.
    """
    held = _history(events.where(F.col("confidence") >= least), ["alias_key"], ["seq"], "canonical", "confidence")
    start = F.struct(F.lit(None).cast("string").alias("canonical"), F.lit(0.0).alias("confidence"), F.lit(0).cast("bigint").alias("times_seen"))

    def step(s: Column, e: Column) -> Column:
        return (F.when(s["canonical"].isNull(), _alias(e["canonical"], e["confidence"], F.lit(1)))
                .when(s["canonical"] == e["canonical"], _alias(s["canonical"], F.greatest(s["confidence"], e["confidence"]), s["times_seen"] + 1))
                .when(e["confidence"] > s["confidence"], _alias(e["canonical"], e["confidence"], F.lit(1))).otherwise(s))

    return held.select("alias_key", F.aggregate("h", start, step).alias("s")).select("alias_key", "s.*")


def _alias(canonical: Column, confidence: Column, times: Column) -> Column:
    return F.struct(canonical.alias("canonical"), confidence.alias("confidence"), times.cast("bigint").alias("times_seen"))


def alias_hits(aliases: DataFrame, hits: DataFrame) -> DataFrame:
    """Aliases after lookups (``alias_key`` per hit): a sighting and a hundredth of confidence each, up to 1."""
    n = hits.groupBy("alias_key").agg(F.count("*").alias("n"))
    return aliases.join(n, "alias_key", "left").withColumn("n", F.coalesce("n", F.lit(0))).select(
        "alias_key", "canonical", F.least(F.lit(1.0), F.col("confidence") + 0.01 * F.col("n")).alias("confidence"),
        (F.col("times_seen") + F.col("n")).alias("times_seen"))


def alias_remove(aliases: DataFrame, bad: DataFrame) -> DataFrame:
    return aliases.join(bad.select("alias_key").distinct(), "alias_key", "left_anti")


def entity_fold(mentions: DataFrame) -> DataFrame:
    """``key, occurrences, confidence, aliases, domain`` of entity memories after mentions ``key, name, confidence, domain, seq`` in order.

    The confidence moves three tenths of the way to each new one; aliases append without repeats; the first domain given stays.
    """
    held = _history(mentions, ["key"], ["seq"], "name", "confidence", "domain")
    start = F.struct(F.lit(0).cast("bigint").alias("occurrences"), F.lit(None).cast("double").alias("confidence"),
                     F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("domain"))

    def step(s: Column, e: Column) -> Column:
        c = F.coalesce(e["confidence"], F.lit(0.7))
        return F.struct(
            (s["occurrences"] + 1).alias("occurrences"),
            F.when(s["confidence"].isNull(), c).otherwise(F.round(0.7 * s["confidence"] + 0.3 * c, 4)).alias("confidence"),
            F.when(e["name"].isNull() | F.array_contains(s["aliases"], e["name"]), s["aliases"]).otherwise(
                F.concat(s["aliases"], F.array(e["name"]))).alias("aliases"), F.coalesce(s["domain"], e["domain"]).alias("domain"))

    return held.select("key", F.aggregate("h", start, step).alias("s")).select("key", "s.*")


def last_descriptions(mentions: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` distinct descriptions of each key, oldest first; no more of a key's history than those is gathered."""
    last = mentions.where("description IS NOT NULL").groupBy("key", "description").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    kept = last.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "description"))).alias("d")).select("key", F.col("d.description").alias("descriptions"))


def reliability_seed(quality: Column) -> Column:
    """The reliability a document starts with."""
    q = F.coalesce(quality, F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * (0.7 + 0.3 * q)))


def reliability_fold(events: DataFrame, seeds: DataFrame) -> DataFrame:
    """``source_doc, reliability, wins, losses`` after verdicts ``source_doc, won, seq`` in order: up to 0.99 and down to 0.2 by 0.03."""
    held = _history(events, ["source_doc"], ["seq"], "won")
    whole = seeds.join(held, "source_doc", "left")
    start = F.struct(F.col("seed").alias("reliability"), F.lit(0).cast("bigint").alias("wins"), F.lit(0).cast("bigint").alias("losses"))

    def step(s: Column, e: Column) -> Column:
        r = F.when(e["won"], F.least(F.lit(0.99), s["reliability"] + 0.03)).otherwise(F.greatest(F.lit(0.2), s["reliability"] - 0.03))
        return F.struct(F.round(r, 4).alias("reliability"), (s["wins"] + F.when(e["won"], 1).otherwise(0)).alias("wins"),
                        (s["losses"] + F.when(e["won"], 0).otherwise(1)).alias("losses"))

    empty = F.coalesce("h", F.expr("filter(h, x -> false)"), F.array().cast(held.schema["h"].dataType))
    return whole.select("source_doc", F.aggregate(empty, start, step).alias("s")).select("source_doc", "s.*")


def friction_fold(events: DataFrame, least_count: int = 4, examples: int = 5) -> DataFrame:
    """``key, count, avg_confidence, landing, raw_examples, status`` of relation patterns that landed badly, from ``key, raw, confidence, landing, seq``.

    The mean is rounded at every step; up to ``examples`` distinct spellings are kept; from ``least_count`` on a pattern awaits review.
    """
    held = _history(events, ["key"], ["seq"], "raw", "confidence", "landing")
    start = F.struct(F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("avg_confidence"), F.lit(None).cast("string").alias("landing"),
                     F.array().cast("array<string>").alias("raw_examples"))

    def step(s: Column, e: Column) -> Column:
        n = s["count"] + 1
        more = ~F.array_contains(s["raw_examples"], e["raw"]) & (F.size(s["raw_examples"]) < examples)
        return F.struct(n.alias("count"), F.round((s["avg_confidence"] * s["count"] + e["confidence"]) / n, 4).alias("avg_confidence"),
                        e["landing"].alias("landing"), F.when(more, F.concat(s["raw_examples"], F.array(e["raw"]))).otherwise(s["raw_examples"]).alias("raw_examples"))

    out = held.select("key", F.aggregate("h", start, step).alias("s")).select("key", "s.*")
    return out.withColumn("status", F.when(F.col("count") >= least_count, "pending_review").otherwise("collecting"))


def review(friction: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Friction after decisions ``key, decision, canonical`` and the synonyms that approvals add (every spelling seen)."""
    joined = friction.join(decisions.groupBy("key").agg(F.min("decision").alias("decision"), F.min("canonical").alias("canonical")), "key", "left")
    after = joined.withColumn("status", F.coalesce(F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected"), "status"))
    synonyms = after.where("status = 'approved'").select(F.explode("raw_examples").alias("raw"), "canonical").distinct()
    return after.drop("decision", "canonical"), synonyms


def friction_summary(friction: DataFrame, top: int = 5) -> DataFrame:
    """``status, patterns, events, top``: counts by status, and the most frequent patterns (``key:count``) that await review."""
    first = friction.where("status = 'pending_review'").orderBy(F.desc("count"), "key").limit(top).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "key"))).alias("f")).select(
        F.transform("f", lambda x: F.concat(x["key"], F.lit(":"), (-x["n"]).cast("string"))).alias("top"))
    sums = friction.groupBy("status").agg(F.count("*").alias("patterns"), F.sum("count").alias("events"))
    return sums.join(F.broadcast(first), F.col("status") == "pending_review", "left")  # one row


def evidence_merge(rows: DataFrame, most: int = 50) -> DataFrame:
    """Evidence of each target: one record per document and chunk (the first by ``seq``), beyond ``most`` the most confident."""
    first = Window.partitionBy("target", "source_doc", "chunk_id").orderBy("seq")
    once = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    best = Window.partitionBy("target").orderBy(F.desc("confidence"), "seq")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def reinforced(rows: DataFrame, bump: float = 0.05) -> DataFrame:
    """Confidence of each target after its evidence: the first record's and ``bump`` for each further one, up to 1."""
    once = rows.groupBy("target", "source_doc", "chunk_id").agg(F.min_by("confidence", "seq").alias("confidence"), F.min("seq").alias("seq"))
    return once.groupBy("target").agg(F.min_by("confidence", "seq").alias("first"), F.count("*").alias("records")).select(
        "target", "records", F.least(F.lit(1.0), F.col("first") + bump * (F.col("records") - 1)).alias("confidence"))


def pair_counts(mentions: DataFrame, least: int = 1, crowd: int = 200) -> DataFrame:
    """``key_a, key_b, count, docs`` of entities listed in one chunk, from ``chunk_id, key, source_doc``.

    Keys in fewer than ``least`` chunks can be in no pair that counts and go first. In chunks of at most ``crowd`` keys a chunk's pairs are made from its
    sorted list, which that bounds, inside one stage, and are combined before the shuffle. Longer chunks are counted by joining their rows, so no list of
    theirs is ever gathered.
    """
    once = mentions.where("key IS NOT NULL AND chunk_id IS NOT NULL").groupBy("chunk_id", "key").agg(F.min("source_doc").alias("source_doc"))
    if least > 1:
        once = staged(once, "mentions")
        often = once.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")
        once = once.join(often, "key", "left_semi")
    once = staged(once, "listed")
    sizes = once.groupBy("chunk_id").agg(F.count("*").alias("n"))
    long = staged(sizes.where(F.col("n") > crowd).select("chunk_id"), "crowds")
    lists = once.join(long, "chunk_id", "left_anti").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("key", "source_doc"))).alias("k")).where(F.size("k") > 1)
    first = lists.select("chunk_id", "k", F.posexplode("k").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("k", F.col("i") + 2, F.size("k"))).alias("b")).select(
        F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"), F.col("a.source_doc").alias("source_doc"))
    crowded = once.join(long, "chunk_id", "left_semi")
    a, b = crowded.alias("a"), crowded.alias("b")
    pairs = pairs.unionByName(a.join(b, (F.col("a.chunk_id") == F.col("b.chunk_id")) & (F.col("a.key") < F.col("b.key"))).select(
        F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"), F.col("a.source_doc").alias("source_doc")))
    by_doc = pairs.groupBy("key_a", "key_b", "source_doc").agg(F.count("*").alias("n"))
    out = by_doc.groupBy("key_a", "key_b").agg(F.sum("n").alias("count"), F.count("source_doc").alias("docs"))
    return out.where(F.col("count") >= least) if least > 1 else out


def unlinked_pairs(pairs: DataFrame, edges: DataFrame, least: int = 4) -> DataFrame:
    """Pairs (``name_a, name_b, count``) seen often together without any edge between them, either way."""
    linked = edges.select(F.least("src", "dst").alias("name_a"), F.greatest("src", "dst").alias("name_b")).distinct()
    often = pairs.where(F.col("count") >= least).select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b"), "count")
    return often.join(linked, ["name_a", "name_b"], "left_anti").orderBy(F.desc("count"), "name_a", "name_b")


def alias_audit(aliases: DataFrame, below: float = 0.95) -> DataFrame:
    """Aliases under a confidence, the least sure first; one row an alias."""
    return aliases.where(F.col("confidence") < below).groupBy("alias_key").agg(F.min_by("canonical", "confidence").alias("canonical"), F.min("confidence").alias("confidence")).orderBy(
        "confidence", "alias_key")


def hydrate(entities: DataFrame) -> DataFrame:
    """Entity memories from stored nodes: ``key, confidence, occurrences, description``; a missing or zero confidence is 0.7."""
    held = entities.where("name IS NOT NULL AND type IS NOT NULL").withColumn("key", entity_key("type", "name"))
    return held.groupBy("key").agg(F.max(F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.7))).alias("confidence"), F.count("*").alias("occurrences"),
                                   F.max(F.coalesce("description", F.lit(""))).alias("description"))


def reliability_of(asked: DataFrame, known: DataFrame, default: float = 0.7) -> DataFrame:
    """``source_doc, reliability`` of every document asked for; unknown ones have the default."""
    return asked.select("source_doc").distinct().join(known, "source_doc", "left").select("source_doc", F.coalesce("reliability", F.lit(default)).alias("reliability"))


def top_unlinked(unlinked: DataFrame, n: int = 20) -> DataFrame:
    """The pairs seen together most often without an edge."""
    return unlinked.orderBy(F.desc("count"), "name_a", "name_b").limit(n)
