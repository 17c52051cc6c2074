"""Contradictions between documents: candidates, their claims, verdicts and what follows from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cosine
from ..session import staged
from . import graph


def candidates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New entities against existing ones of the same name and type from another document; two empty descriptions are no candidate."""
    a = new.select("name", "type", F.col("entity_id").alias("new_id"), F.col("source_doc").alias("new_doc"), F.coalesce("description", F.lit("")).alias("new_description"))
    b = existing.select("name", "type", F.col("entity_id").alias("old_id"), F.col("source_doc").alias("old_doc"), F.coalesce("description", F.lit("")).alias("old_description"))
    pairs = a.join(b, ["name", "type"])
    return pairs.where(~F.col("new_doc").eqNullSafe(F.col("old_doc")) & ((F.col("new_description") != "") | (F.col("old_description") != "")))


def rank_claims(names: DataFrame, claims: DataFrame, k: int = 10, epsilon: float = 1e-8) -> DataFrame:
    """The ``k`` claims of its own document most like each entity: equi-join on the document, ranked by cosine."""
    joined = names.join(claims, "source_doc").withColumn("score", cosine("vector", "embedding", epsilon))
    w = Window.partitionBy("entity_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("entity_id", "vec_id", "score", "rank")


def claims_or_any(asked: DataFrame, points: DataFrame, claims: int = 10, anything: int = 8) -> DataFrame:
    """The best claims of each document asked for, or where it has none the best points of any kind (by confidence)."""
    rows = points.join(asked.select("source_doc").distinct(), "source_doc", "left_semi")
    w = Window.partitionBy("source_doc").orderBy(F.desc_nulls_last("confidence"), "vec_id")
    own = rows.where("type = 'claim'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= claims)
    rest = rows.join(own.select("source_doc").distinct(), "source_doc", "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= anything)
    return own.unionByName(rest).select("source_doc", "vec_id", "rank")


NO_CLAIMS = "No claims found"
INSTRUCTION = ("Go through the claims of both sources one attribute at a time. Say whether they give different values for the same attribute, and whether a claim says that it "
               "corrects or replaces an earlier one.")


def claims_for(asked: DataFrame, points: DataFrame, claims: int = 10, anything: int = 8) -> DataFrame:
    """``name, source_doc, claims``: of each name in a document the claims most like it as lines, or where the document has no claims its other texts.

    ``asked`` has ``name, source_doc, vector``; ``points`` has ``vec_id, source_doc, type, embedding, text``. An equi-join on the document.
    """
    own = points.where("type = 'claim'")
    pool = own.withColumn("most", F.lit(claims)).unionByName(
        points.join(own.select("source_doc").distinct(), "source_doc", "left_anti").withColumn("most", F.lit(anything)))
    scored = asked.join(pool.select("vec_id", "source_doc", "embedding", "text", "most"), "source_doc").where(F.size("vector") == F.size("embedding"))
    scored = scored.withColumn("score", F.round(cosine("vector", "embedding", 1e-8), 12))
    w = Window.partitionBy("name", "source_doc").orderBy(F.desc("score"), "vec_id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("most"))
    lists = best.groupBy("name", "source_doc").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("l"))
    return lists.select("name", "source_doc", F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("claims"))


def with_claims(conflicts: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates with ``old_claims`` and ``new_claims`` (``claims`` from :func:`claims_for`)."""
    side = lambda doc, out: claims.select("name", F.col("source_doc").alias(doc), F.col("claims").alias(out))
    joined = conflicts.join(side("old_doc", "old_claims"), ["name", "old_doc"], "left").join(side("new_doc", "new_claims"), ["name", "new_doc"], "left")
    return joined.na.fill({"old_claims": NO_CLAIMS, "new_claims": NO_CLAIMS})


def prompt(conflicts: DataFrame) -> DataFrame:
    """The comparison that a judge is asked, as text: both descriptions, the claims of both sides and what to do."""
    return conflicts.withColumn("prompt", F.format_string(
        "Entity: %s (type: %s)\n\nSource 1 - %s:\nDescription: \"%s\"\nRelevant claims:\n%s\n\nSource 2 - %s:\nDescription: \"%s\"\nRelevant claims:\n%s\n\n" + INSTRUCTION,
        "name", "type", F.coalesce("old_doc", F.lit("unknown")), "old_description", "old_claims", F.coalesce("new_doc", F.lit("unknown")), "new_description", "new_claims"))


@dataclass
class Reconciled:
    """What follows from comparing new entities with known ones."""

    verdicts: DataFrame
    entities: DataFrame
    edges: DataFrame
    reliability: DataFrame
    summary: DataFrame


def reconcile(new: DataFrame, existing: DataFrame, claims: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> Reconciled:
    """Candidates, their claims, the judge's verdicts and their effects: losers are superseded, open conflicts become edges, documents win and lose.

    ``judge`` adds ``verdict`` to rows with ``prompt`` and both sides; a null verdict is UNVERIFIED and is kept as an open conflict.
    """
    asked = prompt(with_claims(candidates(new, existing), claims))
    verdicts = staged(judge(asked).withColumn("verdict", F.coalesce("verdict", F.lit("UNVERIFIED"))), "verdicts")
    lost = verdicts.where("verdict = 'KEEP_DOC2'").select("name", "type", F.col("old_doc").alias("loser"), F.col("new_doc").alias("winner"))
    open_ones = verdicts.where(F.col("verdict").isin("KEEP_BOTH", "FLAG", "MERGE", "UNVERIFIED"))
    edges = open_ones.select(F.col("name").alias("src"), F.col("name").alias("dst"), F.col("new_doc").alias("src_doc"), F.col("old_doc").alias("dst_doc")).distinct().select(
        "*", F.lit("CONFLICTS_WITH").alias("rel_type"), F.lit(0.5).alias("confidence"))
    events = reliability_events(verdicts.withColumn("seq", F.struct("new_id", "old_id")))
    return Reconciled(verdicts, graph.supersede(existing, lost), edges, events, outcomes(verdicts))


def outcomes(verdicts: DataFrame) -> DataFrame:
    """One row of counts over verdicts (``verdict``: KEEP_DOC1, KEEP_DOC2, KEEP_BOTH, FLAG, MERGE, UNVERIFIED)."""
    n = lambda *v: F.count(F.when(F.col("verdict").isin(*v), 1))
    return verdicts.agg(F.count("*").alias("found"), n("KEEP_DOC1", "KEEP_DOC2").alias("resolved"),
                        n("KEEP_BOTH", "FLAG", "MERGE").alias("flagged"), n("UNVERIFIED").alias("unverified"))


def reliability_events(verdicts: DataFrame) -> DataFrame:
    """A win and a loss for each verdict that decides between two documents."""
    won = F.when(F.col("verdict") == "KEEP_DOC1", F.struct(F.col("old_doc").alias("w"), F.col("new_doc").alias("l"))).when(
        F.col("verdict") == "KEEP_DOC2", F.struct(F.col("new_doc").alias("w"), F.col("old_doc").alias("l")))
    both = verdicts.withColumn("x", won).where("x IS NOT NULL")
    return both.select(F.col("x.w").alias("source_doc"), F.lit(True).alias("won"), "seq").unionByName(
        both.select(F.col("x.l").alias("source_doc"), F.lit(False).alias("won"), "seq")).where("source_doc IS NOT NULL")
