"""Hybrid retrieval: graph facts around linked entities and the most similar texts, and the context made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import format_fact, format_hit
from . import graph, vector

REFUSAL = "I don't have enough information in the knowledge base to answer this question."


def graph_facts(edges: DataFrame, anchors: DataFrame, hops: int = 2, least: float = 0.4, exclude: list[str] | None = None, most: int = 20) -> DataFrame:
    """The best trail to each related node, the ``most`` best of all: ``anchor, related, chain, score, hops``."""
    return graph.top_facts(graph.best_paths(graph.neighbors(edges, anchors, hops, least, exclude, facts=most)), most)


def text_hits(points: DataFrame, query: DataFrame, k: int = 8, **filters: str) -> DataFrame:
    """The ``k`` texts most like a question's vector among those the payload filter lets through."""
    return vector.topk(points.where(vector.payload_filter(**filters)), query, k)


def retrieve(edges: DataFrame, points: DataFrame, anchors: DataFrame, query: DataFrame, hops: int = 2, k: int = 8, most: int = 20,
             exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    return graph_facts(edges, anchors, hops, 0.4, exclude, max(1, min(50, most))), text_hits(points, query, k)


def numbered_facts(facts: DataFrame, types: DataFrame) -> DataFrame:
    """``number, line`` of facts as they are cited; facts are a capped list."""
    known = types.groupBy(F.col("name").alias("related")).agg(F.min("type").alias("related_type"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "hops", "anchor", "related")  # at most 50 rows
    rows = facts.join(known, "related", "left").withColumn("number", F.row_number().over(w))
    return rows.select("number", format_fact("number", "anchor", "chain", "related", F.coalesce("related_type", F.lit("UNKNOWN")), "score").alias("line"))


def numbered_hits(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("rank").alias("number"), format_hit("rank", "source_doc", "page", "text").alias("line"))


def context(lines: dict[str, DataFrame]) -> DataFrame:
    """Headed sections as one column of lines: ``section, number, line``; an empty section says so."""
    out = None
    for i, (head, df) in enumerate(lines.items()):
        own = df.select(F.lit(i).alias("section"), "number", "line")
        title = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("section"), F.lit(0).alias("number"), F.concat(
            F.lit(head), F.when(F.col("n") == 0, "\n(none)").otherwise("")).alias("line"))
        part = title.unionByName(own)
        out = part if out is None else out.unionByName(part)
    return out


def grounded(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: whether there is anything to answer from, and the fixed refusal where there is not."""
    n = facts.agg(F.count("*").alias("facts"), F.lit(1).alias("k")).join(hits.agg(F.count("*").alias("hits"), F.lit(1).alias("k")), "k").drop("k")
    return n.withColumn("answer", F.when((F.col("facts") == 0) & (F.col("hits") == 0), REFUSAL))


def ask(question: str, edges: DataFrame, points: DataFrame, nodes: DataFrame, aliases: DataFrame, carried: list[str] | None = None, k: int = 8,
        hops: int = 2) -> tuple[list[str], DataFrame]:
    """``(mentions, numbered lines)`` for a question: mentions (or those carried over from the turn before), links, facts and passages."""
    from .. import providers
    from . import resolve

    spark = edges.sparkSession
    found = providers.mentions(question) or list(carried or [])
    asked = spark.createDataFrame([(i, m) for i, m in enumerate(found)], "mention_id long, mention string")
    anchors = resolve.link_mentions(asked, nodes, aliases).select(F.col("entity").alias("anchor")).distinct()
    vector_of = spark.createDataFrame([(0, providers.hashed_vector(question))], "query_id long, embedding array<double>")
    facts, hits = retrieve(edges, points, anchors, vector_of, hops, k)
    lines = hits.join(points.select("vec_id", "source_doc", "page", "text"), "vec_id")
    return found, context({"FACTS": numbered_facts(facts, nodes), "PASSAGES": numbered_hits(lines)})


def analyst_context(claims: DataFrame, chunks: DataFrame, found: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``section, number, line`` of the analyst's four sections: claims, passages (300 characters), entities and conflicts; empty ones are left out.

    ``claims`` and ``chunks`` have ``rank, source_doc, page, score, text``; ``found`` is from :func:`graph.keyword_match`; ``conflicts`` from
    :func:`graph.conflict_edges`.
    """
    passage = lambda text: F.format_string("[%s p.%d | score:%.2f] %s", F.coalesce("source_doc", F.lit("unknown")), F.coalesce("page", F.lit(0)), "score", text)
    part = lambda df, number, order, line: df.select(F.lit(number).alias("section"), order.cast("string").alias("number"), line.alias("line"))
    order = F.format_string("%02d-%s-%020d", "n", F.coalesce("name", F.lit("")), F.col("entity_id"))
    return (part(claims, 1, F.format_string("%04d", "rank"), passage("text"))
            .unionByName(part(chunks, 2, F.format_string("%04d", "rank"), passage(F.substring("text", 1, 300))))
            .unionByName(part(found, 3, order, F.format_string("[%s] %s (from %s, confidence:%.1f) -> %s", "type", "name", F.coalesce("source_doc", F.lit("unknown")),
                                                               F.coalesce("confidence", F.lit(0.0)), F.array_join("relationships", ", "))))
            .unionByName(part(conflicts, 4, F.col("entity"), F.format_string("CONFLICT: '%s' is described differently in %s vs %s", "entity",
                                                                             F.coalesce("doc1", F.lit("unknown")), F.coalesce("doc2", F.lit("unknown"))))))


HEADS = {1: "KEY CLAIMS", 2: "PASSAGES", 3: "ENTITIES", 4: "KNOWN CONFLICTS"}


def analyst(question: str, vector_of: DataFrame, points: DataFrame, entities: DataFrame, edges: DataFrame, k: int = 5, conflict: str = "CONFLICTS_WITH") -> DataFrame:
    """The context of an analyst's question. ``vector_of`` holds the question's vector; ``points`` has ``page`` and ``text``."""
    texts = points.select("vec_id", "source_doc", "page", "text")
    hits = lambda **only: text_hits(points, vector_of, k, **only).join(texts, "vec_id")
    return analyst_context(hits(type="claim"), hits(), graph.keyword_match(entities, edges, question), graph.conflict_edges(edges, entities, conflict))


def analyst_answer(question: str, context_lines: DataFrame, answerer=None) -> str:
    """The answer to a question from its context (a page of lines); the fixed refusal where there is none."""
    from .. import providers

    rows = context_lines.orderBy("section", "number").collect()
    if not rows:
        return REFUSAL
    parts = [f"== {HEADS[n]} ==\n" + "\n".join(r.line for r in rows if r.section == n) for n in sorted({r.section for r in rows})]
    return (answerer or providers.answer)(question, "\n\n".join(parts))


def converse(question: str, turns: DataFrame, session_id: int, edges: DataFrame, points: DataFrame, nodes: DataFrame, aliases: DataFrame, answerer=None) -> tuple[str, DataFrame]:
    """``(answer, turns)`` after one turn of a conversation.

    The last five questions are the extractor's context; a question that names nothing takes the entities linked in the turn before; the answer comes from numbered
    facts and passages, or is the fixed refusal. The turn is appended with what was linked. ``turns`` has ``session_id, turn, question, mentions, linked, answer``.
    """
    from .. import providers
    from . import resolve
    from .sessions import HISTORY

    spark = edges.sparkSession
    before = turns.where(F.col("session_id") == session_id).orderBy(F.desc("turn")).limit(HISTORY).collect()  # five rows
    found = providers.mentions(question, "\n".join(f"Q: {t.question}" for t in reversed(before)))
    if not found and before:
        found = list(before[0].linked or [])
    asked = spark.createDataFrame([(i, m) for i, m in enumerate(found)], "mention_id long, mention string")
    linked = resolve.link_mentions(asked, nodes, aliases).select("entity").distinct()
    names = sorted(r.entity for r in linked.collect())  # at most one a mention of the question
    vector_of = spark.createDataFrame([(0, providers.hashed_vector(question))], "query_id long, embedding array<double>")
    facts, hits = retrieve(edges, points, linked.select(F.col("entity").alias("anchor")), vector_of)
    lines = hits.join(points.select("vec_id", "source_doc", "page", "text"), "vec_id")
    rows = numbered_facts(facts, nodes).unionByName(numbered_hits(lines)).collect()  # at most 20 facts and 8 passages
    answer = (answerer or providers.answer)(question, "\n".join(r.line for r in rows)) if rows else REFUSAL
    turn = spark.createDataFrame([(session_id, (before[0].turn if before else 0) + 1, question, found, names, answer)],
                                 "session_id bigint, turn int, question string, mentions array<string>, linked array<string>, answer string")
    return answer, turns.unionByName(turn)
