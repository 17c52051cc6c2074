"""From parsed documents to knowledge: chunking, extraction by a provider, normalising; and the whole way into the graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..functions.exprs import entity_key, extraction_confidence
from ..session import staged
from . import documents, graph, ontology, resolve

EXTRACTED = """filename string, chunk_id string, page int, seq bigint, kind string, name string, type string, from_name string, from_type string, to_name string,
to_type string, relation string, text string"""


@dataclass
class Knowledge:
    """What was extracted from a batch of documents."""

    chunks: DataFrame
    entities: DataFrame
    relationships: DataFrame
    claims: DataFrame
    failed: DataFrame


def chunked(parsed: DataFrame) -> DataFrame:
    """Chunks of parsed documents with section, weight, index and id."""
    pages = documents.with_sections(documents.pages_of(parsed))
    return documents.with_ids(documents.priority_order(documents.chunk_windows(pages)))


def extracted(chunks: DataFrame, extractor: Callable[[str], dict] = providers.extract, again: providers.Retry = providers.Retry(attempts=3)) -> DataFrame:
    """One row per entity, relationship and claim that the provider finds. It is asked again after errors that may pass; a chunk it fails on for good
    gives one row of kind ``failed`` with the error as its text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EXTRACTED.replace("\n", " ").split(",")]
        for batch in batches:
            rows = []
            for doc, cid, page, index, text in zip(batch["filename"], batch["chunk_id"], batch["page"], batch["chunk_index"], batch["text"]):
                base, n = {"filename": doc, "chunk_id": cid, "page": page}, 0
                try:
                    found = again(extractor, text)
                except Exception as e:
                    found = {}
                    rows.append(base | {"kind": "failed", "seq": int(index) * 10_000, "text": str(e)[:500]})
                for e in found.get("entities", []):
                    if isinstance(e, dict):
                        rows.append(base | {"kind": "entity", "seq": int(index) * 10_000 + n, "name": e.get("name"), "type": e.get("type")})
                        n += 1
                for r in found.get("relationships", []):
                    if isinstance(r, dict):
                        rows.append(base | {"kind": "relationship", "seq": int(index) * 10_000 + n, "from_name": r.get("from"), "from_type": r.get("from_type") or "CONCEPT",
                                            "to_name": r.get("to"), "to_type": r.get("to_type") or "CONCEPT", "relation": r.get("relation")})
                        n += 1
                for c in found.get("claims", []):
                    if isinstance(c, str):
                        rows.append(base | {"kind": "claim", "seq": int(index) * 10_000 + n, "text": c.strip()})
                        n += 1
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})

    return chunks.select("filename", "chunk_id", "page", "chunk_index", "text").mapInPandas(run, EXTRACTED)


def extract_knowledge(parsed: DataFrame, extractor: Callable[[str], dict] = providers.extract) -> Knowledge:
    """Chunks, entities (malformed ones dropped, types voted, the first of each name and type), relationships (ends retyped) and claims."""
    chunks = staged(chunked(parsed), "chunks")
    rows = staged(extracted(chunks, extractor), "extracted")
    quality = parsed.select("filename", extraction_confidence("tier", "quality_score", F.lit(False)).alias("confidence"))
    named = documents.well_formed(rows.where("kind = 'entity'"), "name", "type").withColumn("name_key", F.concat_ws("\u0001", "filename", F.lower(F.trim("name"))))
    votes = documents.type_vote(named)
    voted = named.drop("type").join(votes, "name_key")
    entities = documents.first_occurrences(voted).join(quality, "filename").select("filename", "chunk_id", "page", "seq", "name", "type", "confidence")
    rels = documents.well_formed(rows.where("kind = 'relationship'"), "from_name", "from_type", "to_name", "to_type", "relation")
    key = votes.select(F.split("name_key", "\u0001")[0].alias("filename"), F.split("name_key", "\u0001")[1].alias("k"), F.col("type").alias("t"))
    for end in ("from", "to"):
        voted_type = key.select(F.col("filename").alias("__f"), F.col("k").alias("__k"), F.col("t").alias("__t"))
        rels = rels.join(voted_type, (F.col("filename") == F.col("__f")) & (F.lower(F.trim(f"{end}_name")) == F.col("__k")), "left").withColumn(
            f"{end}_type", F.coalesce("__t", f"{end}_type")).drop("__f", "__k", "__t")
    claims = documents.well_formed(rows.where("kind = 'claim'"), "text").select("filename", "chunk_id", "page", "seq", "text")
    return Knowledge(chunks, entities, rels.select("filename", "chunk_id", "page", "seq", "from_name", "from_type", "to_name", "to_type", "relation"), claims,
                     rows.where("kind = 'failed'").select("filename", "chunk_id", "page", F.col("text").alias("error")))


def ingest(known: Knowledge, nodes: DataFrame, edges: DataFrame, aliases: DataFrame, confirm=providers.referee) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, report)`` after a batch: entities resolved against the snapshot and upserted, relations put into the ontology's types, edges
    mapped through the resolution and upserted. ``nodes`` has ``entity_id, name, type, domain, confidence, source_doc``; ``edges`` ``src, dst, rel_type, confidence, at``."""
    new = known.entities.select(F.xxhash64("filename", "seq").alias("new_id"), "name", "type", F.lit(None).cast("string").alias("domain"), "confidence", "filename")
    resolved = staged(resolve.resolve(new, nodes, aliases, confirm=confirm), "resolved")
    batch = new.join(resolved.select("new_id", "canonical", F.col("confidence").alias("resolution")), "new_id").select(
        F.col("canonical").alias("name"), "type", "domain", (F.col("confidence") * F.col("resolution")).alias("confidence"), F.col("filename").alias("source_doc"))
    after = graph.upsert_entities(nodes, batch)
    names = resolved.groupBy(F.col("name").alias("raw")).agg(F.min("canonical").alias("canonical"))
    rels = ontology.resolve_relations(known.relationships).select(F.col("from_name").alias("f"), F.col("to_name").alias("t"), F.col("canonical").alias("rel_type"), "confidence")
    a, b = names.select(F.col("raw").alias("f"), F.col("canonical").alias("fc")), names.select(F.col("raw").alias("t"), F.col("canonical").alias("tc"))
    moved = rels.join(a, "f", "left").join(b, "t", "left").select(F.coalesce("fc", "f").alias("src"), F.coalesce("tc", "t").alias("dst"), "rel_type", "confidence",
                                                                   F.current_timestamp().alias("at"))
    ends = after.select("name").distinct()
    moved = moved.join(ends.select(F.col("name").alias("src")), "src", "left_semi").join(ends.select(F.col("name").alias("dst")), "dst", "left_semi")
    report = documents.ingest_report(known.entities.select(F.col("filename").alias("source_doc"), F.lit(True).alias("written")),
                                     known.relationships.select(F.col("filename").alias("source_doc")), known.chunks.select(F.col("filename").alias("source_doc")))
    return after, graph.upsert_edges(edges, moved), report


def rewrite_aliases(aliases: DataFrame, groups: DataFrame, canonical: DataFrame) -> DataFrame:
    """Aliases after duplicates are merged: every member's name points to its group's canonical at confidence 1, whatever was known before."""
    merged = groups.join(canonical, "group_id").select(F.lower(F.trim("name")).alias("alias_key"), "canonical").where(
        F.col("alias_key") != F.lower("canonical")).groupBy("alias_key").agg(F.min("canonical").alias("canonical"))
    fresh = merged.select("alias_key", "canonical", F.lit(1.0).alias("confidence"))
    return aliases.select("alias_key", "canonical", "confidence").join(fresh.select("alias_key"), "alias_key", "left_anti").unionByName(fresh)


@dataclass
class Merged:
    """Graph and memories after duplicates are merged; with a dry run they are as before."""

    groups: DataFrame
    nodes: DataFrame
    edges: DataFrame
    aliases: DataFrame
    memory: DataFrame


def merge_duplicates(entities: DataFrame, edges: DataFrame, aliases: DataFrame, memory: DataFrame, dry_run: bool = True) -> Merged:
    """Names that abbreviate each other merged under the longest base: nodes, edges, aliases and entity memory (``key, confidence, occurrences``).

    ``groups`` says what is (or with ``dry_run`` would be) merged: ``group_id, type, entity_id, name, canonical``. Memories that fall under one key add their
    occurrences and keep the higher confidence.
    """
    found = resolve.duplicate_groups(entities)
    canonical = resolve.pick_canonical(found)
    groups = staged(found.join(canonical.select("group_id", "canonical"), "group_id").select("group_id", "type", "entity_id", "name", "canonical"), "groups")
    if dry_run:
        return Merged(groups, entities, edges, aliases, memory)
    mapping = groups.select("name", "canonical").distinct()
    nodes, moved = graph.merge_nodes(entities, edges, mapping)
    keys = groups.select(entity_key("type", "name").alias("key"), entity_key("type", "canonical").alias("to")).groupBy("key").agg(F.min("to").alias("to"))
    kept = memory.join(keys, "key", "left").groupBy(F.coalesce("to", "key").alias("key")).agg(F.max("confidence").alias("confidence"), F.sum("occurrences").alias("occurrences"))
    return Merged(groups, nodes, moved, rewrite_aliases(aliases, groups.drop("canonical"), canonical), kept)
