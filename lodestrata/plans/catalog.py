"""All queries over the reference's operators, with their SQL.

Names begin with the id of the operator in the survey. Floats are rounded to six decimals in both engines; every tie is broken by a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..functions import exprs, udfs
from ..model import EDG_SQL, ENT_SQL, edges, entities
from ..operators import curate, documents, graph, ingest, memory, ontology, reconcile, resolve, retrieve, sessions, vector
from ..session import table
from ..sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


def n64(c: str) -> F.Column:
    return F.col(c).cast("bigint").alias(c)


# ------------------------------------------------------------------ graph

ANCHORS = ["P1", "P2", "P3"]
EDG = f"e AS ({EDG_SQL})"
_HOPS = f"""WITH {EDG},
w AS (SELECT edge_id, src AS a, dst AS b, rel_type, confidence FROM e WHERE confidence >= 0.4 AND rel_type <> 'AUTHORED_BY'
      UNION ALL SELECT edge_id, dst, src, rel_type, confidence FROM e WHERE confidence >= 0.4 AND rel_type <> 'AUTHORED_BY' AND src <> dst),
h1 AS (SELECT a AS anchor, b AS related, edge_id AS u1, rel_type AS chain, confidence AS score, 1 AS hops FROM w WHERE a IN ('P1', 'P2', 'P3')),
h2 AS (SELECT anchor, w.b AS related, u1, w.edge_id AS u2, chain || '>' || w.rel_type AS chain, score * w.confidence AS score, 2 AS hops
       FROM h1 JOIN w ON h1.related = w.a WHERE w.edge_id <> u1),
h3 AS (SELECT anchor, w.b AS related, chain || '>' || w.rel_type AS chain, score * w.confidence AS score, 3 AS hops
       FROM h2 JOIN w ON h2.related = w.a WHERE w.edge_id NOT IN (u1, u2)),
t1 AS (SELECT DISTINCT anchor, related, chain, score, hops FROM h1 WHERE related <> anchor),
t2 AS (SELECT * FROM t1 UNION ALL SELECT DISTINCT anchor, related, chain, score, hops FROM h2 WHERE related <> anchor),
t3 AS (SELECT * FROM t2 UNION ALL SELECT DISTINCT anchor, related, chain, score, hops FROM h3 WHERE related <> anchor)
"""


def _trails(spark: SparkSession, sf_dir: str, hops: int, **only: int) -> DataFrame:
    anchors = spark.createDataFrame([(a,) for a in ANCHORS], "anchor string")
    return graph.neighbors(edges(spark, sf_dir), anchors, hops, 0.4, ["AUTHORED_BY"], **only)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("anchor", "related", F.array_join("chain", ">").alias("chain"), r6("score").alias("score"), n64("hops"))


for _h in (1, 2, 3):
    query(f"c15_neighbors_h{_h}", _HOPS + f"""SELECT anchor, related, chain, round(score, 6) AS score, CAST(hops AS BIGINT) AS hops FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, hops, related, chain) AS rn FROM t{_h}) WHERE rn <= 50""")(
        lambda s, d, h=_h: _shown(graph.top_paths(_trails(s, d, h, trails=50), 50)))

_BEST = """SELECT anchor, related, chain, round(score, 6) AS score, CAST(hops AS BIGINT) AS hops FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor, related ORDER BY round(score, 12) DESC, hops, chain) AS rn FROM t{0}) WHERE rn = 1"""


@query("n12_best_paths", _HOPS + _BEST.format(3))
def n12(s, d):
    return _shown(graph.best_paths(_trails(s, d, 3)))


@query("retrieve_graph_facts", _HOPS + f"SELECT * FROM ({_BEST.format(2)}) ORDER BY score DESC, hops, anchor, related LIMIT 20")
def flagship(s, d):
    best = _shown(graph.best_paths(_trails(s, d, 2, facts=20)))
    return graph.top_facts(best, 20)


@query("c1_endpoint_join", """SELECT r.rel_id, r.from_name, r.to_name FROM (SELECT DISTINCT rel_id, from_name, from_type, to_name, to_type FROM relationships) r
    WHERE EXISTS (SELECT 1 FROM entities e WHERE e.name = r.from_name AND e.type = r.from_type)
      AND EXISTS (SELECT 1 FROM entities e WHERE e.name = r.to_name AND e.type = r.to_type)""")
def c1(s, d):
    rels = table(s, d, "relationships").select("rel_id", "from_name", "from_type", "to_name", "to_type").distinct()
    return graph.link_endpoints(rels, table(s, d, "entities")).select("rel_id", "from_name", "to_name")


_REL_EDGES = """g AS (SELECT from_name AS src, to_name AS dst, relation AS rel_type, max(confidence) AS confidence FROM relationships
    WHERE from_name IS NOT NULL AND to_name IS NOT NULL GROUP BY 1, 2, 3)"""


def _rel_edges(s, d) -> DataFrame:
    rels = table(s, d, "relationships").where("from_name IS NOT NULL AND to_name IS NOT NULL")
    return rels.groupBy(F.col("from_name").alias("src"), F.col("to_name").alias("dst"), F.col("relation").alias("rel_type")).agg(F.max("confidence").alias("confidence"))


@query("c13_conflict_edges", f"""WITH {_REL_EDGES} SELECT g.src AS entity, g.dst AS other, a.source_doc AS doc1, b.source_doc AS doc2
    FROM g JOIN entities a ON a.name = g.src JOIN entities b ON b.name = g.dst WHERE g.rel_type = 'DISPUTES'""")
def c13(s, d):
    return graph.conflict_edges(_rel_edges(s, d), table(s, d, "entities"), "DISPUTES")


@query("c12_keyword_match", f"""WITH {_REL_EDGES}, q AS (SELECT * FROM (VALUES (0, 'metrology'), (1, 'institute'), (2, 'gradient')) AS v(n, word)),
h AS (SELECT * FROM (SELECT q.n, q.word, e.entity_id, e.name, e.type, e.source_doc, e.confidence, row_number() OVER (PARTITION BY q.n
    ORDER BY e.confidence DESC NULLS LAST, e.name, e.type, coalesce(e.domain, ''), e.entity_id) AS rn FROM q JOIN entities e ON contains(lower(e.name), q.word)) WHERE rn <= 5)
SELECT h.word, h.entity_id, h.name, round(h.confidence, 6) AS confidence, coalesce(array_to_string(list_slice(list_sort(list(DISTINCT g.rel_type || ' -> ' || g.dst)
    FILTER (g.rel_type IS NOT NULL)), 1, 3), '; '), '') AS relationships
FROM h LEFT JOIN g ON g.src = h.name GROUP BY ALL""")
def c12(s, d):
    found = graph.keyword_match(table(s, d, "entities"), _rel_edges(s, d).where("rel_type IS NOT NULL"), "Which metrology institute with a gradient")
    return found.select("word", "entity_id", "name", r6("confidence").alias("confidence"), F.array_join("relationships", "; ").alias("relationships"))


@query("j1_upsert_entities", """WITH o AS (SELECT name, type, domain, max(confidence) AS c, list(DISTINCT source_doc) AS srcs FROM entities WHERE entity_id % 2 = 0 GROUP BY 1, 2, 3),
b AS (SELECT name, type, domain, max(confidence) AS c, list(DISTINCT source_doc) AS srcs FROM entities WHERE entity_id % 2 = 1 GROUP BY 1, 2, 3),
j AS (SELECT coalesce(o.name, b.name) AS name, coalesce(o.type, b.type) AS type, coalesce(o.domain, b.domain) AS domain, o.c AS oc, b.c AS bc,
    coalesce(o.srcs, []) AS os, coalesce(b.srcs, []) AS bs, o.srcs IS NOT NULL AS had, b.srcs IS NOT NULL AS got
    FROM o FULL JOIN b ON o.name IS NOT DISTINCT FROM b.name AND o.type IS NOT DISTINCT FROM b.type AND o.domain IS NOT DISTINCT FROM b.domain)
SELECT name, type, domain, round(CASE WHEN oc IS NULL THEN bc WHEN bc IS NULL THEN oc
    ELSE least(1E0, oc + 0.05E0 * len(list_filter(bs, lambda x: NOT list_contains(os, x)))) END, 6) AS confidence,
    CAST(len(list_distinct(list_concat(os, bs))) AS BIGINT) AS seen FROM j""")
def j1(s, d):
    e = table(s, d, "entities")
    out = graph.upsert_entities(e.where("entity_id % 2 = 0"), e.where("entity_id % 2 = 1"))
    return out.select("name", "type", "domain", r6("confidence").alias("confidence"), n64("seen"))


@query("j2_upsert_edges", """WITH r AS (SELECT from_name AS src, to_name AS dst, relation AS rel_type, confidence, created_at AS t0, rel_id FROM relationships
    WHERE from_name IS NOT NULL AND to_name IS NOT NULL AND relation IS NOT NULL),
o AS (SELECT src, dst, rel_type, max(confidence) AS oc, min(t0) AS created_at FROM r WHERE rel_id % 2 = 0 GROUP BY 1, 2, 3),
b AS (SELECT src, dst, rel_type, max(confidence) AS nc, max(t0) AS updated_at FROM r WHERE rel_id % 2 = 1 GROUP BY 1, 2, 3)
SELECT src, dst, rel_type, round(CASE WHEN nc IS NULL THEN oc ELSE least(1E0, coalesce(oc, nc) + 0.05E0) END, 6) AS confidence,
    coalesce(created_at, updated_at) AS created_at, coalesce(updated_at, created_at) AS last_updated FROM o FULL JOIN b USING (src, dst, rel_type)""")
def j2(s, d):
    r = table(s, d, "relationships").where("from_name IS NOT NULL AND to_name IS NOT NULL AND relation IS NOT NULL").select(
        "rel_id", F.col("from_name").alias("src"), F.col("to_name").alias("dst"), F.col("relation").alias("rel_type"), "confidence", F.col("created_at").alias("at"))
    out = graph.upsert_edges(r.where("rel_id % 2 = 0"), r.where("rel_id % 2 = 1"))
    return out.select("src", "dst", "rel_type", r6("confidence").alias("confidence"), "created_at", "last_updated")


@query("j3_tag_domain", """SELECT entity_id, CASE WHEN name IN (SELECT name FROM entities WHERE domain = 'other') AND type = 'PERSON' THEN 'Tagged' ELSE domain END AS domain FROM entities""")
def j3(s, d):
    e = table(s, d, "entities")
    tags = e.where("domain = 'other'").select("name", F.lit("PERSON").alias("type"), F.lit("Tagged").alias("new_domain")).distinct()
    return graph.tag_domain(e, tags).select("entity_id", "domain")


@query("j4_flag", """SELECT entity_id, coalesce(domain = 'other', false) AS flagged, round(CASE WHEN domain = 'other' THEN confidence * 0.7E0 ELSE confidence END, 6) AS confidence FROM entities""")
def j4(s, d):
    return graph.flag(table(s, d, "entities"), F.col("domain") == "other").select("entity_id", "flagged", r6("confidence").alias("confidence"))


@query("j5_supersede", """WITH l AS (SELECT name, type, min(source_doc) AS loser, max(source_doc) AS winner FROM entities WHERE name IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source_doc) > 1)
SELECT e.entity_id, l.winner AS superseded_by, round(CASE WHEN l.winner IS NULL THEN confidence ELSE confidence * 0.6E0 END, 6) AS confidence
FROM entities e LEFT JOIN l ON e.name = l.name AND e.type = l.type AND e.source_doc = l.loser""")
def j5(s, d):
    e = table(s, d, "entities")
    v = e.where("name IS NOT NULL").groupBy("name", "type").agg(F.min("source_doc").alias("loser"), F.max("source_doc").alias("winner"), F.count_distinct("source_doc").alias("n"))
    return graph.supersede(e, v.where("n > 1")).select("entity_id", "superseded_by", r6("confidence").alias("confidence"))


_HOMONYMS = """SELECT DISTINCT a.name AS src, b.domain AS dst FROM entities a JOIN entities b ON a.name = b.name AND a.type = b.type AND a.entity_id < b.entity_id
    AND a.domain <> b.domain"""


@query("j6_j7_append_edges", f"SELECT src, dst, 'RELATED_TERM_DIFFERENT_DOMAIN' AS rel_type, 0.4E0 AS confidence FROM ({_HOMONYMS})")
def j7(s, d):
    e = table(s, d, "entities")
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.entity_id") < F.col("b.entity_id"))
                   & (F.col("a.domain") != F.col("b.domain"))).select(F.col("a.name").alias("src"), F.col("b.domain").alias("dst"))
    return graph.append_edges(pairs, "RELATED_TERM_DIFFERENT_DOMAIN", 0.4)


_MAPPING = "SELECT DISTINCT name, lower(trim(name)) AS canonical FROM entities WHERE name IS NOT NULL"


@query("j17_merge_nodes", f"""WITH m AS ({_MAPPING}) SELECT coalesce(m.canonical, e.name) AS name, e.type, round(max(e.confidence), 6) AS confidence, count(*) AS merged
    FROM entities e LEFT JOIN m ON e.name = m.name GROUP BY 1, 2""")
def j17n(s, d):
    e = table(s, d, "entities")
    mapping = e.where("name IS NOT NULL").select("name", F.lower(F.trim("name")).alias("canonical"))
    nodes, _ = graph.merge_nodes(e, _rel_edges(s, d), mapping)
    return nodes.select("name", "type", r6("confidence").alias("confidence"), "merged")


@query("j17_merge_edges", f"""WITH m AS ({_MAPPING}), {_REL_EDGES} SELECT coalesce(a.canonical, g.src) AS src, coalesce(b.canonical, g.dst) AS dst, rel_type,
    round(max(g.confidence), 6) AS confidence FROM g LEFT JOIN m a ON g.src = a.name LEFT JOIN m b ON g.dst = b.name GROUP BY 1, 2, 3""")
def j17e(s, d):
    e = table(s, d, "entities")
    mapping = e.where("name IS NOT NULL").select("name", F.lower(F.trim("name")).alias("canonical"))
    _, moved = graph.merge_nodes(e, _rel_edges(s, d), mapping)
    return moved.select("src", "dst", "rel_type", r6("confidence").alias("confidence"))


@query("n4_graph_stats", f"""WITH {_REL_EDGES} SELECT (SELECT count(*) FROM entities) AS entities, (SELECT round(avg(confidence), 6) FROM entities) AS avg_confidence,
    (SELECT count(*) FROM g) AS relationships""")
def n4(s, d):
    return graph.graph_stats(table(s, d, "entities"), _rel_edges(s, d)).select("entities", r6("avg_confidence").alias("avg_confidence"), "relationships")


@query("n5_domain_stats", "SELECT domain, count(*) AS entity_count FROM entities WHERE domain IS NOT NULL GROUP BY 1")
def n5(s, d):
    return graph.count_by(table(s, d, "entities"), "domain")


@query("n6_sources", "SELECT source_doc, count(*) AS entity_count FROM mentions WHERE source_doc IS NOT NULL GROUP BY 1")
def n6(s, d):
    return graph.count_by(table(s, d, "mentions"), "source_doc")


@query("n7_type_stats", "SELECT coalesce(type, 'UNKNOWN') AS type, count(*) AS entities, round(avg(coalesce(confidence, 0)), 6) AS avg_confidence FROM entities GROUP BY 1")
def n7(s, d):
    return graph.type_stats(table(s, d, "entities")).select("type", "entities", r6("avg_confidence").alias("avg_confidence"))


@query("n15_degrees", """SELECT name, count(*) AS degree FROM (SELECT from_name AS name FROM relationships UNION ALL SELECT to_name FROM relationships) WHERE name IS NOT NULL GROUP BY 1""")
def n15(s, d):
    return graph.degrees(table(s, d, "relationships"))


# ------------------------------------------------------------------ filters, lookups, validation

@query("b1_exact_lookup", """SELECT asked_id, entity_id FROM (SELECT q.entity_id AS asked_id, e.entity_id, row_number() OVER (PARTITION BY q.entity_id
    ORDER BY e.confidence DESC NULLS LAST, e.entity_id) AS n FROM entities q JOIN entities e ON q.name = e.name AND (q.type IS NULL OR q.type = e.type)) WHERE n = 1""")
def b1(s, d):
    e = table(s, d, "entities")
    asked = e.select(F.col("entity_id").alias("asked_id"), "name", "type")
    return resolve.exact_lookup(asked, e).select("asked_id", "entity_id")


@query("b3_substring_match", r"""WITH n AS (SELECT entity_id AS new_id, type, trim(regexp_replace(lower(trim(name)), '^(dr\.|dr |prof\.|prof |mr\.|mr |ms\.|ms |mrs\.|mrs )', '')) AS n
    FROM entities WHERE entity_id % 20 = 0 AND name IS NOT NULL),
w AS (SELECT new_id, type, n, unnest(list_distinct(list_filter(regexp_split_to_array(n, '[^\p{L}\p{N}]+'), lambda x: length(x) > 2))) AS w FROM n),
e AS (SELECT entity_id, name, type, lower(name) AS m, confidence, unnest(list_distinct(list_filter(regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+'), lambda x: length(x) > 2))) AS w
    FROM entities WHERE name IS NOT NULL),
h AS (SELECT DISTINCT w.new_id, e.entity_id, e.name, e.confidence FROM w JOIN e ON w.type = e.type AND w.w = e.w WHERE w.new_id <> e.entity_id AND (contains(m, n) OR contains(n, m)))
SELECT new_id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY confidence DESC NULLS LAST, name, entity_id) AS rn FROM h) WHERE rn = 1""")
def b3(s, d):
    e = table(s, d, "entities")
    new = e.where("entity_id % 20 = 0 AND name IS NOT NULL").withColumnRenamed("entity_id", "new_id")
    return resolve.substring_match(new, e, exclude_self=True).select("new_id", "entity_id")


@query("b4_stale_entities", "SELECT entity_id, round(confidence, 6) AS confidence FROM entities WHERE confidence < 0.35")
def b4(s, d):
    return curate.stale(table(s, d, "entities"), 0.35).select("entity_id", r6("confidence").alias("confidence"))


@query("b6_payload_filter", "SELECT vec_id FROM vec_points WHERE type = 'claim' AND domain = 'Law'")
def b6(s, d):
    return table(s, d, "vec_points").where(vector.payload_filter(type="claim", domain="Law")).select("vec_id")


@query("b8_permissive_domain", """SELECT a.entity_id AS a, b.entity_id AS b FROM entities a JOIN entities b ON a.name = b.name AND a.type = b.type AND a.entity_id < b.entity_id
    WHERE a.domain IS NULL OR b.domain IS NULL OR a.domain = b.domain""")
def b8(s, d):
    e = table(s, d, "entities")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.entity_id") < F.col("b.entity_id"))).where(
        vector.same_domain(F.col("a.domain"), F.col("b.domain"))).select(F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b"))


@query("b11_validate", """SELECT rel_id, min(CASE WHEN coalesce(from_name, '') = '' THEN 'relationship missing ''from_name''' WHEN coalesce(from_type, '') = '' THEN 'relationship missing ''from_type'''
    WHEN coalesce(to_name, '') = '' THEN 'relationship missing ''to_name''' WHEN coalesce(to_type, '') = '' THEN 'relationship missing ''to_type'''
    WHEN coalesce(relation, '') = '' THEN 'relationship missing ''relation''' END) AS reason FROM relationships GROUP BY 1""")
def b11(s, d):
    rows = resolve.validate(table(s, d, "relationships"), "from_name", "from_type", "to_name", "to_type", "relation", what="relationship")
    return rows.groupBy("rel_id").agg(F.min("reason").alias("reason"))


@query("b12_b14_well_formed", "SELECT DISTINCT chunk_id FROM chunks WHERE trim(text) <> '' AND source_doc IS NOT NULL AND trim(source_doc) <> ''")
def b12(s, d):
    return documents.well_formed(table(s, d, "chunks"), "text", "source_doc").select("chunk_id").distinct()


@query("b18_f1_self_reference", f"WITH {_REL_EDGES} SELECT src, dst FROM g WHERE src <> dst")
def b18(s, d):
    return graph.without_loops(_rel_edges(s, d)).select("src", "dst")


@query("h38_description", """SELECT entity_id, coalesce(description, '') AS description FROM entities""")
def h38(s, d):
    stored = F.concat(F.lit("{'name': 'x', 'description': "), F.when(F.col("description").isNull(), "None").otherwise(F.concat(F.lit("'"), F.regexp_replace("description", r"([\\\\'])", r"\\\\$1"), F.lit("'"))), F.lit("}"))
    return table(s, d, "entities").select("entity_id", udfs.safe_description(stored).alias("description"))


@query("b23_niche", "SELECT domain AS name, count(*) AS times_seen FROM entities WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) < 3")
def b23(s, d):
    seen = table(s, d, "entities").where("domain IS NOT NULL").groupBy(F.col("domain").alias("name")).agg(F.count("*").alias("times_seen"))
    return ontology.niche(seen)


@query("b21_alias_audit", "SELECT name, round(min(confidence), 6) AS confidence FROM entities WHERE confidence < 0.5 AND name IS NOT NULL GROUP BY 1")
def b21(s, d):
    aliases = table(s, d, "entities").where("name IS NOT NULL").select(F.col("name").alias("alias_key"), F.col("name").alias("canonical"), "confidence")
    return memory.alias_audit(aliases, 0.5).select(F.col("alias_key").alias("name"), r6("confidence").alias("confidence"))


# ------------------------------------------------------------------ vectors

_COS = """p AS (SELECT vec_id, type, domain, embedding FROM vec_points WHERE len(embedding) = 64),
q AS (SELECT vec_id AS query_id, type AS q_type, embedding AS qe FROM p WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, q.q_type, p.vec_id, p.type, p.domain, CASE WHEN list_sum(list_transform(qe, lambda x: abs(x))) = 0 OR list_sum(list_transform(embedding, lambda x: abs(x))) = 0
    THEN 0E0 ELSE list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) END AS score FROM q CROSS JOIN p)"""


def _asked(s, d, *columns: str) -> DataFrame:
    return table(s, d, "vec_points").where("vec_id % 20 = 0 AND size(embedding) = 64").select(F.col("vec_id").alias("query_id"), "embedding", *columns)


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", r6("score").alias("score"), n64("rank"))


@query("c7_vector_topk", f"""WITH {_COS} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s) WHERE rank <= 8""")
def c7(s, d):
    return _ranked(vector.topk(table(s, d, "vec_points"), _asked(s, d), 8))


@query("c7_vector_topk_filtered", f"""WITH {_COS} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s WHERE type = 'claim' AND domain = 'Law') WHERE rank <= 5""")
def c7f(s, d):
    points = table(s, d, "vec_points").where(vector.payload_filter(type="claim", domain="Law"))
    return _ranked(vector.topk(points, _asked(s, d), 5))


@query("c5_nearest_threshold", f"""WITH {_COS} SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s WHERE q_type = type AND vec_id <> query_id AND score > 0.5) WHERE rank = 1""")
def c5(s, d):
    found = vector.topk(table(s, d, "vec_points"), _asked(s, d, "type").where("type IS NOT NULL"), 1, "type", 0.5, True, exclude_self=True)
    return _ranked(found).drop("rank")


@query("c6_nearest_any", f"""WITH {_COS} SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s WHERE q_type = type AND vec_id <> query_id) WHERE rank = 1""")
def c6(s, d):
    found = vector.topk(table(s, d, "vec_points"), _asked(s, d, "type").where("type IS NOT NULL"), 1, "type", exclude_self=True)
    return _ranked(found).drop("rank")


@query("a18_latest_vectors", """SELECT lower(name) AS name_key, type, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), type
    ORDER BY last_updated DESC NULLS LAST, entity_id DESC) AS n FROM entities WHERE name IS NOT NULL) WHERE n = 1""")
def a18(s, d):
    rows = table(s, d, "entities").where("name IS NOT NULL").withColumn("name_key", F.lower("name"))
    return vector.latest_by_key(rows, [F.col("name_key"), F.col("type")], [F.desc_nulls_last("last_updated"), F.desc("entity_id")]).select("name_key", "type", "entity_id")


_LISTED = "SELECT source_doc FROM source_docs WHERE tier = 1"


@query("a19_delete_by_source", f"SELECT vec_id FROM vec_points WHERE source_doc IS NULL OR source_doc NOT IN ({_LISTED} AND source_doc IS NOT NULL)")
def a19(s, d):
    return vector.delete_by_source(table(s, d, "vec_points"), table(s, d, "source_docs").where("tier = 1")).select("vec_id")


@query("a20_source_exists", "SELECT source_doc, source_doc IN (SELECT source_doc FROM vec_points WHERE source_doc IS NOT NULL) AS present FROM (SELECT DISTINCT source_doc FROM source_docs)")
def a20(s, d):
    return vector.source_exists(table(s, d, "vec_points"), table(s, d, "source_docs"))


@query("j19_reinsert", "SELECT source_doc, count(*) AS points FROM vec_points GROUP BY 1")
def j19(s, d):
    points = table(s, d, "vec_points").select("vec_id", "source_doc")
    batch = points.join(table(s, d, "source_docs").where("tier = 1").select("source_doc").distinct(), "source_doc", "left_semi").select("vec_id", "source_doc")
    return vector.reinsert(points, batch).groupBy("source_doc").agg(F.count("*").alias("points"))


@query("a21_collection_stats", "SELECT type, count(*) AS points FROM vec_points GROUP BY 1")
def a21(s, d):
    return vector.collection_stats(table(s, d, "vec_points"))


@query("a22_peek", "SELECT vec_id, type, source_doc FROM vec_points ORDER BY vec_id LIMIT 3")
def a22(s, d):
    return vector.peek(table(s, d, "vec_points")).select("vec_id", "type", "source_doc")


@query("a14_all_entities", "SELECT name, type, domain, confidence, source_doc, last_updated FROM entities ORDER BY name NULLS LAST, type, entity_id LIMIT 10000")
def a14(s, d):
    return graph.all_entities(table(s, d, "entities"))


# ------------------------------------------------------------------ scalar functions

_PN = "SELECT DISTINCT lower(p_name) AS name FROM part"


@query("h1_normalize_names", r"SELECT DISTINCT p_name AS name, regexp_replace(regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g'), '[^\w\s]', '', 'g') AS key FROM part")
def h1(s, d):
    return table(s, d, "part").select(F.col("p_name").alias("name"), exprs.normalize_name("p_name").alias("key")).distinct()


def _texts(s, d) -> DataFrame:
    """The two ends of every relationship as pairs of names."""
    return table(s, d, "relationships").where("from_name IS NOT NULL AND to_name IS NOT NULL").select(F.col("from_name").alias("a"), F.col("to_name").alias("b")).distinct()


_PAIRS_SQL = "SELECT DISTINCT from_name AS a, to_name AS b FROM relationships WHERE from_name IS NOT NULL AND to_name IS NOT NULL"
_NUMS = r"list_sort(list_distinct(regexp_extract_all({0}, '(\d+(?:\.\d+)?)', 1)))"
_STRIP = "CASE " + " ".join(f"WHEN starts_with({{0}}, '{p}') AND length({{0}}) > {len(p) + 2} THEN substr({{0}}, {len(p) + 1})" for p in exprs.NEGATION_PREFIXES) + " END"
_LET = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"


@query("h6_numeric_conflict", f"""WITH v AS ({_PAIRS_SQL}) SELECT a, b, len({_NUMS.format('a')}) > 0 AND len({_NUMS.format('b')}) > 0
    AND {_NUMS.format('a')} <> {_NUMS.format('b')} AS conflict FROM v""")
def h6(s, d):
    return _texts(s, d).select("a", "b", exprs.numeric_conflict("a", "b").alias("conflict"))


@query("h8_negation_pair", f"""WITH v AS ({_PAIRS_SQL}), l AS (SELECT a AS ra, b AS rb, {_LET.format('a')} AS a, {_LET.format('b')} AS b FROM v)
    SELECT ra AS a, rb AS b, coalesce({_STRIP.format('l.a')} = l.b, false) OR coalesce({_STRIP.format('l.b')} = l.a, false) AS negation FROM l""")
def h8(s, d):
    return _texts(s, d).select("a", "b", exprs.negation_pair("a", "b").alias("negation"))


@query("h10_disqualified", f"""WITH v AS ({_PAIRS_SQL}), l AS (SELECT a AS ra, b AS rb, {_LET.format('a')} AS a, {_LET.format('b')} AS b FROM v)
    SELECT ra AS a, rb AS b, CASE WHEN coalesce({_STRIP.format('l.a')} = l.b, false) OR coalesce({_STRIP.format('l.b')} = l.a, false) THEN 'negation'
    WHEN len({_NUMS.format('ra')}) > 0 AND len({_NUMS.format('rb')}) > 0 AND {_NUMS.format('ra')} <> {_NUMS.format('rb')} THEN 'numbers' END AS reason FROM l""")
def h10(s, d):
    return _texts(s, d).select("a", "b", exprs.disqualified("a", "b").alias("reason"))


@query("h5_typo_candidates", f"""WITH p AS ({_PN}) SELECT a.name AS a, b.name AS b FROM p a JOIN p b ON a.name < b.name
    WHERE length(a.name) >= 4 AND length(b.name) >= 4 AND levenshtein(a.name, b.name) <= 2""")
def h5(s, d):
    p = table(s, d, "part").select(F.lower("p_name").alias("name")).distinct()
    new = p.select(F.col("name").alias("new_id"), "name", F.lit("T").alias("type"), F.lit(None).cast("string").alias("domain"))
    old = p.select(F.col("name").alias("entity_id"), "name", F.lit("T").alias("type"), F.lit(None).cast("string").alias("domain"))
    return resolve.typo_pairs(new, old).where("a < b").select("a", "b")


@query("h2_fuzzy_ratio")
def h2(s, d):
    return _texts(s, d).select("a", "b", r6(udfs.fuzzy_ratio("a", "b")).alias("ratio"), udfs.safe_fuzzy_match("a", "b").alias("safe"))


@query("h11_combine_confidence", """SELECT entity_id, round(greatest(0E0, least(1E0, coalesce(confidence, 0))) * 0.9E0 * 0.8E0, 6) AS confidence FROM entities""")
def h11(s, d):
    return table(s, d, "entities").select("entity_id", r6(exprs.combine_confidence("confidence", F.lit(0.9), F.lit(0.8))).alias("confidence"))


@query("h12_extraction_confidence", """SELECT source_doc, tier, round(max((CASE tier WHEN 1 THEN 0.95E0 WHEN 2 THEN 0.85E0 WHEN 3 THEN 0.70E0 ELSE 0.75E0 END)
    * greatest(0E0, least(1E0, coalesce(quality_score, 1E0))) * CASE WHEN len(ocr_pages) > 0 THEN 0.9E0 ELSE 1E0 END), 6) AS confidence FROM source_docs GROUP BY 1, 2""")
def h12(s, d):
    c = exprs.extraction_confidence("tier", "quality_score", F.coalesce(F.size("ocr_pages") > 0, F.lit(False)))
    return table(s, d, "source_docs").groupBy("source_doc", "tier").agg(r6(F.max(c)).alias("confidence"))


@query("h13_chunk_ids", """SELECT DISTINCT chunk_id, substr(sha1(source_doc || ':' || CAST(page AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR) || ':' || substr(text, 1, 80)), 1, 16) AS made
    FROM chunks WHERE text IS NOT NULL AND source_doc IS NOT NULL AND page IS NOT NULL AND chunk_index IS NOT NULL""")
def h13(s, d):
    rows = table(s, d, "chunks").where("text IS NOT NULL AND source_doc IS NOT NULL AND page IS NOT NULL AND chunk_index IS NOT NULL")
    return rows.select("chunk_id", exprs.chunk_id("source_doc", "page", "chunk_index", "text").alias("made")).distinct()


@query("h24_doc_hash", "SELECT doc_id, substr(sha256(lower(source) || '::' || substr(lower(text), 1, 1200)), 1, 16) AS hash FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def h24(s, d):
    return table(s, d, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", exprs.doc_hash("source", "text").alias("hash"))


@query("h30_fingerprint", "SELECT md5(text) AS md5, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def h30(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("md5")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


_PB = r"CASE WHEN trim(regexp_extract(trim({0}), '^(.*?)\s*\(([A-Za-z0-9][A-Za-z0-9.\-]{{0,7}})\)\s*$', 1)) <> '' THEN trim(regexp_extract(trim({0}), '^(.*?)\s*\(([A-Za-z0-9][A-Za-z0-9.\-]{{0,7}})\)\s*$', 1)) ELSE trim({0}) END"
_PA = r"CASE WHEN trim(regexp_extract(trim({0}), '^(.*?)\s*\(([A-Za-z0-9][A-Za-z0-9.\-]{{0,7}})\)\s*$', 1)) <> '' THEN regexp_extract(trim({0}), '^(.*?)\s*\(([A-Za-z0-9][A-Za-z0-9.\-]{{0,7}})\)\s*$', 2) END"
_INI = r"""array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(trim({0}), '[\s\-]+'), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')),
    lambda w: w <> '' AND lower(w) NOT IN ('of','the','and','for','in','on','a','an','to','with')), lambda w: upper(substr(w, 1, 1))), '')"""


_TOKEN = r"""coalesce(length(replace(trim({0}), '.', '')) BETWEEN 2 AND 6 AND regexp_full_match(replace(trim({0}), '.', ''), '\\p{{L}}+')
    AND replace(trim({0}), '.', '') = upper(replace(trim({0}), '.', '')) AND replace(trim({0}), '.', '') <> lower(replace(trim({0}), '.', '')), false)"""


def _acronym_sql(a: str, b: str) -> str:
    """Whether two names abbreviate each other; the parts are computed once a name, see ``_PARTS``."""
    return f"""(coalesce({a}.par = lower(trim({b}.name)), false) OR coalesce({b}.par = lower(trim({a}.name)), false) OR coalesce({a}.par = {b}.base, false)
        OR coalesce({b}.par = {a}.base, false) OR {a}.base = {b}.base OR ({a}.token AND {b}.ini = {a}.plain) OR ({b}.token AND {a}.ini = {b}.plain))"""


@query("h16_h17_parenthetical", f"WITH v AS (SELECT entity_id, name AS a FROM entities WHERE name IS NOT NULL) SELECT entity_id, {_PB.format('a')} AS base, {_PA.format('a')} AS abbreviation, {_INI.format('a')} AS initials FROM v")
def h16(s, d):
    rows = table(s, d, "entities").where("name IS NOT NULL")
    return rows.select("entity_id", exprs.paren_base("name").alias("base"), exprs.paren_abbreviation("name").alias("abbreviation"), exprs.initials("name").alias("initials"))


_PARTS = (f"SELECT name, lower({_PB.format('name')}) AS base, lower({_PA.format('name')}) AS par, {_TOKEN.format('name')} AS token, {_INI.format(_PB.format('name'))} AS ini, "
          "upper(replace(name, '.', '')) AS plain")


@query("h19_acronym_match", f"""WITH v AS ({_PAIRS_SQL}), p AS ({_PARTS} FROM (SELECT a AS name FROM v UNION SELECT b FROM v))
    SELECT v.a, v.b, x.token, {_acronym_sql('x', 'y')} AS matched FROM v JOIN p x ON x.name = v.a JOIN p y ON y.name = v.b""")
def h19(s, d):
    return _texts(s, d).select("a", "b", exprs.acronym_token("a").alias("token"), exprs.acronym_match("a", "b").alias("matched"))


@query("h22_h25_folded_names", r"""SELECT entity_id, lower(strip_accents(replace(trim(regexp_replace(name, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}]+', ' ', 'g')), '™', 'TM'))) AS key,
    array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(domain, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}]+', ' ', 'g')), '\p{L}+|[^\p{L}]+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS domain
    FROM entities WHERE name IS NOT NULL""")
def h22(s, d):
    rows = table(s, d, "entities").where("name IS NOT NULL")
    return rows.select("entity_id", udfs.embedding_key("name").alias("key"), udfs.domain_name("domain").alias("domain"))


@query("h28_h29_labels_and_keys", r"""SELECT entity_id, type || '::' || lower(trim(name)) AS key, upper(substr(type, 1, 1)) || lower(substr(type, 2)) AS label FROM entities WHERE type IS NOT NULL AND name IS NOT NULL""")
def h29(s, d):
    rows = table(s, d, "entities").where("type IS NOT NULL AND name IS NOT NULL")
    return rows.select("entity_id", exprs.entity_key("type", "name").alias("key"), exprs.safe_label("type").alias("label"))


@query("h45_alias_curve", """SELECT entity_id, round(greatest(confidence, least(0.97E0, 0.97E0 - (0.97E0 - confidence) * exp(-0.08E0 * greatest(0, entity_id % 20 - 1)))), 6) AS confidence
    FROM entities WHERE confidence IS NOT NULL""")
def h45(s, d):
    rows = table(s, d, "entities").where("confidence IS NOT NULL")
    return rows.select("entity_id", r6(exprs.alias_curve("confidence", F.col("entity_id") % 20)).alias("confidence"))


ERRORS = ["HTTP 429", "Rate limit: tokens per day", "Connection reset", "boom", "quota of 5 per day", "RPD exceeded", "read timeout", "rate_limit per day", "RESOURCE_EXHAUSTED", ""]
_ERR = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(ERRORS)) + " END"
_ANY = lambda ws: "(" + " OR ".join(f"contains(e, '{w}')" for w in ws) + ")"


@query("h43_h44_errors", f"""WITH m AS (SELECT event_id, lower({_ERR}) AS e FROM events), k AS (SELECT event_id, CASE
    WHEN {_ANY(exprs.DAILY_WORDS)} OR (contains(e, 'per day') AND {_ANY(exprs.DAILY_LIMITS)}) THEN 'daily_quota' WHEN {_ANY(exprs.RATE_WORDS)} THEN 'rate_limit'
    WHEN {_ANY(exprs.NETWORK_WORDS)} THEN 'network' ELSE 'unknown' END AS kind FROM m)
    SELECT event_id, kind, CASE kind WHEN 'rate_limit' THEN 2E0 * pow(2E0, event_id % 4) WHEN 'network' THEN 2E0 * (event_id % 4 + 1) ELSE 2E0 END AS wait FROM k""")
def h43(s, d):
    message = F.element_at(F.array(*[F.lit(t) for t in ERRORS]), (F.col("event_id") % 10 + 1).cast("int"))
    rows = table(s, d, "events").select("event_id", exprs.classify_error(message).alias("kind"))
    return rows.select("event_id", "kind", exprs.backoff("kind", F.col("event_id") % 4).cast("double").alias("wait"))


@query("h48_backend", """SELECT s.source_doc, CAST(n * 1300 AS BIGINT) AS tokens, CASE WHEN s.tier = 3 OR n > 250 THEN 'large' ELSE 'small' END AS backend
    FROM (SELECT source_doc, max(tier) AS tier FROM source_docs GROUP BY 1) s JOIN (SELECT source_doc, count(*) AS n FROM chunks GROUP BY 1) c USING (source_doc)""")
def h48(s, d):
    docs = table(s, d, "source_docs").groupBy("source_doc").agg(F.max("tier").alias("tier"))
    n = table(s, d, "chunks").groupBy("source_doc").agg(F.count("*").alias("n"))
    return docs.join(n, "source_doc").select("source_doc", exprs.token_estimate("n").alias("tokens"), exprs.backend("tier", "n").alias("backend"))


# ------------------------------------------------------------------ curation and learning

@query("h46_decay", """SELECT entity_id, round(CASE WHEN last_updated < TIMESTAMP '2025-09-02 00:00:00' - INTERVAL 24 HOURS AND confidence > 0.3 THEN confidence * 0.95E0 ELSE confidence END, 6) AS confidence
    FROM entities""")
def h46(s, d):
    now = F.lit("2025-09-02 00:00:00").cast("timestamp_ntz")
    return curate.decay(table(s, d, "entities"), now).select("entity_id", r6("decayed").alias("confidence"))


@query("f4_top_entities", "SELECT entity_id, name, round(confidence, 6) AS confidence FROM entities WHERE confidence IS NOT NULL ORDER BY entities.confidence DESC, name, entity_id LIMIT 10")
def f4(s, d):
    return curate.top_entities(table(s, d, "entities")).select("entity_id", "name", r6("confidence").alias("confidence"))


_MKEY = "CASE WHEN trim(name) <> '' AND type IS NOT NULL THEN type || '::' || lower(trim(name)) END"


@query("n8_cooccurrence", f"""WITH m AS (SELECT chunk_id, {_MKEY} AS key, min(source_doc) AS source_doc FROM mentions WHERE {_MKEY} IS NOT NULL GROUP BY 1, 2)
    SELECT a.key AS key_a, b.key AS key_b, count(*) AS count, count(DISTINCT a.source_doc) AS docs FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.key < b.key GROUP BY 1, 2""")
def n8(s, d):
    m = table(s, d, "mentions").withColumn("key", F.when(F.trim("name") != "", F.concat(F.col("type"), F.lit("::"), F.lower(F.trim("name")))))
    return memory.pair_counts(m)


@query("t18_pair_memory", """WITH c AS (SELECT DISTINCT entity_a, type_a, entity_b, type_b, count, array_to_string(source_docs, ',') AS docs, flushed_at FROM cooccurrence_memory),
k AS (SELECT type_a || '::' || lower(trim(entity_a)) AS x, type_b || '::' || lower(trim(entity_b)) AS y, coalesce(count, 0) AS n FROM c)
SELECT least(x, y) AS key_a, greatest(x, y) AS key_b, CAST(sum(n) AS BIGINT) AS count FROM k WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""")
def t18(s, d):
    c = table(s, d, "cooccurrence_memory").withColumn("docs", F.array_join("source_docs", ",")).drop("source_docs").distinct()
    k = c.select(F.concat("type_a", F.lit("::"), F.lower(F.trim("entity_a"))).alias("x"), F.concat("type_b", F.lit("::"), F.lower(F.trim("entity_b"))).alias("y"),
                 F.coalesce("count", F.lit(0)).alias("n")).where("x IS NOT NULL AND y IS NOT NULL")
    return k.groupBy(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).agg(F.sum("n").alias("count"))


@query("c14_unlinked_pairs", lambda: f"WITH {_UNLINKED} SELECT * FROM u")
def c14(s, d):
    return _unlinked(s, d)


def _ent_aliases(s, d) -> DataFrame:
    e = table(s, d, "entities").where("name IS NOT NULL")
    return e.groupBy(F.lower(F.trim("name")).alias("alias_key")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("times_seen"), F.min("name").alias("canonical"))


@query("n28_learning_report", lambda: f"""WITH {_UNLINKED}, a AS (SELECT lower(trim(name)) AS k, max(confidence) AS c, count(*) AS n FROM entities WHERE name IS NOT NULL GROUP BY 1),
l AS (SELECT c, CASE WHEN n > 1 THEN greatest(c, least(0.97E0, 0.97E0 - (0.97E0 - c) * exp(-0.08E0 * greatest(0, n - 1)))) ELSE c END AS g FROM a)
SELECT (SELECT count(*) FROM l WHERE g > c) AS aliases_reinforced, (SELECT count(*) FROM u) AS unlinked_pairs, (SELECT count(DISTINCT coalesce(type, 'UNKNOWN')) FROM entities) AS types,
    (SELECT count(*) FROM entities) AS entities""")
def n28(s, d):
    e = table(s, d, "entities")
    return curate.learning_report(_ent_aliases(s, d), _unlinked(s, d), graph.type_stats(e)).select("aliases_reinforced", "unlinked_pairs", "types", "entities")


_UNLINKED = """m AS (SELECT DISTINCT chunk_id, trim(name) AS name FROM mentions WHERE trim(name) <> ''),
p AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS count FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 4),
u AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM relationships r WHERE least(r.from_name, r.to_name) = name_a AND greatest(r.from_name, r.to_name) = name_b))"""


def _unlinked(s, d) -> DataFrame:
    m = table(s, d, "mentions").select("chunk_id", F.trim("name").alias("key"), "source_doc").where("key <> ''")
    pairs = memory.pair_counts(m, 4).select(F.col("key_a").alias("name_a"), F.col("key_b").alias("name_b"), "count")
    linked = table(s, d, "relationships").where("from_name IS NOT NULL AND to_name IS NOT NULL").select(F.col("from_name").alias("src"), F.col("to_name").alias("dst"))
    return memory.unlinked_pairs(pairs, linked)


@query("f6_top_unlinked", f"WITH {_UNLINKED} SELECT * FROM u ORDER BY count DESC, name_a, name_b LIMIT 20")
def f6(s, d):
    return memory.top_unlinked(_unlinked(s, d))


_AT = "2025-09-02 00:00:00"


@query("l8_curate", f"""WITH {_REL_EDGES}, {_UNLINKED}, c AS (SELECT count(*) AS n FROM g JOIN entities a ON a.name = g.src JOIN entities b ON b.name = g.dst WHERE g.rel_type = 'DISPUTES'),
    d AS (SELECT entity_id, last_updated < TIMESTAMP '{_AT}' - INTERVAL 24 HOURS AND confidence > 0.3 AS hit, CASE WHEN last_updated < TIMESTAMP '{_AT}' - INTERVAL 24 HOURS AND confidence > 0.3
        THEN confidence * 0.95E0 ELSE confidence END AS confidence FROM entities),
    k AS (SELECT max(confidence) AS c, count(*) AS n FROM entities WHERE name IS NOT NULL GROUP BY lower(trim(name)))
    SELECT (SELECT count(*) FROM d) AS entities, (SELECT count(*) FROM g) AS relationships, (SELECT count(*) FROM d WHERE hit) AS decayed, (SELECT count(*) FROM d WHERE confidence < 0.3) AS stale,
    (SELECT n FROM c) AS conflicts, (SELECT count(*) FROM u) AS unlinked_pairs,
    (SELECT count(*) FROM k WHERE n > 1 AND least(0.97E0, 0.97E0 - (0.97E0 - c) * exp(-0.08E0 * greatest(0, n - 1))) > c) AS aliases_reinforced""")
def l8(s, d):
    return curate.run(table(s, d, "entities"), _rel_edges(s, d), _ent_aliases(s, d), _unlinked(s, d), _AT, "DISPUTES").summary


@query("l8_h49_digest", f"""WITH {_REL_EDGES}, {_UNLINKED}, d AS (SELECT * REPLACE (CASE WHEN last_updated < TIMESTAMP '{_AT}' - INTERVAL 24 HOURS AND confidence > 0.3 THEN confidence * 0.95E0 ELSE confidence END AS confidence) FROM entities),
    c AS (SELECT a.type, g.src, a.source_doc AS d1, b.source_doc AS d2 FROM g JOIN entities a ON a.name = g.src JOIN entities b ON b.name = g.dst WHERE g.rel_type = 'DISPUTES'),
    s AS (SELECT * FROM d WHERE confidence < 0.3)
    SELECT 'statistics' AS part, 'Total Entities: ' || (SELECT count(*) FROM d) AS line UNION ALL SELECT 'statistics', 'Total Relationships: ' || (SELECT count(*) FROM g)
    UNION ALL SELECT 'statistics', 'Average Confidence: ' || printf('%.2f', avg(confidence)) FROM d
    UNION ALL SELECT 'sources', '- ' || source_doc || ' (' || count(*) || ' entities)' FROM d WHERE source_doc IS NOT NULL GROUP BY source_doc
    UNION ALL SELECT 'conflicts', '- [' || coalesce(type, 'UNKNOWN') || '] ' || src || ': ' || coalesce(d1, 'unknown') || ' vs ' || coalesce(d2, 'unknown') FROM c
    UNION ALL SELECT 'conflicts', 'None' WHERE NOT EXISTS (SELECT 1 FROM c)
    UNION ALL SELECT 'stale', '- ' || coalesce(name, '') || ' (' || coalesce(type, 'UNKNOWN') || ') confidence:' || printf('%.2f', confidence) FROM s UNION ALL SELECT 'stale', 'None' WHERE NOT EXISTS (SELECT 1 FROM s)
    UNION ALL SELECT 'top', line FROM (SELECT '- [' || type || '] ' || name || ' (confidence:' || printf('%.2f', confidence) || ', source:' || source_doc || ')' AS line FROM d WHERE confidence IS NOT NULL ORDER BY confidence DESC, name, entity_id LIMIT 10)
    UNION ALL SELECT 'unlinked', line FROM (SELECT '- ' || name_a || ' <-> ' || name_b || ' (seen together ' || count || 'x)' AS line FROM u ORDER BY count DESC, name_a, name_b LIMIT 5)
    UNION ALL SELECT 'unlinked', 'None' WHERE NOT EXISTS (SELECT 1 FROM u)
    UNION ALL SELECT 'types', '- ' || coalesce(type, 'UNKNOWN') || ': ' || count(*) || ' entities, avg confidence ' || printf('%.4f', avg(coalesce(confidence, 0))) FROM d GROUP BY coalesce(type, 'UNKNOWN')""")
def l8d(s, d):
    return curate.run(table(s, d, "entities"), _rel_edges(s, d), _ent_aliases(s, d), _unlinked(s, d), _AT, "DISPUTES").digest.select("part", "line")


# ------------------------------------------------------------------ memories

_EVD = "SELECT l_partkey AS target, CAST(l_orderkey AS VARCHAR) AS source_doc, CAST(l_linenumber AS VARCHAR) AS chunk_id, 1E0 - l_discount AS confidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"


def _evidence(s, d) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_orderkey").cast("string").alias("source_doc"), F.col("l_linenumber").cast("string").alias("chunk_id"),
                                          (1 - F.col("l_discount")).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@query("n9_evidence_merge", f"""WITH e AS ({_EVD}), o AS (SELECT *, row_number() OVER (PARTITION BY target, source_doc, chunk_id ORDER BY seq) AS n FROM e)
SELECT target, source_doc, chunk_id, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, seq) AS rank FROM o WHERE n = 1) WHERE rank <= 50""")
def n9(s, d):
    return memory.evidence_merge(_evidence(s, d)).select("target", "source_doc", "chunk_id", r6("confidence").alias("confidence"))


@query("n10_reinforcement", f"""WITH e AS ({_EVD}), o AS (SELECT target, source_doc, chunk_id, arg_min(confidence, seq) AS c, min(seq) AS s FROM e GROUP BY 1, 2, 3)
SELECT target, count(*) AS records, round(least(1E0, arg_min(c, s) + 0.05E0 * (count(*) - 1)), 6) AS confidence FROM o GROUP BY 1""")
def n10(s, d):
    return memory.reinforced(_evidence(s, d)).select("target", "records", r6("confidence").alias("confidence"))


def _alias_events(s, d) -> DataFrame:
    ev = table(s, d, "events")
    return ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("alias_key"), F.col("event_type").alias("canonical"),
                     (0.90 + (F.col("event_id") % 10) / 100.0).alias("confidence"), F.struct("ts", "event_id").alias("seq"))


@query("j9_alias_fold", """WITH RECURSIVE e AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS k, event_type AS c, round(0.90E0 + (event_id % 10) / 100E0, 6) AS p,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE round(0.90E0 + (event_id % 10) / 100E0, 6) >= 0.93E0),
f AS (SELECT k, c, p, CAST(1 AS BIGINT) AS t, n FROM e WHERE n = 1
    UNION ALL SELECT f.k, CASE WHEN e.c = f.c THEN f.c WHEN e.p > f.p THEN e.c ELSE f.c END, CASE WHEN e.c = f.c THEN greatest(e.p, f.p) WHEN e.p > f.p THEN e.p ELSE f.p END,
    CASE WHEN e.c = f.c THEN f.t + 1 WHEN e.p > f.p THEN 1 ELSE f.t END, e.n FROM f JOIN e ON f.k = e.k AND e.n = f.n + 1)
SELECT k AS alias_key, c AS canonical, round(p, 6) AS confidence, t AS times_seen FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS r FROM f) WHERE r = 1""")
def j9(s, d):
    rows = _alias_events(s, d).withColumn("confidence", r6("confidence"))
    return memory.alias_fold(rows).select("alias_key", "canonical", r6("confidence").alias("confidence"), "times_seen")


@query("j10_alias_hits", """WITH a AS (SELECT lower(trim(name)) AS alias_key, max(confidence) AS c, count(*) AS t FROM entities WHERE name IS NOT NULL GROUP BY 1),
h AS (SELECT lower(trim(name)) AS alias_key, count(*) AS n FROM mentions GROUP BY 1)
SELECT a.alias_key, round(least(1E0, c + 0.01E0 * coalesce(n, 0)), 6) AS confidence, t + coalesce(n, 0) AS times_seen FROM a LEFT JOIN h USING (alias_key)""")
def j10(s, d):
    hits = table(s, d, "mentions").select(F.lower(F.trim("name")).alias("alias_key"))
    return memory.alias_hits(_ent_aliases(s, d), hits).select("alias_key", r6("confidence").alias("confidence"), "times_seen")


@query("j11_alias_remove", "SELECT DISTINCT lower(trim(name)) AS alias_key FROM entities WHERE name IS NOT NULL AND lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM entities WHERE name IS NOT NULL AND confidence < 0.4)")
def j11(s, d):
    bad = table(s, d, "entities").where("name IS NOT NULL AND confidence < 0.4").select(F.lower(F.trim("name")).alias("alias_key"))
    return memory.alias_remove(_ent_aliases(s, d), bad).select("alias_key")


@query("n14_entity_fold", """WITH RECURSIVE e AS (SELECT type || '::' || lower(trim(name)) AS k, trim(name) AS name, coalesce(extraction_confidence, 0.7E0) AS c,
    row_number() OVER (PARTITION BY type, lower(trim(name)) ORDER BY extracted_at NULLS FIRST, mention_id) AS n FROM mentions WHERE name IS NOT NULL AND type IS NOT NULL AND trim(name) <> ''),
f AS (SELECT k, c AS conf, [name] AS names, n FROM e WHERE n = 1
    UNION ALL SELECT f.k, CAST(round(CAST(CAST(0.7E0 * f.conf + 0.3E0 * e.c AS VARCHAR) AS DECIMAL(30, 20)), 4) AS DOUBLE), CASE WHEN list_contains(f.names, e.name) THEN f.names ELSE list_append(f.names, e.name) END, e.n FROM f JOIN e ON f.k = e.k AND e.n = f.n + 1)
SELECT k AS key, n AS occurrences, round(conf, 6) AS confidence, array_to_string(names, ' | ') AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS r FROM f) WHERE r = 1""")
def n14(s, d):
    m = table(s, d, "mentions").withColumn("key", exprs.entity_key("type", "name")).where("name IS NOT NULL AND type IS NOT NULL AND trim(name) <> ''")
    rows = m.select("key", F.trim("name").alias("name"), F.col("extraction_confidence").alias("confidence"), F.lit(None).cast("string").alias("domain"), F.struct("extracted_at", "mention_id").alias("seq"))
    return memory.entity_fold(rows).select("key", "occurrences", r6("confidence").alias("confidence"), F.array_join("aliases", " | ").alias("aliases"))


@query("e7_last_descriptions", """WITH x AS (SELECT type || '::' || lower(trim(name)) AS key, description, min(entity_id) AS s FROM entities WHERE description IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC) AS n FROM x) SELECT key, string_agg(description, ' | ' ORDER BY s) AS descriptions FROM r WHERE n <= 5 GROUP BY 1""")
def e7(s, d):
    rows = table(s, d, "entities").where("name IS NOT NULL AND type IS NOT NULL").select(exprs.entity_key("type", "name").alias("key"), "description", F.col("entity_id").alias("seq"))
    return memory.last_descriptions(rows).select("key", F.array_join("descriptions", " | ").alias("descriptions"))


@query("n18_reliability_fold", """WITH RECURSIVE seeds AS (SELECT source_doc AS k, greatest(0E0, least(1E0, 0.7E0 * (0.7E0 + 0.3E0 * coalesce(max(quality_score), 1E0)))) AS s FROM source_docs GROUP BY 1),
e AS (SELECT source_doc AS k, entity_id % 3 <> 0 AS won, row_number() OVER (PARTITION BY source_doc ORDER BY entity_id) AS n FROM entities),
f AS (SELECT k, s AS r, CAST(0 AS BIGINT) AS wins, CAST(0 AS BIGINT) AS losses, CAST(0 AS BIGINT) AS n FROM seeds
    UNION ALL SELECT f.k, round(CASE WHEN e.won THEN least(0.99E0, f.r + 0.03E0) ELSE greatest(0.2E0, f.r - 0.03E0) END, 4), f.wins + CASE WHEN e.won THEN 1 ELSE 0 END,
    f.losses + CASE WHEN e.won THEN 0 ELSE 1 END, e.n FROM f JOIN e ON f.k = e.k AND e.n = f.n + 1)
SELECT k AS source_doc, round(r, 6) AS reliability, wins, losses FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS x FROM f) WHERE x = 1""")
def n18(s, d):
    seeds = table(s, d, "source_docs").groupBy("source_doc").agg(memory.reliability_seed(F.max("quality_score")).alias("seed"))
    events = table(s, d, "entities").select("source_doc", (F.col("entity_id") % 3 != 0).alias("won"), F.col("entity_id").alias("seq"))
    return memory.reliability_fold(events, seeds).select("source_doc", r6("reliability").alias("reliability"), "wins", "losses")


_FALLBACK = r"""WITH RECURSIVE t AS ({0}), y AS ({1}), r AS (SELECT DISTINCT rel_id, relation, {2} AS k FROM relationships WHERE trim(relation) <> ''),
b AS (SELECT lower(k) AS k, relation AS raw, row_number() OVER (PARTITION BY lower(k) ORDER BY rel_id) AS n FROM r WHERE coalesce(k, '') <> '' AND k NOT IN (SELECT canonical FROM t) AND k NOT IN (SELECT raw FROM y)),
f AS (SELECT k, [raw] AS ex, n FROM b WHERE n = 1 UNION ALL SELECT f.k, CASE WHEN len(f.ex) < 5 AND NOT list_contains(f.ex, b.raw) THEN list_append(f.ex, b.raw) ELSE f.ex END, b.n FROM f JOIN b ON f.k = b.k AND b.n = f.n + 1),
z AS (SELECT k, ex, n, CASE WHEN n >= 4 THEN 'pending_review' ELSE 'collecting' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS x FROM f) WHERE x = 1)
"""


def _fallback() -> str:
    return _FALLBACK.format(_TYPES_SQL, _SYN_SQL, _OKEY)


@query("n16_friction_fold", lambda: _fallback() + """SELECT k AS key, n AS count, 0.3E0 AS avg_confidence, 'RELATED_TO' AS landing, array_to_string(ex, ' | ') AS examples, status FROM z""")
def n16(s, d):
    return _friction(s, d).select("key", "count", r6("avg_confidence").alias("avg_confidence"), "landing", F.array_join("raw_examples", " | ").alias("examples"), "status")


def _friction(s, d) -> DataFrame:
    rows = ontology.resolve_relations(table(s, d, "relationships").where("trim(relation) <> ''").select("rel_id", "relation").distinct()).where("method = 'fallback'")
    return memory.friction_fold(rows.select(F.lower(exprs.ontology_key("relation")).alias("key"), F.col("relation").alias("raw"), F.col("confidence"),
                                            F.col("canonical").alias("landing"), F.col("rel_id").alias("seq")))


@query("n17_friction_summary", lambda: _fallback() + """SELECT status, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS events, CASE WHEN status = 'pending_review' THEN
    (SELECT string_agg(k || ':' || n, ', ' ORDER BY n DESC, k) FROM (SELECT * FROM z WHERE status = 'pending_review' ORDER BY n DESC, k LIMIT 5)) END AS top FROM z GROUP BY 1""")
def n17(s, d):
    return memory.friction_summary(_friction(s, d)).select("status", "patterns", "events", F.array_join("top", ", ").alias("top"))


@query("j13_review", lambda: _fallback() + """SELECT DISTINCT unnest(ex) AS raw, upper(k) AS canonical FROM z WHERE status = 'pending_review' AND length(k) % 2 = 0""")
def j13(s, d):
    f = _friction(s, d)
    decided = f.where("status = 'pending_review'").select("key", F.when(F.length("key") % 2 == 0, "approve").otherwise("reject").alias("decision"), F.upper("key").alias("canonical"))
    return memory.review(f, decided)[1]


# ------------------------------------------------------------------ ontology and domains

_OKEY = r"regexp_replace(regexp_replace(upper(regexp_replace(trim(relation), '[^A-Za-z0-9_]', '_', 'g')), '_+', '_', 'g'), '^_|_$', '', 'g')"
_TYPES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for c, ts in ontology.CATEGORIES.items() for t in ts) + ") AS t(canonical, category)"
_SYN_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ontology.SYNONYMS.items()) + ") AS y(raw, canonical)"


@query("c18_ontology_resolve", f"""WITH t AS ({_TYPES_SQL}), y AS ({_SYN_SQL}), r AS (SELECT DISTINCT rel_id, relation, {_OKEY} AS k FROM relationships)
SELECT r.rel_id, CASE WHEN coalesce(k, '') = '' THEN NULL WHEN t.canonical IS NOT NULL THEN t.canonical WHEN y.canonical IS NOT NULL THEN y.canonical ELSE 'RELATED_TO' END AS canonical,
    CASE WHEN coalesce(k, '') = '' THEN 'invalid' WHEN t.canonical IS NOT NULL THEN 'exact' WHEN y.canonical IS NOT NULL THEN 'synonym' ELSE 'fallback' END AS method
FROM r LEFT JOIN t ON r.k = t.canonical LEFT JOIN y ON r.k = y.raw""")
def c18(s, d):
    rows = table(s, d, "relationships").select("rel_id", "relation").distinct()
    return ontology.resolve_relations(rows).select("rel_id", "canonical", "method")


@query("c19_types_of_category", f"SELECT DISTINCT canonical FROM ({_TYPES_SQL}) WHERE category IN ('REFERENTIAL', 'SEMANTIC')")
def c19(s, d):
    return ontology.types_of(ontology.relation_types(s), ["REFERENTIAL", "SEMANTIC"])


@query("c19_relation_noise_filter", f"WITH {EDG}, t AS ({_TYPES_SQL}) SELECT rel_type, count(*) AS edges FROM e WHERE rel_type NOT IN (SELECT canonical FROM t WHERE category = 'REFERENTIAL') GROUP BY 1")
def c19f(s, d):
    noise = ontology.types_of(ontology.relation_types(s), ["REFERENTIAL"])
    return ontology.without_types(edges(s, d), noise).groupBy("rel_type").agg(F.count("*").alias("edges"))


def _tree(s, d) -> DataFrame:
    seen = table(s, d, "entities").where("domain IS NOT NULL").groupBy(F.col("domain").alias("name")).agg(F.count("*").alias("times_seen"))
    return table(s, d, "domain_taxonomy").select(F.col("canonical").alias("name"), "parent").join(seen, "name", "left").withColumn("times_seen", F.coalesce("times_seen", F.lit(0)))


_TREE = """w AS (SELECT t.canonical AS name, t.parent, coalesce(n, 0) AS times_seen FROM domain_taxonomy t LEFT JOIN (SELECT domain, count(*) AS n FROM entities GROUP BY 1) e ON e.domain = t.canonical)"""


@query("c25_lineage", f"""WITH {_TREE} SELECT a.name, a.name || coalesce(' > ' || b.name, '') AS path, CASE WHEN b.name IS NULL THEN 1 ELSE 2 END::BIGINT AS depth FROM w a LEFT JOIN w b ON a.parent = b.name""")
def c25(s, d):
    return ontology.lineage(_tree(s, d)).select("name", F.array_join("path", " > ").alias("path"), n64("depth"))


@query("c26_siblings", f"WITH {_TREE} SELECT a.name, b.name AS sibling FROM w a JOIN w b ON lower(a.parent) = lower(b.parent) AND a.name <> b.name")
def c26(s, d):
    return ontology.siblings(_tree(s, d))


@query("n21_taxonomy_report", f"""WITH {_TREE} SELECT count(*) AS domains, count(*) FILTER (parent IS NULL) AS top_level, count(*) FILTER (times_seen < 3) AS niche,
    CAST(sum(times_seen) AS BIGINT) AS sightings FROM w""")
def n21(s, d):
    return ontology.taxonomy_report(_tree(s, d))


@query("n21_taxonomy_lists", f"""WITH {_TREE} SELECT 'top_level' AS list, name, times_seen FROM w WHERE parent IS NULL UNION ALL SELECT 'niche', name, times_seen FROM w WHERE times_seen < 3
    UNION ALL SELECT * FROM (SELECT 'popular', name, times_seen FROM w ORDER BY times_seen DESC, name LIMIT 10)""")
def n21l(s, d):
    return ontology.taxonomy_lists(_tree(s, d))


@query("f7_popular_domains", f"WITH {_TREE} SELECT name, times_seen FROM w ORDER BY times_seen DESC, name LIMIT 10")
def f7(s, d):
    return ontology.popular(_tree(s, d)).select("name", "times_seen")


@query("n22_explain_domains", f"""WITH {_TREE} SELECT a.name, a.times_seen, a.times_seen < 3 AS niche, a.name || coalesce(' > ' || b.name, '') AS path,
    coalesce((SELECT string_agg(c.name, ' | ' ORDER BY c.name) FROM w c WHERE lower(c.parent) = lower(a.parent) AND c.name <> a.name), '') AS siblings FROM w a LEFT JOIN w b ON a.parent = b.name""")
def n22(s, d):
    out = ontology.explain_domains(_tree(s, d))
    return out.select("name", "times_seen", "niche", F.array_join("path", " > ").alias("path"), F.array_join("siblings", " | ").alias("siblings"))


@query("h26_similar_domain")
def h26(s, d):
    tree = table(s, d, "domain_taxonomy").select(F.col("canonical").alias("name")).withColumn("seq", F.col("name"))
    return ontology.similar_domain(table(s, d, "entities").where("trim(domain) <> ''").select(F.col("domain").alias("raw")), tree).select("raw", "domain")


# ------------------------------------------------------------------ documents

def _pages(s, d) -> DataFrame:
    docs = table(s, d, "documents").where("text IS NOT NULL")
    return docs.select(F.col("doc_id").cast("string").alias("filename"), F.lit(1).alias("page"), F.lit(2).alias("page_count"), "text",
                       F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 2).otherwise(3).alias("tier"),
                       F.when(F.col("doc_id") % 7 == 0, "references").otherwise("body").alias("section"))


@query("e1_chunk_windows", r"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS filename, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier, CASE WHEN doc_id % 7 = 0 THEN 'references' ELSE 'body' END AS section,
    list_filter(regexp_split_to_array(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
z AS (SELECT *, CASE tier WHEN 1 THEN 500 WHEN 2 THEN 800 ELSE 1200 END AS size, CASE tier WHEN 1 THEN 450 WHEN 2 THEN 700 ELSE 1050 END AS stride FROM p WHERE len(w) >= 20 AND NOT (section = 'references' AND tier >= 2)),
c AS (SELECT filename, unnest(range(0, len(w), stride)) AS start, size, stride, w FROM z)
SELECT filename, CAST(start / stride AS BIGINT) AS "window", CAST(len(w[start + 1 : start + size]) AS BIGINT) AS words, md5(array_to_string(w[start + 1 : start + size], ' ')) AS digest FROM c WHERE len(w[start + 1 : start + size]) >= 20""")
def e1(s, d):
    return documents.chunk_windows(_pages(s, d)).select("filename", n64("window"), F.size(F.split("text", " ")).cast("bigint").alias("words"), F.md5("text").alias("digest"))


@query("f5_priority_chunks", """SELECT chunk_id, CAST(rn - 1 AS BIGINT) AS chunk_index FROM (SELECT c.chunk_id, row_number() OVER (PARTITION BY c.source_doc ORDER BY CASE WHEN s.tier = 3 THEN -c.weight ELSE 0E0 END, c.page, c.chunk_index, c.chunk_id) AS rn
    FROM (SELECT DISTINCT chunk_id, source_doc, page, chunk_index, weight FROM chunks) c JOIN (SELECT source_doc, max(tier) AS tier FROM source_docs GROUP BY 1) s USING (source_doc))""")
def f5(s, d):
    tiers = table(s, d, "source_docs").groupBy("source_doc").agg(F.max("tier").alias("tier"))
    rows = table(s, d, "chunks").select("chunk_id", "source_doc", "page", "chunk_index", "weight").distinct().join(tiers, "source_doc")
    rows = rows.select("chunk_id", F.col("source_doc").alias("filename"), "page", F.struct("chunk_index", "chunk_id").alias("window"), "weight", "tier")
    return documents.priority_order(rows).select("chunk_id", n64("chunk_index"))


_HAS = lambda ws: "(" + " OR ".join(f"contains(h, '{w}')" for w in ws) + ")"


@query("h31_detect_section", f"""WITH c AS (SELECT DISTINCT chunk_id, lower(substr(text, 1, 500)) AS h, page * 1E0 / greatest(s.page_count, 1) AS p FROM chunks JOIN (SELECT source_doc, max(page_count) AS page_count FROM source_docs GROUP BY 1) s USING (source_doc)
    WHERE text IS NOT NULL AND page IS NOT NULL AND page_count IS NOT NULL)
SELECT chunk_id, CASE WHEN p < 0.1 THEN CASE WHEN {_HAS(exprs.FRONT_WORDS)} THEN 'abstract' ELSE 'front_matter' END WHEN p > 0.85 THEN CASE WHEN {_HAS(exprs.BACK_WORDS)} THEN 'back_matter' ELSE 'conclusion' END
    {' '.join(f"WHEN {_HAS(ws)} THEN '{n}'" for n, ws in exprs.SECTION_WORDS)} ELSE 'body' END AS section FROM c""")
def h31(s, d):
    counts = table(s, d, "source_docs").groupBy("source_doc").agg(F.max("page_count").alias("page_count"))
    rows = table(s, d, "chunks").join(counts, "source_doc").where("text IS NOT NULL AND page IS NOT NULL AND page_count IS NOT NULL")
    return rows.select("chunk_id", exprs.detect_section("text", "page", "page_count").alias("section")).distinct()


@query("e6_batches", "SELECT DISTINCT chunk_id, CAST(floor(chunk_index / 3) AS BIGINT) AS batch FROM chunks")
def e6(s, d):
    return documents.batches(table(s, d, "chunks")).select("chunk_id", F.col("batch").cast("bigint").alias("batch")).distinct()


_MEN = "SELECT lower(trim(name)) AS name_key, type, mention_id AS seq FROM mentions WHERE name IS NOT NULL AND type IS NOT NULL"


def _named(s, d) -> DataFrame:
    return table(s, d, "mentions").where("name IS NOT NULL AND type IS NOT NULL").select(F.lower(F.trim("name")).alias("name_key"), "type", F.col("mention_id").alias("seq"))


@query("n1_type_vote", f"""WITH m AS ({_MEN}), g AS (SELECT name_key, type, count(*) AS n, min(seq) AS f FROM m GROUP BY 1, 2)
SELECT name_key, type FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY n DESC, f) AS r FROM g) WHERE r = 1""")
def n1(s, d):
    return documents.type_vote(_named(s, d))


@query("n2_first_occurrence", f"WITH m AS ({_MEN}) SELECT name_key, type, min(seq) AS seq FROM m GROUP BY 1, 2")
def n2(s, d):
    return documents.first_occurrences(_named(s, d).distinct())


@query("c20_retype", f"""WITH m AS ({_MEN}), g AS (SELECT name_key, type, count(*) AS n, min(seq) AS f FROM m GROUP BY 1, 2),
v AS (SELECT name_key, type FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY n DESC, f) AS r FROM g) WHERE r = 1)
SELECT DISTINCT rel_id, coalesce(a.type, from_type) AS from_type, coalesce(b.type, to_type) AS to_type FROM relationships r
LEFT JOIN v a ON lower(trim(r.from_name)) = a.name_key LEFT JOIN v b ON lower(trim(r.to_name)) = b.name_key""")
def c20(s, d):
    return documents.retype_relationships(table(s, d, "relationships"), documents.type_vote(_named(s, d))).select("rel_id", "from_type", "to_type").distinct()


@query("n27_quality", "SELECT source_doc AS filename, round(count(*) FILTER (trim(text) <> '') / count(*), 2) AS quality_score FROM chunks GROUP BY 1")
def n27(s, d):
    return documents.quality_scores(table(s, d, "chunks").withColumnRenamed("source_doc", "filename"))


@query("b15_quality_gate", """SELECT source_doc, CASE WHEN coalesce(p, 0) = 0 AND coalesce(n, 0) = 0 THEN 'rejected' ELSE 'accepted' END AS status
    FROM (SELECT source_doc, max(page_count) AS p FROM source_docs GROUP BY 1) LEFT JOIN (SELECT source_doc, count(*) AS n FROM chunks GROUP BY 1) USING (source_doc)""")
def b15(s, d):
    docs = table(s, d, "source_docs").groupBy("source_doc").agg(F.max("page_count").alias("page_count"))
    n = table(s, d, "chunks").groupBy("source_doc").agg(F.count("*").alias("chunk_count"))
    return documents.quality_gate(docs.join(n, "source_doc", "left")).select("source_doc", "status")


@query("n3_summaries", """WITH x AS (SELECT source_doc AS filename, description, entity_id, row_number() OVER (PARTITION BY source_doc ORDER BY entity_id) AS n FROM entities WHERE trim(description) <> '')
SELECT filename, string_agg(description, ' ' ORDER BY entity_id) AS summary FROM x WHERE n <= 3 GROUP BY 1""")
def n3(s, d):
    return documents.summaries(table(s, d, "entities").select(F.col("source_doc").alias("filename"), F.col("description").alias("summary"), F.col("entity_id").alias("seq")))


@query("g3_vector_rows", """SELECT type, source_doc, page, md5(text) AS digest FROM (SELECT 'chunk' AS type, source_doc, CAST(page AS BIGINT) AS page, text FROM chunks UNION ALL SELECT 'claim', source_doc, 0, description FROM entities) WHERE trim(text) <> ''""")
def g3(s, d):
    claims = table(s, d, "entities").select(F.col("description").alias("text"), "source_doc", F.lit(0).alias("page"))
    return documents.vector_rows(table(s, d, "chunks"), claims).select("type", "source_doc", n64("page"), F.md5("text").alias("digest"))


@query("n20_n26_ingest_report", """WITH e AS (SELECT source_doc, count(*) AS entities, count(*) FILTER (confidence IS NOT NULL) AS w FROM entities GROUP BY 1), r AS (SELECT source_doc, count(*) AS relationships FROM relationships GROUP BY 1),
c AS (SELECT source_doc, count(*) AS chunks FROM chunks GROUP BY 1)
SELECT source_doc, coalesce(entities, 0) AS entities, coalesce(w, 0) AS entities_written, coalesce(relationships, 0) AS relationships, coalesce(chunks, 0) AS chunks,
    round(CASE WHEN coalesce(entities, 0) > 0 THEN 1E0 - w * 1E0 / entities ELSE 0E0 END, 6) AS unwritten_rate FROM e FULL JOIN r USING (source_doc) FULL JOIN c USING (source_doc) WHERE source_doc IS NOT NULL""")
def n20(s, d):
    e = table(s, d, "entities").withColumn("written", F.col("confidence").isNotNull())
    out = documents.ingest_report(e, table(s, d, "relationships"), table(s, d, "chunks")).where("source_doc IS NOT NULL")
    return out.withColumn("unwritten_rate", r6("unwritten_rate"))


# ------------------------------------------------------------------ sessions and quotas

_TURNS = """SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type || ' ' || CAST(event_id AS VARCHAR) AS question, event_id FROM events"""


def _turns(s, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(s, d, "events").withColumn("turn", F.row_number().over(w))
    return ev.select(F.col("user_id").alias("session_id"), "turn", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("question"),
                     F.when(F.col("event_id") % 2 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("mentions"), F.array("event_type").alias("linked"), "event_id")


@query("e2_e3_session_context", f"""WITH t AS ({_TURNS}) SELECT event_id, coalesce(string_agg('Q: ' || question, chr(10)) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context FROM t""")
def e2(s, d):
    return sessions.history(_turns(s, d)).select("event_id", "context")


@query("e4_carry_forward", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') END AS used FROM events""")
def e4(s, d):
    return sessions.carried(_turns(s, d)).select("event_id", F.array_join("used", ",").alias("used"))


@query("j20_session_clear", f"WITH t AS ({_TURNS}) SELECT session_id, count(*) AS turns FROM t WHERE session_id % 5 <> 0 GROUP BY 1")
def j20(s, d):
    gone = table(s, d, "events").where("user_id % 5 = 0").select(F.col("user_id").alias("session_id"))
    return sessions.clear(_turns(s, d), gone).groupBy("session_id").agg(F.count("*").alias("turns"))


@query("e5_rolling_minute", """SELECT a.event_id, count(*) AS in_window FROM (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events) a JOIN (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events) b
    ON a.event_type = b.event_type AND b.at BETWEEN a.at - 599 AND a.at GROUP BY 1""")
def e5(s, d):
    calls = table(s, d, "events").select("event_id", F.col("event_type").alias("provider"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return sessions.rolling_calls(calls, 600).select("event_id", "in_window")


@query("n24_quota_stats", """WITH c AS (SELECT event_type AS provider, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events),
w AS (SELECT a.provider, a.event_id, count(*) AS n FROM c a JOIN c b ON a.provider = b.provider AND b.at BETWEEN a.at - 599 AND a.at GROUP BY 1, 2)
SELECT provider, count(*) AS calls, count(*) FILTER (n > 4) AS over, round(100E0 * count(*) FILTER (n > 4) / count(*), 6) AS over_percent FROM w GROUP BY 1""")
def n24(s, d):
    calls = table(s, d, "events").select("event_id", F.col("event_type").alias("provider"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return sessions.quota_stats(calls, 5, seconds=600).withColumn("over_percent", r6("over_percent"))


# ------------------------------------------------------------------ registry

def _registry(s, d) -> DataFrame:
    docs = table(s, d, "documents").where("text IS NOT NULL")
    return docs.select(F.col("doc_id").cast("string").alias("filename"), F.md5("text").alias("md5"), F.lit("processed").alias("status"), F.lit(None).cast("string").alias("error"),
                       F.col("created_at").cast("timestamp").alias("at"))


@query("c24_registry_antijoin", """SELECT min(path) AS path, md5 FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, md5(text) AS md5 FROM documents WHERE text IS NOT NULL)
    WHERE md5 NOT IN (SELECT md5(text) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0) GROUP BY md5""")
def c24(s, d):
    files = table(s, d, "documents").where("text IS NOT NULL").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.md5("text").alias("md5"))
    # Every file against a registry that holds what was there before: the even ones.
    return store.unseen(files, _registry(s, d).where("filename % 2 = 0")).select("path", "md5")


@query("n23_registry_stats", "SELECT count(*) AS processed, CAST(0 AS BIGINT) AS failed, count(DISTINCT md5(text)) AS fingerprints FROM documents WHERE text IS NOT NULL")
def n23(s, d):
    return store.registry_stats(_registry(s, d))


@query("a10_log_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def a10(s, d):
    return store.recent(table(s, d, "events"), 10, "event_id").select("event_id", "event_type")


# ------------------------------------------------------------------ resolution, reconciliation, retrieval

_NAME_KEY = r"regexp_replace(regexp_replace(lower(trim({0})), '\s+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g')"


@query("c3_c16_link_mentions", f"""WITH e AS (SELECT name, arg_max(type, coalesce(confidence, -1) * 1E9 - entity_id) AS type FROM entities WHERE name IS NOT NULL GROUP BY 1),
a AS (SELECT lower(trim(name)) AS k, max(confidence) AS c, min(name) AS canonical FROM entities WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
t AS (SELECT m.mention_id, m.name, a.canonical, a.c, coalesce(a.canonical, m.name) AS target FROM (SELECT DISTINCT mention_id, name FROM mentions WHERE name IS NOT NULL) m LEFT JOIN a ON {_NAME_KEY.format('m.name')} = a.k)
SELECT t.mention_id, e.name AS entity, round(CASE WHEN canonical IS NULL THEN 1E0 ELSE coalesce(c, 1E0) END, 6) AS link_confidence, CASE WHEN canonical IS NULL THEN 'exact' ELSE 'alias' END AS link_source
FROM t JOIN e ON t.target = e.name WHERE e.type IS NOT NULL""")
def c16(s, d):
    asked = table(s, d, "mentions").where("name IS NOT NULL").select("mention_id", F.col("name").alias("mention")).distinct()
    aliases = _ent_aliases(s, d).where("times_seen > 1")
    return resolve.link_mentions(asked, table(s, d, "entities"), aliases).select("mention_id", "entity", r6("link_confidence").alias("link_confidence"), "link_source")


@query("c10_acronym_pairs", f"""WITH p AS ({_PARTS}, entity_id, type, domain FROM entities WHERE name IS NOT NULL) SELECT a.entity_id AS new_id, b.entity_id FROM p a JOIN p b ON a.type = b.type
    WHERE a.entity_id <> b.entity_id AND (a.domain IS NULL OR b.domain IS NULL OR a.domain = b.domain) AND lower(a.name) <> lower(b.name) AND {_acronym_sql('a', 'b')}""")
def c10(s, d):
    e = table(s, d, "entities")
    return resolve.acronym_pairs(e.withColumnRenamed("entity_id", "new_id"), e).where("new_id <> entity_id").select("new_id", "entity_id")


@query("l5_resolution_cascade")
def l5(s, d):
    """All entities against all: aliases seen three times or more, then the other stages; the typo stage asks the referee."""
    e = table(s, d, "entities").where("name IS NOT NULL AND type IS NOT NULL")
    aliases = _ent_aliases(s, d).where("times_seen > 2")
    out = resolve.resolve(e.withColumnRenamed("entity_id", "new_id"), e, aliases, confirm=providers.referee)
    return out.select("new_id", "canonical", r6("confidence").alias("confidence"), "method")


@query("c21_duplicate_groups")
def c21(s, d):
    return resolve.duplicate_groups(table(s, d, "entities")).select("type", "group_id", "entity_id")


@query("h47_pick_canonical")
def h47(s, d):
    return resolve.pick_canonical(resolve.duplicate_groups(table(s, d, "entities")))


@query("c2_conflict_candidates", """SELECT a.entity_id AS new_id, b.entity_id AS old_id FROM entities a JOIN entities b ON a.name = b.name AND a.type = b.type WHERE a.source_doc IS DISTINCT FROM b.source_doc AND (coalesce(a.description, '') <> '' OR coalesce(b.description, '') <> '')""")
def c2(s, d):
    e = table(s, d, "entities")
    return reconcile.candidates(e, e).select("new_id", "old_id")


@query("n25_reconcile_outcomes", """WITH c AS (SELECT coalesce(a.description, '') AS n, coalesce(b.description, '') AS o FROM entities a JOIN entities b ON a.name = b.name AND a.type = b.type WHERE a.source_doc IS DISTINCT FROM b.source_doc AND (coalesce(a.description, '') <> '' OR coalesce(b.description, '') <> ''))
SELECT count(*) AS found, count(*) FILTER (n = '' OR o = '') AS resolved, count(*) FILTER (n <> '' AND o <> '') AS flagged, CAST(0 AS BIGINT) AS unverified FROM c""")
def n25(s, d):
    e = table(s, d, "entities")
    return reconcile.outcomes(providers.judge(reconcile.candidates(e, e)))


@query("c22_claims_or_any", """WITH p AS (SELECT v.* FROM vec_points v WHERE source_doc IN (SELECT source_doc FROM source_docs)),
o AS (SELECT source_doc, vec_id, row_number() OVER (PARTITION BY source_doc ORDER BY confidence DESC NULLS LAST, vec_id) AS rank FROM p WHERE type = 'claim'),
a AS (SELECT source_doc, vec_id, row_number() OVER (PARTITION BY source_doc ORDER BY confidence DESC NULLS LAST, vec_id) AS rank FROM p WHERE source_doc NOT IN (SELECT source_doc FROM o))
SELECT source_doc, vec_id, rank FROM o WHERE rank <= 10 UNION ALL SELECT source_doc, vec_id, rank FROM a WHERE rank <= 8""")
def c22(s, d):
    out = reconcile.claims_or_any(table(s, d, "source_docs"), table(s, d, "vec_points"))
    return out.select("source_doc", "vec_id", n64("rank"))


@query("c23_rank_claims", """WITH q AS (SELECT source_doc, min(vec_id) AS entity_id FROM vec_points WHERE type = 'entity' AND len(embedding) = 64 GROUP BY 1), n AS (SELECT q.source_doc, q.entity_id, v.embedding AS ve FROM q JOIN vec_points v ON v.vec_id = q.entity_id),
s AS (SELECT n.entity_id, c.vec_id, list_dot_product(CAST(ve AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(ve AS DOUBLE[]), CAST(ve AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1E-8) AS score
    FROM n JOIN vec_points c ON c.source_doc = n.source_doc AND c.type = 'claim' AND len(c.embedding) = 64)
SELECT entity_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def c23(s, d):
    p = table(s, d, "vec_points").where("size(embedding) = 64")
    first = p.where("type = 'entity'").groupBy("source_doc").agg(F.min_by("embedding", "vec_id").alias("vector"), F.min("vec_id").alias("entity_id"))
    return reconcile.rank_claims(first, p.where("type = 'claim'").select("source_doc", "vec_id", "embedding")).select("entity_id", "vec_id", r6("score").alias("score"), n64("rank"))


@query("h39_format_facts", _HOPS + f"""SELECT row_number() OVER (ORDER BY score DESC, hops, anchor, related) AS number, '[G' || row_number() OVER (ORDER BY score DESC, hops, anchor, related) || ']'
    || CASE WHEN contains('>' || chain || '>', '>CONTRADICTS>') THEN ' [CONFLICT SIGNAL]' ELSE '' END || ' ' || anchor || ' --' || replace(chain, '>', ' -> ') || '--> ' || related || ' ('
    || CASE WHEN related = 'S1' THEN 'SUPPLIER' ELSE 'UNKNOWN' END || ', confidence ' || printf('%.2f', score) || ')' AS line FROM (SELECT * FROM ({_BEST.format(2)}) ORDER BY score DESC, hops, anchor, related LIMIT 20)""")
def h39(s, d):
    facts = graph.top_facts(graph.best_paths(_trails(s, d, 2, facts=20)).withColumn("score", r6("score")), 20)
    types = s.createDataFrame([("S1", "SUPPLIER")], "name string, type string")
    return retrieve.numbered_facts(facts, types).select(n64("number"), "line")


@query("l1_retrieve_context")
def l1(s, d):
    facts, hits = retrieve.retrieve(edges(s, d), table(s, d, "vec_points"), s.createDataFrame([(a,) for a in ANCHORS], "anchor string"),
                                    _asked(s, d).orderBy("query_id").limit(1), exclude=["AUTHORED_BY"])
    types = s.createDataFrame([], "name string, type string")
    points = table(s, d, "vec_points").select("vec_id", "source_doc")
    lines = hits.join(points, "vec_id").select(F.col("rank"), "source_doc", F.lit(0).alias("page"), F.col("vec_id").cast("string").alias("text"))
    return retrieve.context({"FACTS": retrieve.numbered_facts(facts, types), "PASSAGES": retrieve.numbered_hits(lines)})


@query("k9_grounded", "SELECT CAST(0 AS BIGINT) AS facts, count(*) AS hits, CAST(NULL AS VARCHAR) AS answer FROM documents")
def k9(s, d):
    return retrieve.grounded(s.createDataFrame([], "a int"), table(s, d, "documents"))


@query("k1_encode_distinct", "SELECT entity_id, CAST(64 AS BIGINT) AS length FROM entities WHERE name IS NOT NULL")
def k1(s, d):
    rows = table(s, d, "entities").where("name IS NOT NULL").select("entity_id", "name")
    return providers.encode_distinct(rows, "name", providers.encoder()).select("entity_id", F.size("embedding").cast("bigint").alias("length"))


def _parsed(s, d) -> DataFrame:
    docs = table(s, d, "documents").where("text IS NOT NULL")
    page = F.struct(F.lit(1).alias("page"), F.col("text"), F.length("text").alias("char_count"), F.lit("body").alias("section"))
    return docs.select(F.col("doc_id").cast("string").alias("filename"), F.lit(1).alias("page_count"), F.lit(1).alias("tier"), F.lit(1.0).alias("quality_score"), F.array(page).alias("pages"))


@query("l6_extract_knowledge")
def l6(s, d):
    known = ingest.extract_knowledge(_parsed(s, d))
    return known.entities.select("filename", "name", "type", r6("confidence").alias("confidence"))


@query("k2_extracted_claims")
def k2(s, d):
    return ingest.extract_knowledge(_parsed(s, d)).claims.select("filename", "chunk_id", "text")


@query("j18_rewrite_aliases")
def j18(s, d):
    groups = resolve.duplicate_groups(table(s, d, "entities"))
    out = ingest.rewrite_aliases(_ent_aliases(s, d), groups, resolve.pick_canonical(groups))
    return out.select("alias_key", "canonical", r6("confidence").alias("confidence"))


@query("a15_hydrate", """SELECT type || '::' || lower(trim(name)) AS key, max(coalesce(nullif(confidence, 0), 0.7)) AS confidence, count(*) AS occurrences,
    max(coalesce(description, '')) AS description FROM entities WHERE name IS NOT NULL AND type IS NOT NULL GROUP BY 1""")
def a15(s, d):
    return memory.hydrate(table(s, d, "entities")).select("key", "confidence", "occurrences", "description")


@query("a30_reliability_get", """SELECT DISTINCT m.source_doc, coalesce(r.reliability, 0.7) AS reliability FROM mentions m
    LEFT JOIN (SELECT source_doc, max(quality_score) AS reliability FROM source_docs WHERE tier = 1 GROUP BY 1) r USING (source_doc)""")
def a30(s, d):
    known = table(s, d, "source_docs").where("tier = 1").groupBy("source_doc").agg(F.max("quality_score").alias("reliability"))
    return memory.reliability_of(table(s, d, "mentions"), known)


@query("n19_reliability_seed", """SELECT source_doc, round(greatest(0E0, least(1E0, 0.7E0 * (0.7E0 + 0.3E0 * coalesce(max(quality_score), 1E0)))), 6) AS reliability FROM source_docs GROUP BY 1""")
def n19(s, d):
    return table(s, d, "source_docs").groupBy("source_doc").agg(r6(memory.reliability_seed(F.max("quality_score"))).alias("reliability"))


_CLAIMS = """v AS (SELECT source_doc, min(vec_id) AS id FROM vec_points WHERE type = 'entity' AND len(embedding) = 64 GROUP BY 1),
q AS (SELECT DISTINCT e.name, e.source_doc, CAST(x.embedding AS DOUBLE[]) AS ve FROM entities e JOIN v USING (source_doc) JOIN vec_points x ON x.vec_id = v.id WHERE e.name IS NOT NULL),
pool AS (SELECT *, 10 AS most FROM vec_points WHERE type = 'claim' UNION ALL SELECT *, 8 FROM vec_points WHERE source_doc IS NOT NULL AND source_doc NOT IN (SELECT source_doc FROM vec_points WHERE type = 'claim' AND source_doc IS NOT NULL)),
sc AS (SELECT q.name, q.source_doc, p.vec_id, most, list_dot_product(ve, CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(ve, ve)) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1E-8) AS score
    FROM q JOIN pool p ON p.source_doc = q.source_doc AND len(p.embedding) = 64),
rk AS (SELECT *, row_number() OVER (PARTITION BY name, source_doc ORDER BY round(score, 12) DESC, vec_id) AS rank FROM sc),
cl AS (SELECT name, source_doc, string_agg('- text ' || vec_id, chr(10) ORDER BY rank) AS claims FROM rk WHERE rank <= most GROUP BY 1, 2)"""
_CONFLICTS = """c AS (SELECT a.entity_id AS new_id, b.entity_id AS old_id, a.name, a.type, a.source_doc AS nd, b.source_doc AS od, coalesce(a.description, '') AS n, coalesce(b.description, '') AS o
    FROM entities a JOIN entities b ON a.name = b.name AND a.type = b.type WHERE a.source_doc IS DISTINCT FROM b.source_doc AND (coalesce(a.description, '') <> '' OR coalesce(b.description, '') <> ''))"""


def _entity_claims(s, d) -> DataFrame:
    points = table(s, d, "vec_points").withColumn("text", F.concat(F.lit("text "), F.col("vec_id").cast("string")))
    first = points.where("type = 'entity' AND size(embedding) = 64").groupBy("source_doc").agg(F.min_by("embedding", "vec_id").alias("vector"))
    asked = table(s, d, "entities").where("name IS NOT NULL").select("name", "source_doc").distinct().join(first, "source_doc")
    return reconcile.claims_for(asked, points)


@query("h42_reconcile_prompt", f"""WITH {_CLAIMS}, {_CONFLICTS} SELECT new_id, old_id, 'Entity: ' || c.name || ' (type: ' || type || ')' || chr(10) || chr(10) || 'Source 1 - ' || coalesce(od, 'unknown') || ':' || chr(10)
    || 'Description: "' || o || '"' || chr(10) || 'Relevant claims:' || chr(10) || coalesce(x.claims, '{reconcile.NO_CLAIMS}') || chr(10) || chr(10) || 'Source 2 - ' || coalesce(nd, 'unknown') || ':' || chr(10)
    || 'Description: "' || n || '"' || chr(10) || 'Relevant claims:' || chr(10) || coalesce(y.claims, '{reconcile.NO_CLAIMS}') || chr(10) || chr(10) || '{reconcile.INSTRUCTION}' AS prompt
    FROM c LEFT JOIN cl x ON x.name = c.name AND x.source_doc = od LEFT JOIN cl y ON y.name = c.name AND y.source_doc = nd""")
def h42(s, d):
    e = table(s, d, "entities")
    return reconcile.prompt(reconcile.with_claims(reconcile.candidates(e, e), _entity_claims(s, d))).select("new_id", "old_id", "prompt")


_VERDICT = f"""CASE WHEN n = '' THEN 'KEEP_DOC1' WHEN o = '' THEN 'KEEP_DOC2' WHEN len({_NUMS.format('n')}) > 0 AND len({_NUMS.format('o')}) > 0 AND {_NUMS.format('n')} <> {_NUMS.format('o')} THEN 'KEEP_DOC2' ELSE 'KEEP_BOTH' END"""


@query("l7_reconcile", f"""WITH {_CONFLICTS}, j AS (SELECT *, {_VERDICT} AS v FROM c), l AS (SELECT name, type, od AS doc, min(nd) AS by_doc FROM j WHERE v = 'KEEP_DOC2' AND od IS NOT NULL GROUP BY 1, 2, 3)
    SELECT e.entity_id, round(CASE WHEN l.by_doc IS NULL THEN confidence ELSE confidence * 0.6E0 END, 6) AS confidence, l.by_doc AS superseded_by,
    (SELECT count(*) FROM (SELECT DISTINCT name, nd, od FROM j WHERE v = 'KEEP_BOTH')) AS open_conflicts,
    (SELECT count(*) FROM j WHERE v <> 'KEEP_BOTH' AND (CASE WHEN v = 'KEEP_DOC2' THEN nd ELSE od END) IS NOT NULL) AS wins
    FROM entities e LEFT JOIN l ON l.name = e.name AND l.type = e.type AND l.doc = e.source_doc""")
def l7(s, d):
    e = table(s, d, "entities")
    done = reconcile.reconcile(e, e, _entity_claims(s, d), providers.judge)
    counts = done.edges.agg(F.count("*").alias("open_conflicts")).join(F.broadcast(done.reliability.agg(F.count(F.when(F.col("won"), 1)).alias("wins"))), F.lit(True))
    return done.entities.select("entity_id", r6("confidence").alias("confidence"), "superseded_by").join(F.broadcast(counts), F.lit(True))


_QUESTION = "Which metrology institute with a gradient"


@query("l4_analyst_context", f"""WITH {_REL_EDGES}, {_COS}, one AS (SELECT s.*, v.source_doc FROM s JOIN vec_points v USING (vec_id) WHERE query_id = (SELECT min(query_id) FROM q)),
ch AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, vec_id) AS rank FROM one), km AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, vec_id) AS rank FROM one WHERE type = 'claim'),
w AS (SELECT * FROM (VALUES (0, 'metrology'), (1, 'institute'), (2, 'gradient')) AS v(n, word)),
h AS (SELECT * FROM (SELECT w.n, w.word, e.entity_id, e.name, e.type, e.source_doc, e.confidence, row_number() OVER (PARTITION BY w.n
    ORDER BY e.confidence DESC NULLS LAST, e.name, e.type, coalesce(e.domain, ''), e.entity_id) AS rn FROM w JOIN entities e ON contains(lower(e.name), w.word)) WHERE rn <= 5),
x AS (SELECT h.*, coalesce(array_to_string(list_slice(list_sort(list(DISTINCT g.rel_type || ' -> ' || g.dst) FILTER (g.rel_type IS NOT NULL)), 1, 3), ', '), '') AS rels FROM h LEFT JOIN g ON g.src = h.name GROUP BY ALL)
SELECT 1 AS section, '[' || coalesce(source_doc, 'unknown') || ' p.0 | score:' || printf('%.2f', score) || '] text ' || vec_id AS line FROM km WHERE rank <= 5
UNION ALL SELECT 2, '[' || coalesce(source_doc, 'unknown') || ' p.0 | score:' || printf('%.2f', score) || '] text ' || vec_id FROM ch WHERE rank <= 5
UNION ALL SELECT 3, '[' || type || '] ' || name || ' (from ' || coalesce(source_doc, 'unknown') || ', confidence:' || printf('%.1f', coalesce(confidence, 0)) || ') -> ' || rels FROM x
UNION ALL SELECT 4, 'CONFLICT: ' || chr(39) || g.src || chr(39) || ' is described differently in ' || coalesce(a.source_doc, 'unknown') || ' vs ' || coalesce(b.source_doc, 'unknown')
    FROM g JOIN entities a ON a.name = g.src JOIN entities b ON b.name = g.dst WHERE g.rel_type = 'DISPUTES'""")
def l4(s, d):
    points = table(s, d, "vec_points").select("*", F.lit(0).alias("page"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))
    first = _asked(s, d).orderBy("query_id").limit(1)  # one question
    return retrieve.analyst(_QUESTION, first, points, table(s, d, "entities"), _rel_edges(s, d).where("rel_type IS NOT NULL"), 5, "DISPUTES").select("section", "line")


@query("l3_conversation")
def l3(s, d):
    """Two turns of a conversation about the table's entities; the second names nothing and takes the first one's."""
    nodes, points = table(s, d, "entities"), table(s, d, "vec_points").select("*", F.lit(0).alias("page"), F.lit("text").alias("text"))
    links = _rel_edges(s, d).withColumn("edge_id", F.concat_ws("|", "src", "dst", "rel_type"))
    top = links.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").head()
    none = s.createDataFrame([], "alias_key string, canonical string, confidence double")
    turns = s.createDataFrame([], "session_id bigint, turn int, question string, mentions array<string>, linked array<string>, answer string")
    _, turns = retrieve.converse(f'What about "{top.src if top else "x"}"?', turns, 1, links, points, nodes, none)
    _, turns = retrieve.converse("and its limits?", turns, 1, links, points, nodes, none)
    return turns


@query("l10_classify_domains", """WITH x AS (SELECT source_doc, max(coalesce(title, '')) AS title, max(coalesce(domain, '')) AS text, max(tier) AS tier FROM source_docs GROUP BY 1),
k AS (SELECT source_doc, title, text, tier, substr(sha256(lower(trim(title)) || '::' || substr(lower(text), 1, 1200)), 1, 16) AS hash FROM x),
m AS (SELECT k.source_doc, t.canonical, row_number() OVER (PARTITION BY k.source_doc ORDER BY t.canonical) AS r FROM k JOIN domain_taxonomy t ON contains(lower(k.title || ' ' || k.text), lower(t.canonical)))
SELECT k.source_doc, CASE WHEN k.hash IN (SELECT hash FROM k WHERE tier = 1) THEN 'Law' ELSE coalesce(m.canonical, 'General') END AS domain,
    CASE WHEN k.hash IN (SELECT hash FROM k WHERE tier = 1) THEN 0.95E0 WHEN m.canonical IS NULL THEN 0.7E0 ELSE 0.85E0 END AS confidence,
    CASE WHEN k.hash IN (SELECT hash FROM k WHERE tier = 1) THEN 'cache' WHEN m.canonical IS NULL THEN 'model' ELSE 'fuzzy' END AS status FROM k LEFT JOIN m ON m.source_doc = k.source_doc AND m.r = 1""")
def l10(s, d):
    docs = table(s, d, "source_docs").groupBy(F.col("source_doc").alias("doc_id")).agg(F.max(F.coalesce("title", F.lit(""))).alias("title"), F.max(F.coalesce("domain", F.lit(""))).alias("text"), F.max("tier").alias("tier"))
    names = sorted(r.canonical for r in table(s, d, "domain_taxonomy").select("canonical").collect())
    cache = docs.where("tier = 1").select(exprs.doc_hash(F.trim("title"), "text").alias("doc_hash"), F.lit("Law").alias("domain"))
    said = lambda df: df.withColumn("said", providers.classify_domain(F.col("title"), F.col("text"), names)).withColumn("said_confidence", F.lit(0.7))
    out = ontology.classify_domains(docs.drop("tier"), _tree(s, d), cache, said, providers.infer_parent)
    return out.labels.select(F.col("doc_id").alias("source_doc"), "domain", "confidence", "status")


@query("l9_relations_with_model", f"""WITH t AS ({_TYPES_SQL}), y AS ({_SYN_SQL}), r AS (SELECT DISTINCT rel_id, relation, {_OKEY} AS k FROM relationships),
m AS (SELECT k, arg_max(canonical, (length(canonical), canonical)) AS said FROM (SELECT DISTINCT k FROM r) x JOIN t ON contains(x.k, t.canonical) GROUP BY 1)
SELECT r.rel_id, CASE WHEN coalesce(r.k, '') = '' THEN NULL WHEN t.canonical IS NOT NULL THEN t.canonical WHEN y.canonical IS NOT NULL THEN y.canonical ELSE coalesce(m.said, 'RELATED_TO') END AS canonical,
    CASE WHEN coalesce(r.k, '') = '' THEN 'invalid' WHEN t.canonical IS NOT NULL THEN 'exact' WHEN y.canonical IS NOT NULL THEN 'synonym' WHEN m.said IS NOT NULL THEN 'model' ELSE 'fallback' END AS method
FROM r LEFT JOIN t ON r.k = t.canonical LEFT JOIN y ON r.k = y.raw LEFT JOIN m ON m.k = r.k""")
def l9(s, d):
    types = [t for ts in ontology.CATEGORIES.values() for t in ts]
    rows = table(s, d, "relationships").select("rel_id", "relation").distinct()
    return ontology.resolve_with_model(rows, lambda unknown: providers.classify_relations(unknown, types)).select("rel_id", "canonical", "method")


@query("k5_proposals", lambda: _fallback() + r"""SELECT k AS key, upper(regexp_replace(k, '[^a-zA-Z0-9]+', '_', 'g')) AS suggested_canonical, 'SEMANTIC' AS suggested_category FROM z WHERE status = 'pending_review'""")
def k5(s, d):
    return providers.propose_types(_friction(s, d)).select("key", "suggested_canonical", "suggested_category")


@query("l11_merge_duplicates")
def l11(s, d):
    e = table(s, d, "entities")
    out = ingest.merge_duplicates(e, _rel_edges(s, d), _ent_aliases(s, d), memory.hydrate(e), dry_run=False)
    return out.nodes.select("name", "type", r6("confidence").alias("confidence"), "merged")


@query("h40_format_hits", "SELECT vec_id, '[C' || CAST(vec_id % 9 + 1 AS VARCHAR) || '] (' || source_doc || ', p.0): ' || coalesce(domain, '-') AS line FROM vec_points WHERE source_doc IS NOT NULL")
def h40(s, d):
    rows = table(s, d, "vec_points").where("source_doc IS NOT NULL")
    return rows.select("vec_id", exprs.format_hit((F.col("vec_id") % 9 + 1).cast("int"), "source_doc", F.lit(0), F.coalesce("domain", F.lit("-"))).alias("line"))


SQL.update({name: sql() for name, sql in SQL.items() if callable(sql)})
