"""The relation ontology, domains as a tree, and what is learned about both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import ontology_key
from ..functions.exprs import doc_hash
from ..functions.udfs import domain_name, fuzzy_ratio
from ..session import staged

# Relation types by category.
CATEGORIES = {
    "STRUCTURAL": ["IS_A", "SUBSET_OF", "PART_OF", "BELONGS_TO", "CONTAINS"],
    "AUTHORSHIP": ["CREATED_BY", "DEVELOPED_BY", "AUTHORED_BY", "EMPLOYED_BY", "WORKED_AT", "CONTRIBUTED_TO", "COLLABORATED_WITH", "MENTORED"],
    "FUNCTIONAL": ["USES", "USED_FOR", "USED_IN", "USED_BY", "USED_WITH", "APPLIES_TO", "APPLICABLE_TO", "ENABLES", "MEASURES", "EVALUATES",
                   "REQUIRES", "CREATES", "GENERATES", "ADDRESSES"],
    "REFERENTIAL": ["REFERENCES", "PRECEDES", "FOLLOWS", "AFFECTS", "INFLUENCES", "TARGETS", "COMPATIBLE_WITH"],
    "SEMANTIC": ["SUPPORTS", "CONTRADICTS", "RELATED_TO", "SIMILAR_TO", "SAME_AS", "DIFFERENT_FROM"],
}
# Spellings of relations and the type each stands for.
SYNONYMS = {
    "SUBFIELD_OF": "SUBSET_OF",
    "IS_RELATED_TO": "RELATED_TO",
    "ARE_RELATED_TO": "RELATED_TO",
    "PROVIDES_ACCESS_TO": "ENABLES",
    "USED_TO_CONVERT": "USED_FOR",
    "USED_TO_EVALUATE": "USED_FOR",
    "SHOWS_CHANGE": "REFERENCES",
    "SHOWS": "REFERENCES",
    "SUMMARIZES": "REFERENCES",
    "ADDRESS": "ADDRESSES",
    "DOES_NOT_SUPPORT": "CONTRADICTS",
    "DEVELOPED": "DEVELOPED_BY",
    "SELECTED": "USED_FOR",
    "PROVIDES_INFORMATION": "REFERENCES",
    "FORCES": "REQUIRES",
    "RELATES_TO": "RELATED_TO",
    "WRAPPED": "USES",
    "BEHAVES_AS": "SIMILAR_TO",
    "IMPLEMENTED_IN": "USED_IN",
    "DIFFERS_FROM": "DIFFERENT_FROM",
    "INTEGRATES": "USES",
    "INTEGRATES_WITH": "USES",
    "EXPORTS_TO": "USED_FOR",
    "RUNS": "USES",
    "ENHANCES": "AFFECTS",
    "COMMISSIONED": "CREATED_BY",
    "IS_ABOUT": "RELATED_TO",
    "IS_SIMILAR_TO": "SIMILAR_TO",
    "AUTHORED": "AUTHORED_BY",
    "SOLVED_BY": "USED_FOR",
    "ENHANCED_BY": "AFFECTS",
    "OBJECTIVE": "TARGETS",
    "HAS_PHASE": "PART_OF",
    "COMPARISON": "SIMILAR_TO",
    "TOPIC": "RELATED_TO",
    "OPERATES_IN": "USED_IN",
    "IS_PART_OF": "PART_OF",
    "IS_USED_BY": "USED_BY",
    "IS_CHARACTERISTIC_OF": "BELONGS_TO",
    "MEASURED_BY": "MEASURES",
    "HAS": "CONTAINS",
    "MARKS": "RELATED_TO",
    "HANDLED": "USES",
    "DEALS_WITH": "RELATED_TO",
    "COMBINED_WITH": "RELATED_TO",
    "REPRESENTS": "RELATED_TO",
    "INPUT_FOR": "USED_IN",
    "OUTPUT_OF": "GENERATES",
    "INVOLVES": "CONTAINS",
    "WORKED_WITH": "COLLABORATED_WITH",
    "PURSUING": "TARGETS",
    "ASSOCIATED_WITH": "RELATED_TO",
    "OCCURRED_IN": "RELATED_TO",
    "DEDICATED_TO": "RELATED_TO",
    "PRAYED_TO": "RELATED_TO",
}


def relation_types(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """``canonical, category`` of all types, approved extensions included."""
    own = spark.createDataFrame([(t, c) for c, ts in CATEGORIES.items() for t in ts], "canonical string, category string")
    return own if extra is None else own.unionByName(extra.select("canonical", "category")).distinct()


def synonyms(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    own = spark.createDataFrame(list(SYNONYMS.items()), "raw string, canonical string")
    return own if extra is None else own.unionByName(extra.select("raw", "canonical"))


def resolve_with_model(rows: DataFrame, classify, raw: str = "relation", learned: DataFrame | None = None, fallback: str = "RELATED_TO") -> DataFrame:
    """:func:`resolve_relations` with a model for what neither list nor memory knows.

    ``classify`` takes the distinct unknown spellings (``key``) and adds ``canonical`` and ``confidence``; an answer outside the types does not count.
    """
    first = staged(resolve_relations(rows, raw, learned, fallback).withColumn("__key", ontology_key(raw)), "relations")
    valid = relation_types(rows.sparkSession).select("canonical").distinct()
    said = classify(first.where("method = 'fallback'").select(F.col("__key").alias("key")).distinct()).where("canonical IS NOT NULL").join(valid, "canonical", "left_semi").select(
        F.col("key").alias("__key"), F.col("canonical").alias("__said"), F.col("confidence").alias("__c"))
    hit = (F.col("method") == "fallback") & F.col("__said").isNotNull()
    return (first.join(said, "__key", "left").withColumn("canonical", F.when(hit, F.col("__said")).otherwise(F.col("canonical")))
            .withColumn("confidence", F.when(hit, F.col("__c")).otherwise(F.col("confidence")))
            .withColumn("method", F.when(hit, "model").otherwise(F.col("method"))).drop("__key", "__said", "__c"))


def resolve_relations(rows: DataFrame, raw: str = "relation", learned: DataFrame | None = None, fallback: str = "RELATED_TO") -> DataFrame:
    """Adds ``canonical, confidence, method``: exact type, else synonym, else learned spelling, else the fallback at 0.3.

    The lists are small by nature and joined as such (the optimizer broadcasts them); a blank relation is invalid at 0.
    """
    spark = rows.sparkSession
    known = relation_types(spark).select(F.col("canonical").alias("__exact"))
    same = synonyms(spark).groupBy("raw").agg(F.min("canonical").alias("__synonym")).withColumnRenamed("raw", "__raw")
    out = rows.withColumn("__key", ontology_key(raw))
    out = out.join(known, out["__key"] == known["__exact"], "left").join(same, out["__key"] == same["__raw"], "left")
    if learned is not None:
        own = learned.groupBy(F.lower("raw").alias("__lraw")).agg(F.max_by("canonical", "confidence").alias("__learned"), F.max("confidence").alias("__lc"))
        out = out.join(own, F.lower("__key") == F.col("__lraw"), "left")
    else:
        out = out.withColumn("__learned", F.lit(None).cast("string")).withColumn("__lc", F.lit(None).cast("double")).withColumn("__lraw", F.lit(None))
    blank = F.coalesce(F.col("__key") == "", F.lit(True))
    pick = lambda i, e, s, l, f: F.when(blank, i).when(F.col("__exact").isNotNull(), e).when(F.col("__synonym").isNotNull(), s).when(  # noqa: E731,E741
        F.col("__learned").isNotNull(), l).otherwise(f)
    return (out.withColumn("canonical", pick(F.lit(None), F.col("__exact"), F.col("__synonym"), F.col("__learned"), F.lit(fallback)))
            .withColumn("confidence", pick(F.lit(0.0), F.lit(1.0), F.lit(0.95), F.col("__lc"), F.lit(0.3)))
            .withColumn("method", pick(F.lit("invalid"), F.lit("exact"), F.lit("synonym"), F.lit("learned"), F.lit("fallback")))
            .drop("__key", "__exact", "__raw", "__synonym", "__learned", "__lc", "__lraw"))


def types_of(types: DataFrame, categories: list[str]) -> DataFrame:
    """The distinct types of some categories, in order."""
    return types.where(F.col("category").isin(categories)).select("canonical").distinct().orderBy("canonical")


def without_types(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges of no listed type."""
    return edges.join(types.select(F.col("canonical").alias("rel_type")), "rel_type", "left_anti")


def lineage(tree: DataFrame, most: int = 20) -> DataFrame:
    """``name, path, depth``: each domain with its ancestors; a cycle ends where it would repeat, an unknown parent is the last step.

    A tree deeper than ``most`` levels raises an error. The state of a level is written, so the plan does not grow.
    """
    edges = tree.where("name IS NOT NULL").groupBy("name").agg(F.min("parent").alias("parent"))
    done = edges.select("name", F.array("name").alias("path"), F.col("parent").alias("up"))
    for n in range(most):
        up = edges.select(F.col("name").alias("up"), F.col("parent").alias("next"))
        step = done.join(up, "up", "left")
        fresh = F.col("up").isNotNull() & ~F.array_contains("path", F.col("up"))
        done = step.select("name", F.when(fresh, F.concat("path", F.array("up"))).otherwise(F.col("path")).alias("path"),
                           F.when(fresh, F.col("next")).alias("up"))
        done = staged(done, "lineage")
        if done.where("up IS NOT NULL").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"lineages are not done after {most} steps")
    return done.select("name", "path", F.size("path").alias("depth"))


def siblings(tree: DataFrame) -> DataFrame:
    """Domains with the same parent, themselves left out; no parent is no common parent."""
    a, b = tree.alias("a"), tree.alias("b")
    return a.join(b, (F.lower("a.parent") == F.lower("b.parent")) & (F.col("a.name") != F.col("b.name"))).select(
        F.col("a.name").alias("name"), F.col("b.name").alias("sibling")).distinct()


def niche(domains: DataFrame, below: int = 3) -> DataFrame:
    return domains.where(F.col("times_seen") < below)


def taxonomy_report(domains: DataFrame) -> DataFrame:
    """One row: totals of domains, top-level, niche and sightings."""
    return domains.agg(F.count("*").alias("domains"), F.count(F.when(F.col("parent").isNull(), 1)).alias("top_level"),
                       F.count(F.when(F.col("times_seen") < 3, 1)).alias("niche"), F.coalesce(F.sum("times_seen"), F.lit(0)).alias("sightings"))


def popular(domains: DataFrame, n: int = 10) -> DataFrame:
    return domains.orderBy(F.desc("times_seen"), "name").limit(n)


def explain_domains(domains: DataFrame) -> DataFrame:
    """``name, times_seen, niche, path, siblings`` of each domain."""
    near = siblings(domains).groupBy("name").agg(F.array_sort(F.collect_set("sibling")).alias("siblings"))
    return domains.select("name", "times_seen", (F.col("times_seen") < 3).alias("niche")).join(
        lineage(domains).select("name", "path"), "name").join(near, "name", "left").withColumn("siblings", F.coalesce("siblings", F.array().cast("array<string>")))


def similar_domain(raw: DataFrame, domains: DataFrame, least: float = 0.85) -> DataFrame:
    """``raw, domain`` of the first domain (by ``seq``) whose name is like the title-cased value; more than 10,000 domains are refused."""
    if domains.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 domains")
    asked = raw.select("raw").distinct().withColumn("title", domain_name("raw"))
    pairs = asked.join(F.broadcast(domains), F.abs(F.length("title") - F.length("name")) <= 0.3 * F.greatest(F.length("title"), F.length("name")))
    hits = pairs.withColumn("ratio", fuzzy_ratio("title", "name")).where(F.col("ratio") >= least)
    w = Window.partitionBy("raw").orderBy("seq")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").select("raw", F.col("name").alias("domain"), "ratio")


def learn_relation(learned: DataFrame, batch: DataFrame) -> DataFrame:
    """Learned spellings with a batch's; the first learned stays."""
    return learned.unionByName(batch.join(learned.select("raw"), "raw", "left_anti"))


def taxonomy_lists(domains: DataFrame, n: int = 10) -> DataFrame:
    """``list, name, times_seen``: top-level domains, niche ones and the ``n`` most popular."""
    columns = lambda name: [F.lit(name).alias("list"), "name", "times_seen"]
    return domains.where("parent IS NULL").select(*columns("top_level")).unionByName(niche(domains).select(*columns("niche"))).unionByName(
        popular(domains, n).select(*columns("popular")))


@dataclass
class Classified:
    """The domains of a batch of documents, and the tree and the memory of documents after it."""

    labels: DataFrame
    tree: DataFrame
    cache: DataFrame


def classify_domains(docs: DataFrame, tree: DataFrame, cache: DataFrame, classify, parent_of=None) -> Classified:
    """Domains of ``doc_id, title, text``: a document seen before keeps its domain (0.95, ``cache``); else the model's answer is taken for a known domain
    like it (0.85 at least, ``fuzzy``) or becomes a new one (``model``); without an answer it is General at 0.3 (``fallback``).

    ``tree`` has ``name, parent, times_seen``, ``cache`` has ``doc_hash, domain``. ``classify`` adds ``said`` and ``said_confidence`` to the documents that are not
    known; ``parent_of(name, known names)`` places a new domain. Documents of one batch do not see each other; new domains of a batch are few and come to the driver
    (``MOST_NEW``, checked).
    """
    hashed = staged(docs.withColumn("doc_hash", doc_hash(F.trim("title"), "text")), "documents")
    known = cache.groupBy("doc_hash").agg(F.min("domain").alias("cached")).join(tree.select(F.col("name").alias("cached")).distinct(), "cached", "left_semi")
    seen = hashed.join(known, "doc_hash", "left")
    asked = staged(classify(seen.where("cached IS NULL").drop("cached")), "asked")
    like = similar_domain(asked.where("said IS NOT NULL").select(F.col("said").alias("raw")), tree.select("name", F.col("name").alias("seq")))
    told = asked.join(like.select(F.col("raw").alias("said"), F.col("domain").alias("__like")), "said", "left").withColumn("__name", domain_name("said"))
    status = F.when(F.col("said").isNull(), "fallback").when(F.col("__like").isNotNull(), "fuzzy").otherwise("model")
    labels = told.select("doc_id", "doc_hash", F.coalesce("__like", "__name", F.lit("General")).alias("domain"), F.when(F.col("said").isNull(), 0.3).when(
        F.col("__like").isNotNull(), F.greatest("said_confidence", F.lit(0.85))).otherwise(F.col("said_confidence")).alias("confidence"), status.alias("status"))
    labels = staged(labels.unionByName(seen.where("cached IS NOT NULL").select(
        "doc_id", "doc_hash", F.col("cached").alias("domain"), F.lit(0.95).alias("confidence"), F.lit("cache").alias("status"))), "labels")
    counted = labels.where("status <> 'fallback'").groupBy(F.col("domain").alias("name")).agg(F.count("*").alias("n"))
    new = counted.join(tree.select("name"), "name", "left_anti").orderBy("name").limit(MOST_NEW + 1).collect()
    if len(new) > MOST_NEW:
        raise ValueError(f"more than {MOST_NEW} new domains in one batch")
    names = [r.name for r in tree.select("name").orderBy("name").limit(30).collect()]
    placed = tree.sparkSession.createDataFrame([(r.name, parent_of(r.name, names) if parent_of and len(names) > 1 else None, r.n) for r in new],
                                               "name string, parent string, times_seen bigint")
    after = tree.join(counted, "name", "left").select("name", "parent", (F.col("times_seen") + F.coalesce("n", F.lit(0))).alias("times_seen")).unionByName(placed)
    fresh = labels.where("status IN ('fuzzy', 'model')").groupBy("doc_hash").agg(F.min("domain").alias("domain"))
    return Classified(labels, after, cache.select("doc_hash", "domain").join(fresh.select("doc_hash"), "doc_hash", "left_anti").unionByName(fresh))


#: New domains of one batch.
MOST_NEW = 10_000
