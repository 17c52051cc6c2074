"""Operators on small tables: the rules of the survey, nulls, ties, repeats and empty tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lodestrata import providers
from lodestrata.operators import curate, documents, graph, ingest, memory, ontology, reconcile, resolve, retrieve, sessions, vector
from lodestrata.operators.components import components

EDGES = "edge_id string, src string, dst string, rel_type string, confidence double"


def brute_trails(edges, anchor, hops, least):
    out = set()

    def walk(at, used, chain, score):
        if len(used) == hops:
            return
        for e, s, d, t, c in edges:
            if e in used or c is None or c < least:
                continue
            for x, y in {(s, d), (d, s)}:
                if x == at:
                    if y != anchor:
                        out.add((y, ">".join([*chain, t]), round(score * c, 9), len(used) + 1))
                    walk(y, used | {e}, [*chain, t], score * c)

    walk(anchor, frozenset(), [], 1.0)
    return out


def test_trails_against_brute_force(spark):
    rows = [("1", "a", "b", "X", .9), ("2", "b", "c", "Y", .8), ("3", "c", "a", "X", .7), ("4", "b", "b", "L", .6), ("5", "a", "b", "Z", .5), ("6", "c", "d", "X", None), ("7", "d", "a", "X", .3)]
    for hops in (1, 2, 3):
        found = graph.neighbors(spark.createDataFrame(rows, EDGES), spark.createDataFrame([("a",), ("a",)], "anchor string"), hops, .4)
        got = {(r.related, ">".join(r.chain), round(r.score, 9), r.hops) for r in found.collect()}
        assert got == brute_trails(rows, "a", hops, .4)
    best = {r.related: r for r in graph.best_paths(found).collect()}
    assert set(best) == {"b", "c"} and best["b"].score == pytest.approx(.9)
    assert retrieve.graph_facts(spark.createDataFrame([], EDGES), spark.createDataFrame([("a",)], "anchor string")).count() == 0
    assert graph.neighbors(spark.createDataFrame(rows, EDGES), spark.createDataFrame([("a",)], "anchor string"), 9).agg(F.max("hops")).head()[0] == 3


def test_pruned_trails_give_the_same_best(spark):
    import random

    rng = random.Random(3)
    rows = [(str(i), f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice("XYZ"), rng.choice([.3, .5, .8, .8, 1.0])) for i in range(60)]
    edges, anchors = spark.createDataFrame(rows, EDGES), spark.createDataFrame([("n0",), ("n5",)], "anchor string")
    shown = lambda df: sorted((r.anchor, r.related, ">".join(r.chain), round(r.score, 9), r.hops) for r in df.collect())
    for n in (1, 7, 40):
        whole = graph.neighbors(edges, anchors, 3, .4)
        assert shown(graph.top_paths(graph.neighbors(edges, anchors, 3, .4, trails=n), n)) == shown(graph.top_paths(whole, n))
        facts = graph.best_paths(graph.neighbors(edges, anchors, 3, .4, facts=n))
        assert shown(graph.top_facts(facts, n)) == shown(graph.top_facts(graph.best_paths(whole), n))


def test_upserts(spark):
    schema = "name string, type string, domain string, confidence double, source_doc string"
    old = spark.createDataFrame([("n", "T", None, .5, "d1"), ("m", "T", "L", .99, "d1")], schema)
    new = spark.createDataFrame([("n", "T", None, .9, "d2"), ("n", "T", None, .9, "d2"), ("m", "T", "L", .1, "d1"), ("x", "T", None, .7, "d3")], schema)
    got = {r.name: (round(r.confidence, 6), r.seen) for r in graph.upsert_entities(old, new).collect()}
    assert got == {"n": (.55, 2), "m": (.99, 1), "x": (.7, 1)}
    edge = "src string, dst string, rel_type string, confidence double, at int"
    out = graph.upsert_edges(spark.createDataFrame([("a", "b", "R", .5, 1)], edge), spark.createDataFrame([("a", "b", "R", .9, 5), ("c", "d", "R", .98, 6)], edge))
    assert {(r.src, round(r.confidence, 6), r.created_at, r.last_updated) for r in out.collect()} == {("a", .55, 1, 5), ("c", 1.0, 6, 6)}


def test_merge_and_stats(spark):
    ents = spark.createDataFrame([("ML", "T", .5), ("Machine Learning", "T", .9)], "name string, type string, confidence double")
    edges = spark.createDataFrame([("ML", "x", "R", .4), ("Machine Learning", "x", "R", .6)], "src string, dst string, rel_type string, confidence double")
    nodes, moved = graph.merge_nodes(ents, edges, spark.createDataFrame([("ML", "Machine Learning")], "name string, canonical string"))
    assert [tuple(r) for r in nodes.collect()] == [("Machine Learning", "T", .9, 2)] and [tuple(r) for r in moved.collect()] == [("Machine Learning", "x", "R", .6)]
    assert tuple(graph.graph_stats(ents.limit(0), edges.limit(0)).head()) == (0, 0.0, 0)


def test_alias_fold(spark):
    rows = [("k", "A", .92, 1), ("k", "A", .93, 2), ("k", "B", .93, 3), ("k", "B", .95, 4), ("k", "B", .94, 5), ("j", "A", .92, 1)]
    got = memory.alias_fold(spark.createDataFrame(rows, "alias_key string, canonical string, confidence double, seq int")).collect()
    assert [tuple(r) for r in got] == [("k", "B", .95, 2)]
    hits = memory.alias_hits(spark.createDataFrame([("k", "B", .995, 2)], "alias_key string, canonical string, confidence double, times_seen bigint"),
                             spark.createDataFrame([("k",), ("k",), (None,)], "alias_key string")).head()
    assert (hits.confidence, hits.times_seen) == (1.0, 4)


def test_folds(spark):
    rows = [("k", "n1", .5, None, 1), ("k", "n2", 1.0, "L", 2), ("k", "n1", None, "S", 3)]
    r = memory.entity_fold(spark.createDataFrame(rows, "key string, name string, confidence double, domain string, seq int")).head()
    assert (r.occurrences, r.confidence, r.aliases, r.domain) == (3, round(.7 * .65 + .3 * .7, 4), ["n1", "n2"], "L")
    seeds = spark.createDataFrame([("d", .97), ("e", .5)], "source_doc string, seed double")
    events = spark.createDataFrame([("d", True, 1), ("d", True, 2), ("d", False, 3)], "source_doc string, won boolean, seq int")
    got = {r.source_doc: tuple(r)[1:] for r in memory.reliability_fold(events, seeds).collect()}
    assert got == {"d": (.96, 2, 1), "e": (.5, 0, 0)}
    fr = spark.createDataFrame([("k", f"r{i % 6}", .3, "RELATED_TO", i) for i in range(7)], "key string, raw string, confidence double, landing string, seq int")
    f = memory.friction_fold(fr).head()
    assert (f["count"], f.status, len(f.raw_examples)) == (7, "pending_review", 5)


def test_evidence(spark):
    rows = [(1, "d", f"c{i}", i / 100, i) for i in range(55)] + [(1, "d", "c0", .99, 99)]
    e = spark.createDataFrame(rows, "target int, source_doc string, chunk_id string, confidence double, seq int")
    kept = memory.evidence_merge(e).collect()
    assert len(kept) == 50 and min(r.confidence for r in kept) == .05
    assert memory.reinforced(e).head().confidence == 1.0


def test_vectors(spark, monkeypatch):
    pts = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, [2.0, 0.0], "b"), (4, None, "a"), (5, [1.0], "a"), (6, [1.0, 0.0], None)],
                                "vec_id long, embedding array<double>, type string")
    q = spark.createDataFrame([(1, [3.0, 0.0], "a")], "query_id long, embedding array<double>, type string")
    assert [(r.vec_id, r.score) for r in vector.topk(pts, q, 3).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (6, 1.0)]
    assert [r.vec_id for r in vector.topk(pts, q, 3, "type").orderBy("rank").collect()] == [1, 2]
    assert [r.vec_id for r in vector.topk(pts, q, 3, "type", exclude_self=True).collect()] == [2]
    many = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "query_id long, embedding array<double>")
    whole = sorted(map(tuple, vector.topk(pts, many, 2).collect()))
    monkeypatch.setattr(vector, "MOST_QUERIES", 20)
    monkeypatch.setattr(vector, "CELL", 3)
    assert sorted(map(tuple, vector.topk(pts, many, 2).collect())) == whole and len(whole) == 100
    assert vector.topk(pts, q, 3, least=1.0, strict=True).count() == 0 and vector.topk(pts, q.limit(0), 3).count() == 0


def test_chunks(spark):
    text = " ".join(f"w{i}" for i in range(460))
    pages = spark.createDataFrame([("f", 1, 5, text, "body", 1), ("f", 2, 5, "too short", "body", 1), ("f", 3, 5, None, "body", 1), ("g", 1, 60, text, "references", 3)],
                                  "filename string, page int, page_count int, text string, section string, tier int")
    got = documents.chunk_windows(pages).collect()
    assert [(r.window, len(r.text.split())) for r in got] == [(0, 460)]
    assert [r.chunk_index for r in documents.priority_order(documents.chunk_windows(pages)).collect()] == [0]
    votes = spark.createDataFrame([("n", "A", 1), ("n", "B", 2), ("n", "B", 3), ("m", "A", 4), ("m", "B", 5)], "name_key string, type string, seq int")
    assert {tuple(r) for r in documents.type_vote(votes).collect()} == {("n", "B"), ("m", "A")}


def test_sessions(spark):
    rows = [("s", i, f"q{i}", ["m"] if i == 0 else [], [f"e{i}"]) for i in range(7)]
    turns = spark.createDataFrame(rows, "session_id string, turn int, question string, mentions array<string>, linked array<string>")
    ctx = {r.turn: r.context for r in sessions.history(turns).collect()}
    assert ctx[0] == "" and ctx[6] == "\n".join(f"Q: q{i}" for i in range(1, 6))
    used = {r.turn: r.used for r in sessions.carried(turns).collect()}
    assert used[0] == ["m"] and used[3] == ["e2"]
    calls = spark.createDataFrame([("p", t) for t in (0, 10, 59, 60, 61)], "provider string, at long")
    assert [r.in_window for r in sessions.rolling_calls(calls).orderBy("at").collect()] == [1, 2, 3, 3, 4]


def test_ontology(spark):
    rows = spark.createDataFrame([("is a",), ("Relates-To",), ("flies over",), ("  ",), (None,)], "relation string")
    got = [(r.canonical, r.method) for r in ontology.resolve_relations(rows).collect()]
    assert sorted(got, key=str) == sorted([("IS_A", "exact"), ("RELATED_TO", "synonym"), ("RELATED_TO", "fallback"), (None, "invalid"), (None, "invalid")], key=str)
    learned = spark.createDataFrame([("FLIES_OVER", "AFFECTS", .8)], "raw string, canonical string, confidence double")
    assert ontology.resolve_relations(rows, learned=learned).where("method = 'learned'").head().canonical == "AFFECTS"
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None), ("e", "z")], "name string, parent string")
    paths = {r.name: r.path for r in ontology.lineage(tree).collect()}
    assert paths == {"a": ["a", "b", "c"], "b": ["b", "c", "a"], "c": ["c", "a", "b"], "d": ["d"], "e": ["e", "z"]}
    assert ontology.siblings(tree).count() == 0
    assert len(ontology.SYNONYMS) == 55 and sum(len(v) for v in ontology.CATEGORIES.values()) == 40


def test_resolution(spark):
    cols = "entity_id long, name string, type string, domain string, confidence double"
    old = spark.createDataFrame([(1, "Machine Learning", "C", None, .9), (2, "Neural Network", "C", "L", .8), (3, "Supervised", "C", None, .7), (4, "GPT 3", "C", None, .7)], cols)
    new = spark.createDataFrame([(10, "ML", "C", None), (11, "Neurel Network", "C", "L"), (12, "Neural Network", "C", "S"), (13, "Unsupervised", "C", None), (14, "Quite New", "C", None),
                                 (15, "GPT 4", "C", None), (16, "aka", "C", None)], "new_id long, name string, type string, domain string")
    aliases = spark.createDataFrame([("aka", "Machine Learning", .97)], "alias_key string, canonical string, confidence double")
    got = {r.new_id: (r.canonical, r.method) for r in resolve.resolve(new, old, aliases, confirm=providers.referee).collect()}
    assert got[10] == ("Machine Learning", "acronym") and got[11] == ("Neural Network", "typo") and got[16] == ("Machine Learning", "alias")
    assert got[13][0] == "Unsupervised" and got[14] == ("Quite New", "new") and got[15][0] == "GPT 4" and len(got) == 7
    groups = resolve.duplicate_groups(spark.createDataFrame([(1, "Machine Learning (ML)", "C", None, .9), (2, "ML", "C", None, .5), (3, "Machine Learning", "C", None, .6), (4, "Other", "C", None, .6)], cols))
    assert {r.entity_id for r in groups.collect()} == {1, 2, 3} and resolve.pick_canonical(groups).head().canonical == "Machine Learning"
    words = "kitten sitting mitten bitten written kitte kittens".split()
    frame = spark.createDataFrame([(i, w, "T", None, .5) for i, w in enumerate(words)], cols)
    pairs = {(r.new_id, r.entity_id) for r in resolve.typo_pairs(frame.withColumnRenamed("entity_id", "new_id"), frame).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    assert pairs == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if a != b and lev(a, b) <= 2}


def test_reconcile(spark):
    cols = "entity_id long, name string, type string, description string, source_doc string"
    old = spark.createDataFrame([(1, "A", "T", "made in 2001", "d1"), (2, "B", "T", None, "d1"), (3, "C", "T", "x", "d2")], cols)
    new = spark.createDataFrame([(11, "A", "T", "made in 2002", "d2"), (12, "B", "T", "", "d2"), (13, "C", "T", "y", "d2")], cols)
    found = reconcile.candidates(new, old)
    assert [(r.new_id, r.old_id) for r in found.collect()] == [(11, 1)]
    judged = providers.judge(found).withColumn("seq", F.lit(1))
    assert tuple(reconcile.outcomes(judged).head()) == (1, 1, 0, 0)
    assert {(r.source_doc, r.won) for r in reconcile.reliability_events(judged).collect()} == {("d2", True), ("d1", False)}
    points = spark.createDataFrame([(1, "d1", "claim", [1.0, 0.0], "one"), (2, "d1", "claim", [0.0, 1.0], "two"), (3, "d2", "chunk", [1.0, 1.0], "three")],
                                   "vec_id long, source_doc string, type string, embedding array<double>, text string")
    asked = spark.createDataFrame([("A", "d1", [0.1, 1.0]), ("A", "d2", [1.0, 0.0])], "name string, source_doc string, vector array<double>")
    claims = reconcile.claims_for(asked, points)
    assert {(r.source_doc, r.claims) for r in claims.collect()} == {("d1", "- two\n- one"), ("d2", "- three")}
    done = reconcile.reconcile(new, old.withColumn("confidence", F.lit(.5)), claims, providers.judge)
    assert "Source 2 - d2" in done.verdicts.head().prompt and "- two\n- one" in done.verdicts.head().prompt
    assert {(r.entity_id, round(r.confidence, 6), r.superseded_by) for r in done.entities.collect()} == {(1, .3, "d2"), (2, .5, None), (3, .5, None)}
    assert done.edges.count() == 0 and done.summary.head().resolved == 1
    unsure = reconcile.reconcile(new, old.withColumn("confidence", F.lit(.5)), claims, lambda df: df.withColumn("verdict", F.lit(None).cast("string")))
    assert unsure.edges.count() == 1 and unsure.summary.head().unverified == 1
    nothing = reconcile.reconcile(new.limit(0), old.withColumn("confidence", F.lit(.5)), claims, providers.judge)
    assert nothing.verdicts.count() == 0 and nothing.entities.count() == 3


def test_curation(spark):
    now = F.lit(dt.datetime(2025, 1, 10))
    e = spark.createDataFrame([(1, "a", "T", .5, dt.datetime(2025, 1, 1), "d"), (2, "b", "T", .3, dt.datetime(2025, 1, 1), "d"), (3, "c", None, .9, dt.datetime(2025, 1, 10), "d"), (4, "d", "T", None, None, "d")],
                              "entity_id int, name string, type string, confidence double, last_updated timestamp, source_doc string")
    got = {r.entity_id: (r.decayed, r.changed) for r in curate.decay(e, now).collect()}
    assert got == {1: (pytest.approx(.475), True), 2: (.3, False), 3: (.9, False), 4: (None, False)}
    assert [r.entity_id for r in curate.top_entities(e, 2).collect()] == [3, 1]
    assert {r.type for r in graph.type_stats(e).collect()} == {"T", "UNKNOWN"}


def test_components_and_refusal(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11)], "a long, b long")
    assert {(r.node, r.component) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (10, 10), (11, 10)}
    empty = spark.createDataFrame([], "number int, line string")
    assert retrieve.grounded(empty, empty).head().answer == retrieve.REFUSAL


def test_retry():
    waits, calls = [], []

    def fail(times, text):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise RuntimeError(text)
            return "done"
        return call

    assert providers.Retry(sleep=waits.append)(fail(2, "429")) == "done" and waits == [2.0, 4.0]
    calls.clear()
    with pytest.raises(providers.QuotaExhausted):
        providers.Retry(sleep=waits.append)(fail(9, "Daily quota exhausted"))


def test_ingest_and_ask(spark):
    text = "Deep Learning builds on Neural Networks since 1958. " + "word " * 30 + "Neural Networks need Training Data."
    page = [(1, text, len(text), "body")]
    parsed = spark.createDataFrame([("a.pdf", 1, 1, 1.0, page), ("b.pdf", 0, 1, None, [])],
                                   "filename string, page_count int, tier int, quality_score double, pages array<struct<page:int,text:string,char_count:int,section:string>>")
    known = ingest.extract_knowledge(parsed)
    assert {r.name for r in known.entities.collect()} == {"Deep Learning", "Neural Networks", "Training Data"}
    assert {(r.from_name, r.to_name) for r in known.relationships.collect()} == {("Deep Learning", "Neural Networks"), ("Neural Networks", "Training Data")}
    assert known.claims.head().text.endswith("1958.") and known.entities.head().confidence == .95
    nodes = spark.createDataFrame([(1, "Deep Learning", "CONCEPT", None, .5, "old.pdf")], "entity_id long, name string, type string, domain string, confidence double, source_doc string")
    edges = spark.createDataFrame([], "src string, dst string, rel_type string, confidence double, at timestamp")
    aliases = spark.createDataFrame([], "alias_key string, canonical string, confidence double")
    after, links, report = ingest.ingest(known, nodes, edges, aliases)
    got = {r.name: round(r.confidence, 6) for r in after.collect()}
    assert got["Deep Learning"] == .55 and len(got) == 3 and links.count() == 2 and report.head().unwritten_rate == 0
    broken = ingest.extracted(known.chunks, lambda text: 1 / 0, providers.Retry(attempts=2, base=0.0))
    assert {(r.kind, r.text) for r in broken.collect()} == {("failed", "division by zero")} and known.failed.count() == 0
    graph_edges = spark.createDataFrame([("e", "Deep Learning", "Neural Networks", "USES", .9)], EDGES)
    points = spark.createDataFrame([(1, providers.hashed_vector("deep learning"), "a.pdf", 1, "text")], "vec_id long, embedding array<double>, source_doc string, page int, text string")
    found, lines = retrieve.ask("What is Deep Learning?", graph_edges, points, nodes, aliases)
    assert found == ["Deep Learning"] and any("Neural Networks" in r.line for r in lines.collect())
    assert retrieve.ask("and its limits?", graph_edges, points, nodes, aliases, ["Deep Learning"])[0] == ["Deep Learning"]


def test_conversation_carries_what_was_linked(spark):
    edges = spark.createDataFrame([("e", "Deep Learning", "Neural Networks", "USES", .9)], EDGES)
    nodes = spark.createDataFrame([(1, "Deep Learning", "CONCEPT", .5), (2, "Neural Networks", "CONCEPT", .5)], "entity_id long, name string, type string, confidence double")
    points = spark.createDataFrame([], "vec_id long, embedding array<double>, source_doc string, page int, text string")
    aliases = spark.createDataFrame([("dl", "Deep Learning", .9)], "alias_key string, canonical string, confidence double")
    turns = spark.createDataFrame([], "session_id bigint, turn int, question string, mentions array<string>, linked array<string>, answer string")
    answer, turns = retrieve.converse("What is DL?", turns, 7, edges, points, nodes, aliases)
    assert "Neural Networks" in answer
    answer, turns = retrieve.converse("and its limits?", turns, 7, edges, points, nodes, aliases)
    rows = sorted(turns.collect(), key=lambda r: r.turn)
    assert [(r.turn, r.mentions, r.linked) for r in rows] == [(1, ["DL"], ["Deep Learning"]), (2, ["Deep Learning"], ["Deep Learning"])]
    answer, turns = retrieve.converse("and now?", turns, 8, edges, points, nodes, aliases)
    assert answer == retrieve.REFUSAL and turns.count() == 3


def test_analyst_leaves_empty_sections_out(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "claim", "d", 3, "c" * 400), (2, [0.0, 1.0], "chunk", "d", 4, "p" * 400)],
                                   "vec_id long, embedding array<double>, type string, source_doc string, page int, text string")
    ents = spark.createDataFrame([(1, "Metrology Board", "ORG", None, "d", .5)], "entity_id long, name string, type string, domain string, source_doc string, confidence double")
    edges = spark.createDataFrame([], EDGES)
    vector_of = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    lines = retrieve.analyst("Who runs metrology today?", vector_of, points, ents, edges)
    rows = lines.collect()
    assert {r.section for r in rows} == {1, 2, 3} and max(len(r.line) for r in rows if r.section == 2) < 340
    assert "Metrology" in retrieve.analyst_answer("Who runs metrology?", lines)
    assert retrieve.analyst_answer("x", lines.limit(0)) == retrieve.REFUSAL


def test_domains_of_documents(spark):
    tree = spark.createDataFrame([("Law", None, 2), ("Privacy Law", "Law", 1)], "name string, parent string, times_seen bigint")
    docs = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t2"), (3, "c", "t3"), (4, "d", "t4"), (5, "a", "t1")], "doc_id int, title string, text string")
    from lodestrata.functions.exprs import doc_hash
    cache = docs.where("doc_id = 1").select(doc_hash("title", "text").alias("doc_hash"), F.lit("Law").alias("domain"))
    say = lambda df: df.withColumn("said", F.when(F.col("doc_id") == 2, "privacy laws").when(F.col("doc_id") == 3, "tax law")).withColumn("said_confidence", F.lit(.6))
    out = ontology.classify_domains(docs, tree, cache, say, providers.infer_parent)
    got = {r.doc_id: (r.domain, r.confidence, r.status) for r in out.labels.collect()}
    assert got == {1: ("Law", .95, "cache"), 5: ("Law", .95, "cache"), 2: ("Privacy Law", .85, "fuzzy"), 3: ("Tax Law", .6, "model"), 4: ("General", .3, "fallback")}
    assert {(r.name, r.times_seen) for r in out.tree.collect()} == {("Law", 4), ("Privacy Law", 2), ("Tax Law", 1)} and out.cache.count() == 3


def test_merging_duplicates(spark):
    e = spark.createDataFrame([(1, "ML", "T", None, .5), (2, "Machine Learning", "T", None, .9), (3, "Law", "T", None, .4)], "entity_id long, name string, type string, domain string, confidence double")
    edges = spark.createDataFrame([("ML", "Law", "R", .4)], "src string, dst string, rel_type string, confidence double")
    aliases = spark.createDataFrame([("law", "Law", .9)], "alias_key string, canonical string, confidence double")
    kept = memory.hydrate(e.withColumn("description", F.lit(None).cast("string")))
    dry = ingest.merge_duplicates(e, edges, aliases, kept)
    assert dry.nodes.count() == 3 and {r.canonical for r in dry.groups.collect()} == {"Machine Learning"}
    out = ingest.merge_duplicates(e, edges, aliases, kept, dry_run=False)
    assert {(r.name, r.confidence) for r in out.nodes.collect()} == {("Machine Learning", .9), ("Law", .4)}
    assert out.edges.head().src == "Machine Learning" and {(r.alias_key, r.canonical) for r in out.aliases.collect()} == {("law", "Law"), ("ml", "Machine Learning")}
    assert {(r.key, r.occurrences) for r in out.memory.collect()} == {("T::machine learning", 2), ("T::law", 1)}


def test_model_step_of_relations(spark):
    rows = spark.createDataFrame([(1, "strongly supports"), (2, "cites"), (3, "uses"), (4, None)], "rel_id int, relation string")
    types = [t for ts in ontology.CATEGORIES.values() for t in ts]
    got = {r.rel_id: (r.canonical, r.method) for r in ontology.resolve_with_model(rows, lambda u: providers.classify_relations(u, types)).collect()}
    assert got == {1: ("SUPPORTS", "model"), 2: ("RELATED_TO", "fallback"), 3: ("USES", "exact"), 4: (None, "invalid")}


def test_pairs_of_crowded_chunks_and_frequent_keys(spark):
    rows = [("big", f"k{i}", "d1") for i in range(30)] + [("big2", f"k{i}", "d2") for i in range(0, 30, 3)] + [(f"c{i}", "k0", "d1") for i in range(40)] + [("c1", "k3", "d1"), (None, "k1", "d")]
    df = spark.createDataFrame(rows, "chunk_id string, key string, source_doc string")
    want = {}
    for c in {r[0] for r in rows if r[0]}:
        keys = sorted({k for x, k, _ in rows if x == c})
        for i, a in enumerate(keys):
            for b in keys[i + 1:]:
                want[a, b] = want.get((a, b), 0) + 1
    for crowd in (5, 200):
        assert {(r.key_a, r.key_b): r["count"] for r in memory.pair_counts(df, crowd=crowd).collect()} == want
    assert {(r.key_a, r.key_b): r["count"] for r in memory.pair_counts(df, 2).collect()} == {p: n for p, n in want.items() if n > 1}


def test_contained_names_against_brute_force(spark):
    import random

    rng = random.Random(12)
    stock = ["institute", "of", "optics", "art", "kalo", "remi", "data", "xy"]
    names = sorted({" ".join(rng.choice(stock) for _ in range(rng.randint(1, 5))) for _ in range(120)})
    schema = "entity_id long, name string, type string, confidence double"
    e = spark.createDataFrame([(i, n, "T", rng.choice([.1, .5, None])) for i, n in enumerate(names)], schema)
    words = [{w for w in n.split() if len(w) > 2} for n in names]
    conf = {r.entity_id: r.confidence for r in e.collect()}
    want = {}
    for i, n in enumerate(names):
        held = [j for j, m in enumerate(names) if j != i and (n in m or m in n) and words[i] & words[j]]
        if held:
            want[i] = min(held, key=lambda j: (-(conf[j] if conf[j] is not None else -1), names[j], j))
    got = {r.new_id: r.entity_id for r in resolve.substring_match(e.withColumnRenamed("entity_id", "new_id"), e, exclude_self=True).collect()}
    assert got == want and len(want) > 40


def test_pairs_of_names_are_not_broadcast(spark):
    """Rows made by explode are many times what the planner takes them for, so a broadcast of them filled the driver (l5_resolution_cascade)."""
    cols = "entity_id long, name string, type string, domain string, confidence double"
    e = spark.createDataFrame([(i, f"Name {i} of Many", "T", None, .5) for i in range(40)], cols)
    new = e.withColumnRenamed("entity_id", "new_id")
    for pairs in (resolve.typo_pairs(new, e), resolve.acronym_pairs(new, e), resolve.substring_match(new, e)):
        pairs.collect()
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_contained_names_meet_by_ends_of_words(spark):
    """Names whose first word ends a longer word of the other or whose last begins one, short words, single words, honorifics, many equal names: as by comparing all."""
    names = ["art lab", "Smart Lab", "smart labour", "Smart  Lab", "Art Lab of X", "lab", "of", "Dr. Ada Lo", "Ada Lovelace", "V. Lovelace", "AV. Lovelaces", "X of Y", "ab of the cd", "Cab of the cdx",
             "abc of cd", "xabc of cde", "abc", "a b", "a b abc", "(lab)", "Höhle (Nord)", "Höhle", "Metrology Laboratory", "Big Metrology Laboratory", "metrology", "", None]
    names += ["Metrology Laboratory"] * 3 + ["ada lovelace"] * 3
    e = spark.createDataFrame([(i, n, t, c) for i, (n, t, c) in enumerate(
        (n, t, [.5, None, .7, .7][k % 4]) for k, n in enumerate(names) for t in ("T", "U"))], "entity_id long, name string, type string, confidence double")
    rows = [r for r in e.collect() if r.name is not None]

    def bare(n):
        return re.sub(r"^(dr\.|dr |prof\.|prof |mr\.|mr |ms\.|ms |mrs\.|mrs )", "", n.strip().lower()).strip()

    def shared(a, b):
        return {w for w in re.split(r"[\W_]+", a) if len(w) > 2} & {w for w in re.split(r"[\W_]+", b) if len(w) > 2}

    for alone in (False, True):
        want = {}
        for r in rows:
            hits = [s for s in rows if s.type == r.type and not (alone and s.entity_id == r.entity_id) and (bare(r.name) in s.name.lower() or s.name.lower() in bare(r.name)) and shared(bare(r.name), s.name.lower())]
            if hits:
                want[r.entity_id] = min(hits, key=lambda s: (s.confidence is None, -(s.confidence or 0), s.name, s.entity_id)).entity_id
        got = resolve.substring_match(e.withColumnRenamed("entity_id", "new_id"), e, exclude_self=alone)
        assert {r.new_id: r.entity_id for r in got.collect()} == want and got.count() == len(want) > 30


def test_typos_of_long_names_against_brute_force(spark):
    """Names with a common end or beginning and up to three edits of letters, also not Latin ones: all within two edits come out, and no others."""
    import random

    rng = random.Random(5)
    names = ["Kalotrem Optics Laboratory", "Kalo", "Odile Vetuprak", "Ödile Vetuprak", "aaaaaaaa", "东京大学研究所"]
    for n in list(names):
        for _ in range(14):
            x = list(n)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(x))
                x[at:at + rng.randint(0, 1)] = [] if rng.random() < .3 else [rng.choice("aekö京 ")]
            names.append("".join(x))
    e = spark.createDataFrame([(i, n, "T", None, .5) for i, n in enumerate(names)], "entity_id long, name string, type string, domain string, confidence double")
    both = e.select(F.col("entity_id").alias("i"), F.lower("name").alias("x")).crossJoin(e.select(F.col("entity_id").alias("j"), F.lower("name").alias("y")))
    want = {(r.i, r.j) for r in both.where("length(x) >= 4 AND length(y) >= 4 AND x <> y AND levenshtein(x, y) <= 2").collect()}
    out = {(r.i, r.j) for r in both.where(resolve.disqualified("x", "y").isNotNull()).collect()}
    got = [(r.new_id, r.entity_id) for r in resolve.typo_pairs(e.withColumnRenamed("entity_id", "new_id"), e).collect()]
    assert set(got) == want - out and len(got) == len(set(got)) > 300
