"""Sources, sinks and the streaming inbox."""

import json

from pyspark.sql import functions as F

from lodestrata.model import REGISTRY
from lodestrata.operators import vector
from lodestrata.sources import store
from lodestrata.streaming.inbox import run_inbox


def test_state(spark, tmp_path):
    path = str(tmp_path / "state.json")
    schema = spark.createDataFrame([], "name string, n int").schema
    assert store.load_state(spark, path, schema).count() == 0
    (tmp_path / "state.json").write_text('{"name": "a", "n": 1}\n{broken\n')
    assert [tuple(r) for r in store.load_state(spark, path, schema).collect()] == [("a", 1)]
    table = str(tmp_path / "table")
    assert store.read_state(spark, table, schema).count() == 0
    store.save_state(spark.createDataFrame([("a", 1)], schema), table)
    store.save_state(spark.createDataFrame([("a", 2)], schema), table)
    assert [tuple(r) for r in store.read_state(spark, table, schema).collect()] == [("a", 2)]
    assert store.migrate_domains(spark.createDataFrame([("x",)], "name string")).columns == ["name", "times_seen", "parent"]


def test_log(spark, tmp_path):
    for i in range(12):
        store.append_log(spark.createDataFrame([(i,)], "seq int"), str(tmp_path / "log"))
    assert [r.seq for r in store.recent(spark.read.schema("seq int").json(str(tmp_path / "log")), 3).collect()] == [11, 10, 9]


def test_parsing(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"Title\nwords here\f" + b"x " * 60)
    (tmp_path / "b.txt").write_bytes(b"no")
    docs = store.parse_documents(store.backlog(spark, str(tmp_path)), ocr=lambda name, page: "read again " * 10).collect()
    assert len(docs) == 1 and docs[0].title == "Title" and docs[0].page_count == 2 and docs[0].ocr_pages == [1] and docs[0].quality_score == 1.0

    def broken(name, content):
        raise ValueError("unreadable")

    assert store.parse_documents(store.backlog(spark, str(tmp_path)), broken).head().page_count == 0


def test_inbox(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(b"one page")
    (inbox / "copy.pdf").write_bytes(b"one page")
    (inbox / "broken.pdf").write_bytes(b"broken")
    (inbox / "skip.txt").write_bytes(b"not this")

    def parser(name, content):
        if content == b"broken":
            raise ValueError("unreadable")
        return store.plain_parser(name, content)

    def stage(files):
        return store.parse_documents(files, parser)

    where = [str(tmp_path / x) for x in ("state", "out", "checkpoint")]
    run_inbox(spark, str(inbox), *where, stage=stage).awaitTermination()
    seen = {r.filename: r.status for r in store.read_state(spark, where[0], REGISTRY).collect()}
    assert seen == {"a.pdf": "processed", "copy.pdf": "duplicate", "broken.pdf": "failed"}
    (inbox / "later.pdf").write_bytes(b"one page")
    (inbox / "new.pdf").write_bytes(b"another page")
    run_inbox(spark, str(inbox), *where, stage=stage).awaitTermination()
    registry = store.read_state(spark, where[0], REGISTRY)
    seen = {r.filename: r.status for r in registry.collect()}
    assert seen["later.pdf"] == "duplicate" and seen["new.pdf"] == "processed" and len(seen) == 5
    assert tuple(store.registry_stats(registry).head())[:2] == (2, 1)
    assert {r.filename for r in spark.read.parquet(where[1]).where("page_count > 0").collect()} == {"a.pdf", "new.pdf"}


def test_points(spark):
    pts = spark.createDataFrame([(1, "d"), (2, None), (3, "e")], "vec_id int, source_doc string")
    gone = spark.createDataFrame([("d",)], "source_doc string")
    assert {r.vec_id for r in vector.delete_by_source(pts, gone).collect()} == {2, 3}
    once = vector.reinsert(pts, pts.where("vec_id = 1"))
    assert vector.reinsert(once, pts.where("vec_id = 1")).count() == 3
    last = vector.latest_by_key(spark.createDataFrame([("k", 1), ("k", 2)], "k string, t int"), [F.col("k")], [F.desc("t")])
    assert [r.t for r in last.collect()] == [2] and json.dumps([]) == "[]"


def test_pipeline_routes_files_and_tries_again(spark, tmp_path):
    from lodestrata.providers import Retry
    from lodestrata.streaming import pipeline

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name, body in (("a.pdf", b"one page"), ("copy.pdf", b"one page"), ("broken.pdf", b"broken")):
        (inbox / name).write_bytes(body)
    tried, taken = [], []

    def parser(name, content):
        if content == b"broken":
            raise ValueError("unreadable")
        return store.plain_parser(name, content)

    def extract(documents):
        tried.append(1)
        if len(tried) < 3:
            raise RuntimeError("connection reset")
        return documents

    def reconcile(known):
        raise RuntimeError("no judge")

    folders = {x: str(tmp_path / x) for x in ("state", "checkpoint", "processed", "quarantine")}

    def start(ingest):
        pipeline.run(spark, str(inbox), **folders, extract=extract, ingest=ingest, reconcile=reconcile, stage=lambda files: store.parse_documents(files, parser),
                     again=Retry(attempts=3, base=0.0)).awaitTermination()
        return {r.filename: r.status for r in store.read_state(spark, folders["state"], REGISTRY).collect()}

    seen = start(lambda known: taken.extend(r.filename for r in known.collect()))
    assert seen == {"a.pdf": "processed", "copy.pdf": "duplicate", "broken.pdf": "failed"} and taken == ["a.pdf"] and len(tried) == 3
    files = lambda x: sorted(p.name for p in (tmp_path / x).iterdir() if not p.name.startswith("."))
    assert files("processed") == ["a.pdf", "copy.pdf"] and files("quarantine") == ["broken.pdf"] and files("inbox") == []
    (inbox / "late.pdf").write_bytes(b"new page")
    seen = start(lambda known: 1 / 0)
    assert seen["late.pdf"] == "failed" and files("inbox") == ["late.pdf"]


def test_tables_are_created_checked_and_old_versions_go(spark, tmp_path):
    from lodestrata.sources import tables

    folder = str(tmp_path)
    assert set(tables.create(spark, folder)) == set(tables.TABLES) and tables.create(spark, folder) == []
    rows = spark.createDataFrame([("a", "m", "processed", None, None), ("a", "m", "failed", None, None), (None, "m", "failed", None, None)], REGISTRY)
    for _ in range(5):
        store.save_state(rows, f"{folder}/registry")
    assert len([p for p in (tmp_path / "registry").iterdir() if p.name.startswith("v-")]) == 3
    assert [tuple(r) for r in tables.violations(rows, ("filename",)).collect()] == [("a", 2)]
    (tmp_path / "points" / "_current").rename(tmp_path / "points" / "gone")
    seen = {r.name: (r.ok, r.rows) for r in tables.health(spark, folder).collect()}
    assert seen["registry"] == (True, 3) and seen["points"] == (False, 0) and seen["edges"] == (True, 0)


def test_a_digest_writer_that_fails_is_followed_by_the_next(spark):
    from lodestrata.operators import curate

    lines = spark.createDataFrame([("top", "0002", "b"), ("top", "0001", "a"), ("types", "x", "c")], "part string, rank string, line string")
    assert curate.written_digest(lines, [lambda text: 1 / 0, str.upper]) == "TOP: A\nTOP: B\nTYPES: C"
    assert curate.written_digest(lines, []) == "top: a\ntop: b\ntypes: c"
