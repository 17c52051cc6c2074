import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import neighbours
from lodestrata.llm.neighbours import VantageTree, close_pairs, nearest


def data(seed=0, n=600, d=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(.1, 50, (n, 1))
    x[n // 2:] = x[: n - n // 2] * 3 + rng.normal(size=(n - n // 2, d)) * .5
    return x


def brute(x, k, least=-2.0):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:k] if s[i, j] >= least}, s


def test_tree_is_exact_at_factor_one_and_close_beyond(monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 20)
    x = data(n=2000)
    want, _ = brute(x, 5)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for relax, recall in ((1.0, .9999), (2.0, .9)):
        q, p, _ = VantageTree(u).search(u, 5, -1.001, relax, np.arange(len(u)))
        assert len(set(zip(q.tolist(), p.tolist())) & want) / len(want) >= recall


@pytest.mark.parametrize("shard_rows,least", [(10_000, None), (70, None), (70, .95)])
def test_frame_against_brute_force(spark, shard_rows, least):
    x = data(3)
    rows = [(int(i), x[i].tolist(), "ab"[i % 3 == 0]) for i in range(len(x))]
    rows += [(9001, None, "a"), (9002, [], "a"), (9003, [1.0] * 3, "a"), (9004, [0.0] * 8, "a"), (9005, [1.0] * 8, None),
             (9006, [float("nan")] * 8, "a"), (9007, [1.0] * 7 + [None], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, type string").selectExpr("*", "1 AS id", "2 AS shard")
    got = {(r.id, r.other) for r in nearest(df, 4, dimension=8, shard_rows=shard_rows, least=least).collect()}
    want = set()
    for t in (0, 1):
        own = np.array([i for i in range(len(x)) if (i % 3 == 0) == t])
        pairs, _ = brute(x[own], 4, -2 if least is None else least)
        want |= {(int(own[a]), int(own[b])) for a, b in pairs}
    assert len(got ^ want) <= len(want) * .002


def test_queries_ties_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], "a") for i in range(6)], "vec_id long, embedding array<float>, type string")
    found = nearest(df, 2, dimension=2, queries=F.col("vec_id") % 5 == 0)
    rows = found.collect()
    assert {r.id for r in rows} == {0, 5} and len(rows) == 4
    assert close_pairs(nearest(df, 10, dimension=2)).count() == 15
    assert nearest(df.limit(0), 2, dimension=2).count() == 0


def like_embeddings(n=4000, d=64):
    """Points of independent numbers, half of them near another one: as hard for pruning as the table of vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d)) * rng.uniform(.5, 2, (1, d))
    x[n // 2:] = x[: n // 2] + rng.normal(size=(n // 2, d)) * rng.uniform(.05, .7, (n // 2, 1))
    return x


@pytest.mark.parametrize("shards", [10, 100])
def test_recall_and_copies_at_the_settings_of_the_queries(spark, shards):
    x = like_embeddings()
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<float>, type string")
    asked = F.col("vec_id") % 5 == 0
    for least, relax in ((.9, 6.0), (None, 8.0)):
        want = {p for p in brute(x, 10, -2 if least is None else least)[0] if p[0] % 5 == 0}
        got = {(r.id, r.other) for r in nearest(df, 10, least=least, relax=relax, shard_rows=len(x) // shards, queries=asked).collect()}
        recall = len(got & want) / len(want)
        rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit("a").alias("g"))
        pivots = neighbours.pivots_of(rows, {"a": len(x)}, len(x) // shards)
        assert len(pivots["a"]) == shards
        reach = float(neighbours.chord(np.float64(.9 if least else .45)))
        copies = neighbours._routed(rows, spark.sparkContext.broadcast(pivots), 64, relax, reach).agg(F.avg(F.size("routes"))).head()[0]
        print(f"{shards} shards, least {least}, relax {relax}: recall {recall:.4f}, {copies:.1f} cells a query")
        assert recall >= (.99 if least else .9) and copies < .8 * shards


def test_a_cell_of_copies_is_dealt_and_ties_go_to_smaller_ids(spark):
    x = like_embeddings(600)
    x[:200] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<float>, type string")
    got = {}
    for r in nearest(df, 3, shard_rows=40).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    for i in range(200):
        assert [o for _, o in sorted(got[i])] == [j for j in range(4) if j != i][:3]
