"""Exact vector search for a stated query set: one pass over the points, top-k per batch, then one rank per query.

At most ``MOST_QUERIES`` queries are shipped to the points; a larger set is dealt to blocks and meets the shards of the points in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are shipped to every task; more meet the points in cells.
MOST_QUERIES = 20_000
#: Rows of each side of a cell.
CELL = 20_000


def payload_filter(source_doc: str | None = None, type: str | None = None, domain: str | None = None) -> Column:  # noqa: A002
    """AND of the given equalities; none given lets everything through."""
    out = F.lit(True)
    for column, value in (("source_doc", source_doc), ("type", type), ("domain", domain)):
        if value is not None:
            out = out & (F.col(column) == value)
    return out


def same_domain(a: Column, b: Column, mode: str = "permissive") -> Column:
    """Permissive: differs only if both are set and differ. Strict: equal whenever the asking side is set."""
    if mode == "permissive":
        return a.isNull() | b.isNull() | (a == b)
    return a.isNull() | F.coalesce(a == b, F.lit(False))


def topk(points: DataFrame, queries: DataFrame, k: int, group: str | None = None, least: float | None = None, strict: bool = False,
         id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """``query_id, vec_id, score, rank`` of the ``k`` points most like each query by cosine.

    ``queries`` has ``query_id`` and ``embedding``, and the ``group`` column where only points of the same group count. Zero vectors score
    0; points whose length differs from a query's are not compared. ``least`` is a floor, ``strict`` leaves out the floor itself. Ties by id.
    """
    fields = ["query_id", vector] + ([group] if group else [])
    queries = queries.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*fields)
    found = points.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector).alias("v"), *([F.col(group).alias("g")] if group else []))
    asked = queries.limit(MOST_QUERIES + 1).collect()

    def best(packed: dict, ids: np.ndarray, lists: pa.Array, groups) -> Iterator[pa.RecordBatch]:
        """The best of some points for each query, ``packed`` by length of the vectors."""
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        for n, (names, unit, wanted) in packed.items():
            at = np.flatnonzero(sizes == n)
            if not len(at):
                continue
            flat = lists.take(pa.array(at)).flatten().cast(pa.float64())
            own = _unit(np.nan_to_num(flat.to_numpy(zero_copy_only=False)).reshape(-1, n))
            for start in range(0, len(names), 512):
                scores = unit[start:start + 512] @ own.T
                if group:
                    scores = np.where(wanted[start:start + 512, None] == groups[at][None, :], scores, -np.inf)
                if exclude_self:
                    scores = np.where(np.array(names[start:start + 512])[:, None] == ids[at][None, :], -np.inf, scores)
                if least is not None:
                    scores = np.where(scores > least if strict else scores >= least, scores, -np.inf)
                order = np.lexsort((np.broadcast_to(ids[at], scores.shape), -np.round(scores, 12)), axis=1)[:, :k]
                row = np.repeat(np.arange(len(scores)), order.shape[1])
                column = order.ravel()
                good = np.isfinite(scores[row, column])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[start + i] for i in row[good]], pa.int64()), pa.array(ids[at][column[good]], pa.int64()),
                     pa.array(scores[row[good], column[good]])], names=["query_id", "vec_id", "score"])

    schema = "query_id bigint, vec_id bigint, score double"
    if len(asked) <= MOST_QUERIES:
        packed = _packed([r.query_id for r in asked], [r[vector] for r in asked], [r[group] if group else None for r in asked])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups = np.array(batch.column(2).to_pylist(), object) if group else None
                yield from best(packed, batch.column(0).to_numpy(), batch.column(1), groups)

        part = found.mapInArrow(run, schema)
    else:
        part = _in_cells(found, queries, vector, group, best, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(names: list, vectors: list, wanted: list) -> dict:
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_length.setdefault(len(v), []).append(i)
    return {n: ([names[i] for i in at], _unit(np.array([vectors[i] for i in at], float).reshape(len(at), n)), np.array([wanted[i] for i in at], object))
            for n, at in by_length.items() if n}


def _in_cells(found: DataFrame, queries: DataFrame, vector: str, group: str | None, best, schema: str) -> DataFrame:
    """Many queries: both sides are dealt, and each block of queries meets each shard of points in a task of its own; nothing comes to the driver."""
    blocks, shards = -(-queries.count() // CELL), -(-found.count() // CELL)
    g = F.col(group) if group else F.lit(None).cast("string")
    row = F.monotonically_increasing_id()  # deals repeated ids apart; any dealing gives the same result
    asked = queries.withColumn("block", F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1))))).select(
        "block", "shard", F.lit(True).alias("asks"), F.col("query_id").cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), g.alias("g"))
    own = found.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, shards))).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "block", "shard", F.lit(False).alias("asks"), F.col("vec_id").alias("id"), F.col("v").cast("array<double>").alias("v"), (F.col("g") if group else g).alias("g"))

    def task(data: pa.Table) -> pa.Table:
        asks = data["asks"].to_numpy(zero_copy_only=False)
        q, p = data.filter(pa.array(asks)), data.filter(pa.array(~asks))
        packed = _packed(q["id"].to_pylist(), q["v"].to_pylist(), q["g"].to_pylist())
        out = list(best(packed, p["id"].to_numpy(), p["v"].combine_chunks(), np.array(p["g"].to_pylist(), object)))
        return pa.Table.from_batches(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return asked.unionByName(own).groupBy("block", "shard").applyInArrow(task, schema)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def latest_by_key(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The last row of each key: an upsert where the last writer wins."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def delete_by_source(points: DataFrame, sources: DataFrame) -> DataFrame:
    """Points of other documents than those given; points without a document stay."""
    return points.join(sources.select("source_doc").distinct(), "source_doc", "left_anti")


def source_exists(points: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_doc, present`` for each document asked for."""
    known = points.select("source_doc").distinct().withColumn("present", F.lit(True))
    return sources.select("source_doc").distinct().join(known, "source_doc", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def reinsert(points: DataFrame, batch: DataFrame) -> DataFrame:
    """Points after a document's are taken out and put in again: running it twice changes nothing."""
    return delete_by_source(points, batch).unionByName(batch)


def collection_stats(points: DataFrame) -> DataFrame:
    """Points by type."""
    return points.groupBy("type").agg(F.count("*").alias("points"))


def peek(points: DataFrame, n: int = 3, id_col: str = "vec_id") -> DataFrame:
    """The first payloads, without their vectors."""
    return points.drop("embedding").orderBy(id_col).limit(n)
