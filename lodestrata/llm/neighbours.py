"""Problem 5: the k most similar vectors of every vector, by vantage-point trees per shard.

Vectors are scaled to length one, so that cosine order is the order of the chord distance, which is a metric.

Shards in space. A group (type, or type and domain) of more than ``shard_rows`` points is dealt to cells: its pivots are as many of its own points,
drawn by hash, as it needs shards, and a point belongs to its nearest pivot. A cell that holds more than ``shard_rows`` points all the same (a
third of all points may be copies) is dealt by hash once more, so a task has at most about ``shard_rows`` points and as many queries.

Routing. A query of radius r can only have a neighbour in a cell whose pivot is no farther than ``d(home pivot) + 2 r``: for a
neighbour x the triangle inequality gives d(q, p) - r <= d(x, p) <= d(x, home) <= d(q, home) + r. The slack 2 r is divided by ``relax``.
With a least cosine the radius is known; without one a first pass searches the home cell, and its k-th best is the radius of
the second pass over the other cells.

Search. Each task builds the shard's vantage-point tree and searches it with its block of queries at once: at each node the distances of all
queries to the vantage point come from one product, and at a leaf those still alive are compared by one matrix product. A branch
is left out where the triangle inequality says that nothing closer than the k-th best so far can lie in it, again with the bound divided by
``relax``. With ``relax=1`` routing and search are exact. The best of all shards are united in a final rank per query.

What is broadcast: the pivots, ``MOST_PIVOTS`` in all groups together (16 MB at 64 numbers). A collection that would need more gets larger cells, which are dealt by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Points of a leaf; a product with a leaf is one call.
LEAF = 512
#: Pivots of all groups together; they are broadcast.
MOST_PIVOTS = 65_536
#: Cosines that differ by less are ties; single precision resolves no more.
TIE = 1e-6


class VantageTree:
    """A vantage-point tree over rows of unit length."""

    def __init__(self, points: np.ndarray, seed: int = 1):
        self.order = np.arange(len(points))
        self.points = points
        self.nodes: list[tuple] = []
        self.rng = np.random.default_rng(seed)
        self._build(0, len(points))
        self.points = np.ascontiguousarray(points[self.order])

    def _build(self, start: int, end: int) -> int:
        """Nodes are ``(vantage, inner low, inner high, outer low, outer high, inner, outer)`` or ``(start, end)``."""
        me = len(self.nodes)
        self.nodes.append((start, end))
        if end - start <= LEAF:
            return me
        own = self.order[start:end]
        vantage = self.points[own[self.rng.integers(len(own))]]
        distance = chord(self.points[own] @ vantage)
        middle = len(own) // 2
        split = np.argpartition(distance, middle)
        self.order[start:end] = own[split]
        inner, outer = distance[split[:middle]], distance[split[middle:]]
        bounds = (float(inner.min()), float(inner.max()), float(outer.min()), float(outer.max()))
        left = self._build(start, start + middle)
        right = self._build(start + middle, end)
        self.nodes[me] = (vantage, *bounds, left, right)
        return me

    def search(self, queries: np.ndarray, k: int, least: np.ndarray | float, relax: float, own: np.ndarray | None = None):
        """``(query, point, cosine)`` of the best ``k`` of each query with at least its cosine ``least``; of ties the points first in order.

        ``own`` gives the row that is the query itself, or -1.
        """
        best = np.full((len(queries), k), np.float32(-2))
        best[:] = np.asarray(least, np.float32).reshape(-1, 1)
        who = np.full((len(queries), k), -1, np.int64)

        def leaf(start: int, end: int, alive: np.ndarray) -> None:
            cosines = queries[alive] @ self.points[start:end].T
            if own is not None:
                here = np.flatnonzero((place[alive] >= start) & (place[alive] < end))
                cosines[here, place[alive[here]] - start] = -2
            hit = np.flatnonzero(cosines.max(axis=1) >= best[alive, -1] - TIE)
            if not len(hit):
                return
            rows, cosines = alive[hit], cosines[hit]
            floor = best[rows, -1] - np.float32(TIE)
            if end - start > k:
                floor = np.maximum(floor, np.partition(cosines, end - start - k, axis=1)[:, end - start - k] - np.float32(TIE))
            # Everything that can be among the k best, with what is held already; then the first k of each query, ties by the order of points.
            row, column = np.nonzero(cosines >= floor[:, None])
            old_row, old_column = np.nonzero(who[rows] >= 0)
            query = np.concatenate([row, old_row])
            value = np.concatenate([cosines[row, column], best[rows[old_row], old_column]])
            point = np.concatenate([self.order[start:end][column], who[rows[old_row], old_column]])
            order = np.lexsort((point, -np.round(value / TIE), query))
            query, value, point = query[order], value[order], point[order]
            first = np.searchsorted(query, np.arange(len(rows)))
            rank = np.arange(len(query)) - first[query]
            kept = rank < k
            full = np.repeat(np.asarray(floors[rows])[:, None], k, axis=1)
            names = np.full((len(rows), k), -1, np.int64)
            full[query[kept], rank[kept]], names[query[kept], rank[kept]] = value[kept], point[kept]
            best[rows], who[rows] = full, names

        def visit(node: int, alive: np.ndarray) -> None:
            parts = self.nodes[node]
            if len(parts) == 2:
                for a in range(0, len(alive), 4096):
                    leaf(*parts, alive[a: a + 4096])
                return
            vantage, low, high, outer_low, outer_high, left, right = parts
            distance = chord(queries[alive] @ vantage)
            for a, b, child in ((low, high, left), (outer_low, outer_high, right)):
                away = np.maximum(a - distance, distance - b)
                near = alive[away * relax <= chord(best[alive, -1]) + 1e-6]
                if len(near):
                    visit(child, near)

        floors = best[:, 0].copy()
        if own is not None:
            back = np.empty(len(self.order), np.int64)
            back[self.order] = np.arange(len(self.order))
            place = np.where(own >= 0, back[np.maximum(own, 0)], -1) if len(back) else np.full(len(queries), -1)
        if len(queries) and len(self.order):
            visit(0, np.arange(len(queries)))
        query, column = np.nonzero(who >= 0)
        return query, who[query, column], best[query, column]


def chord(cosine: np.ndarray) -> np.ndarray:
    """The distance of unit vectors with this cosine."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def usable(embedding: str, dimension: int) -> Column:
    """Vectors of the right length without null, NaN or infinite numbers that are not all zero."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) == dimension) & fine & F.exists(v, lambda x: x != 0)


def pivots_of(rows: DataFrame, groups: dict[str, int], shard_rows: int) -> dict[str, np.ndarray]:
    """The pivots of each group (of its size) that needs more than one shard: its points of least hash, normalised."""
    needed = {g: -(-n // shard_rows) for g, n in groups.items() if n > shard_rows}
    scale = min(1.0, MOST_PIVOTS / max(1, sum(needed.values())))
    wanted = {g: max(1, int(c * scale)) for g, c in needed.items()}
    if not wanted:
        return {}
    # Three times as many as are wanted are let through by their hash, so that none falls short; then the first of them are taken.
    shares = rows.sparkSession.createDataFrame([(g, min(1.0, (3 * c + 20) / groups[g])) for g, c in wanted.items()], "g string, share double")
    chance = F.xxhash64("id", F.lit(3)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    found: dict[str, list] = {}
    drawn = rows.join(F.broadcast(shares), "g").withColumn("h", chance).where("h < share").select("g", "h", "id", "v")  # MOST_PIVOTS rows at most
    for r in drawn.toLocalIterator():  # about 3 * MOST_PIVOTS rows at most
        found.setdefault(r.g, []).append((r.h, r.id, r.v))
    out = {}
    for g, held in found.items():
        v = np.array([x[2] for x in sorted(held, key=lambda x: x[:2])[: wanted[g]]], np.float64)
        out[g] = _units(v).astype(np.float32)
    return out


def _units(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(scale > 0, scale, 1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


def _routed(rows: DataFrame, pivots, dimension: int, relax: float, radius: str | float | None) -> DataFrame:
    """Adds ``home`` and ``routes``: the cells a query has to be searched in. ``radius`` is a column, a number, or None for the home cell only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pivots.value
        for batch in batches:
            groups = batch.column("g").dictionary_encode()
            codes, names = groups.indices.to_numpy(zero_copy_only=False), groups.dictionary.to_pylist()
            home = np.zeros(batch.num_rows, np.int32)
            routes: list = [np.zeros(1, np.int32)] * batch.num_rows
            reach = None if radius is None else np.full(batch.num_rows, radius) if not isinstance(radius, str) else batch.column(radius).to_numpy(zero_copy_only=False)
            unit = _units(_matrix(batch.column("v"), dimension)).astype(np.float32) if batch.num_rows else None
            for code, name in enumerate(names):
                if name not in held:
                    continue
                at = np.flatnonzero(codes == code)
                for start in range(0, len(at), 2048):
                    part = at[start: start + 2048]
                    distance = chord(unit[part] @ held[name].T)
                    own = distance.argmin(axis=1)
                    home[part] = own
                    if reach is None:
                        for i, c in zip(part, own):
                            routes[i] = np.array([c], np.int32)
                    else:
                        near = distance <= (distance[np.arange(len(part)), own] + 2 * reach[part] / relax + 1e-6)[:, None]
                        for i, mask in zip(part, near):
                            routes[i] = np.flatnonzero(mask).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in routes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(routes) if routes else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names_kept), pa.array(home), lists], names=[*names_kept, "home", "routes"])

    names_kept = [c for c in rows.columns if c not in ("home", "routes")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names_kept)
    return rows.select(*names_kept).mapInArrow(run, schema + ", home int, routes array<int>")


def _searched(points: DataFrame, queries: DataFrame, k: int, dimension: int, relax: float, least: float | None, shard_rows: int) -> DataFrame:
    """``id, other, cosine`` of the best of every query in every cell of its ``routes``, by one task per cell (or shard of it) and block of queries.

    ``points`` has ``g, home, id, v``; ``queries`` has ``g, routes, id, v, floor`` (a cosine).
    """
    asked = queries.select("g", "id", "v", "floor", F.explode("routes").alias("cell"))
    sizes = points.groupBy("g", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("subs"))
    loads = asked.groupBy("g", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("blocks"))
    cells = staged(sizes.join(loads, ["g", "cell"]), "cells")  # one row per pivot, or per small group
    side = lambda df: df.join(cells, ["g", "cell"])
    as_query = side(asked).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")).withColumn(
        "sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select("g", "cell", "sub", "block", "id", "v", "floor", F.lit(True).alias("query"))
    as_point = side(points.select("g", F.col("home").alias("cell"), "id", "v")).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "g", "cell", "sub", "block", "id", "v", F.lit(0.0).cast("float").alias("floor"), F.lit(False).alias("query"))

    def task(data: pa.Table) -> pa.Table:
        ids, is_query = data["id"].to_numpy(), data["query"].to_numpy(zero_copy_only=False)
        vectors = _units(_matrix(data["v"], dimension))
        # Points in the order of their ids, so that ties go to the smaller one; rows of one id are one point.
        p, q = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        p = p[np.argsort(ids[p], kind="stable")]
        small = vectors.astype(np.float32)
        at = np.searchsorted(ids[p], ids[q]).clip(max=max(0, len(p) - 1))
        own = np.where(ids[p][at] == ids[q], at, -1) if len(p) else np.full(len(q), -1)
        query, point, _ = VantageTree(small[p]).search(small[q], k, data["floor"].to_numpy()[q] - np.float32(1e-5), relax, own)
        a, b = q[query], p[point]
        cosine = np.einsum("ij,ij->i", vectors[a], vectors[b]) if len(a) else np.zeros(0)
        keep = ids[a] != ids[b]
        if least is not None:
            keep &= cosine >= least
        return pa.table({"id": ids[a][keep], "other": ids[b][keep], "cosine": np.clip(cosine[keep], -1, 1)})

    return as_query.unionByName(as_point).groupBy("g", "cell", "sub", "block").applyInArrow(task, "id bigint, other bigint, cosine double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 12)), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(points: DataFrame, k: int = 10, id_col: str = "vec_id", embedding: str = "embedding",
            group_cols: tuple[str, ...] = ("type",), dimension: int = 64, least: float | None = None, relax: float = 1.0,
            shard_rows: int = 10_000, queries: Column | None = None) -> DataFrame:
    """``id, other, cosine, rank``: the ``k`` most similar points of the same group, without the point itself.

    Rows with an unusable vector or a null group value take no part; ids must be unique (rows of one id count as one
    point that is not its own neighbour). Ties rank by id. ``least`` leaves out pairs below that cosine, ``queries`` is a
    condition on the rows to search for. An empty table gives no rows; extra columns are not read.
    """
    spark = points.sparkSession
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    for c in group_cols:
        points = points.where(F.col(c).isNotNull())
    rows = points.where(usable(embedding, dimension)).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("v"), asks.alias("asks"),
        F.concat_ws("\u0001", *[F.col(c).cast("string") for c in group_cols]).alias("g"))
    # Only groups that need pivots come to the driver: fewer than points / shard_rows, and MOST_PIVOTS of the largest at most.
    large = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).orderBy(F.desc("n"), "g").limit(MOST_PIVOTS)
    pivots = spark.sparkContext.broadcast(pivots_of(rows, {r.g: r.n for r in large.collect()}, shard_rows))
    radius = None if least is None else float(chord(np.float64(least)))
    placed = staged(_routed(rows, pivots, dimension, relax, radius), "placed")
    own = placed.where("asks").withColumn("floor", F.lit(-1.001 if least is None else least).cast("float"))
    found = _searched(placed, own, k, dimension, relax, least, shard_rows)
    if least is None and pivots.value:
        # What is found at home bounds the search elsewhere; a query with fewer than k at home has no bound yet.
        home = staged(_best(found, k), "home")
        reach = home.groupBy("id").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("kth"))
        bounded = own.join(reach, "id", "left").withColumn("floor", F.coalesce("kth", F.lit(-1.001)).cast("float")).withColumn(
            "radius", F.sqrt(F.greatest(2 - 2 * F.coalesce("kth", F.lit(-1.0)), F.lit(0.0))))
        away = _routed(bounded.select("g", "id", "v", "floor", "radius"), pivots, dimension, relax, "radius")
        away = away.withColumn("routes", F.array_remove("routes", F.col("home")))
        found = home.select("id", "other", "cosine").unionByName(_searched(placed, staged(away, "away"), k, dimension, relax, least, shard_rows))
    return _best(found, k)


def close_pairs(found: DataFrame) -> DataFrame:
    """``vec_id_a, vec_id_b``: pairs of which one is among the nearest of the other, smaller id first."""
    return found.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()
