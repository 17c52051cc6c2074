"""Problem 6: how often items appear together, and how far that exceeds chance.

Heavy-light decomposition over baskets (chunks, sessions, records). Items rarer than the least pair count can be in no
result and are dropped first, which is exact. The ``heavy`` most frequent items get a row each in a dense bit matrix over
the baskets of a block: heavy-heavy pairs are popcounts of ANDed rows. Mixed pairs probe, for each basket on a light
item's list, the heavy bits of that basket. Light-light pairs are counted by hash. Every block of baskets sends only
its counted pairs on, so the shuffle carries pre-aggregated counts; the three kinds are united and scored.

Where a least cosine is asked for (``n_ab >= c * sqrt(n_a * n_b)``), a pair whose frequencies differ by more than
``1 / c**2`` cannot reach it, whatever it shares; such pairs are not counted. That bound drops no result.

Baskets longer than ``long_basket`` never reach a Python block. They count through each item's lists of long baskets, one a block of them:
pairs known from other baskets add up the sizes of the lists' intersections, and pairs that meet in long baskets only are
found by a prefix filter (two lists that share c entries share one among the first ``len - c + 1`` of each, in one common
order). That is exact too, and no pair is emitted for the basket as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def entity_key(type_col: str = "type", name_col: str = "name") -> Column:
    """``type::name`` in lower case without outer blanks; null where either is null or blank."""
    name = F.regexp_replace(F.lower(F.col(name_col)), r"(?U)^\s+|\s+$", "")
    return F.when((name != "") & (F.trim(F.col(type_col)) != ""), F.concat(F.col(type_col), F.lit("::"), name))


def _light_pairs(basket: np.ndarray, item: np.ndarray, n: np.ndarray, ratio: float):
    """Pairs of neighbours at every distance within a basket; entries sorted by basket."""
    found = []
    for d in range(1, len(basket)):
        same = basket[d:] == basket[:-d]
        if not same.any():
            break
        a, b, na, nb = item[:-d][same], item[d:][same], n[:-d][same], n[d:][same]
        ok = np.maximum(na, nb) <= ratio * np.minimum(na, nb)
        found.append(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]]))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def count_block(basket: np.ndarray, item: np.ndarray, n: np.ndarray, heavy: np.ndarray, heavy_items: np.ndarray,
                ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, count)`` with a < b of one block; ``heavy`` is an entry's row in the bit matrix, or -1."""
    order = np.lexsort((item, basket))
    basket, item, n, heavy = basket[order], item[order], n[order], heavy[order]
    basket = np.cumsum(np.concatenate([[0], basket[1:] != basket[:-1]])) if len(basket) else basket
    size = int(basket[-1]) + 1 if len(basket) else 0
    rows = len(heavy_items)
    bits = np.zeros((rows, -(-max(size, 1) // 64) * 64), bool)
    at = heavy >= 0
    bits[heavy[at], basket[at]] = True
    words = np.packbits(bits, axis=1).view(np.uint64)
    out_a, out_b, out_n = [], [], []
    for i in range(rows - 1):
        both = np.bitwise_count(words[i + 1:] & words[i]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(both)
        out_a.append(np.full(len(hit), heavy_items[i]))
        out_b.append(heavy_items[i + 1 + hit])
        out_n.append(both[hit])
    light = ~at
    lb, li, ln = basket[light], item[light], n[light]
    pairs = [_light_pairs(lb, li, ln, ratio)]
    columns = np.ascontiguousarray(bits.T) if rows else bits.T
    for k in range(0, len(lb), 20_000):
        entry, row = np.nonzero(columns[lb[k:k + 20_000]])
        pairs.append(np.stack([li[k:k + 20_000][entry], heavy_items[row]]))
    both = np.concatenate(pairs, axis=1)
    if both.shape[1]:
        names, codes = np.unique(both, return_inverse=True)
        codes = codes.reshape(both.shape)
        unique, counts = np.unique(codes[0] * len(names) + codes[1], return_counts=True)
        out_a.append(names[unique // len(names)])
        out_b.append(names[unique % len(names)])
        out_n.append(counts)
    if not out_a:
        return (np.zeros(0, np.int64),) * 3
    a, b, c = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_n)
    return np.minimum(a, b), np.maximum(a, b), c


def pair_counts(rows: DataFrame, basket_col: str, key: Column, min_pair: int = 5, min_cosine: float = 0.0,
                heavy: int = 256, long_basket: int = 1000, block: int = 60_000) -> DataFrame:
    """``key_a, key_b, n_ab, n_a, n_b, baskets, lift``: every pair in at least ``min_pair`` baskets, ``key_a < key_b``.

    Null baskets and null keys do not count, repeated rows count once, an empty table gives no rows; extra columns are
    ignored. ``lift`` is ``n_ab * baskets / (n_a * n_b)`` over all baskets with a key. ``min_cosine`` keeps pairs with
    ``n_ab >= min_cosine * sqrt(n_a * n_b)``. ``heavy`` and ``block`` bound memory only, never results.
    """
    spark = rows.sparkSession
    entries = staged(rows.select(F.col(basket_col).alias("basket"), key.alias("key"))
                     .where("basket IS NOT NULL AND key IS NOT NULL").distinct(), "entries")
    total = entries.agg(F.count_distinct("basket")).head()[0]
    items = staged(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pair)
                   .withColumn("item", F.monotonically_increasing_id()), "items")
    top = items.orderBy(F.desc("n"), "item").limit(heavy).select("item", "n").collect()  # at most `heavy` rows
    heavy_items = np.array([r.item for r in top], np.int64)
    ratio = 1 / min_cosine**2 if min_cosine > 0 else float("inf")
    kept = entries.join(items, "key").select("basket", "item", "n")
    lengths = kept.groupBy("basket").agg(F.count("*").alias("length"))
    long = lengths.where(F.col("length") > long_basket)
    n_long = long.count()
    short = kept.join(long, "basket", "left_anti") if n_long else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(heavy_items)
        ranked = heavy_items[order]

        def counted(parts: list[pa.Table]) -> pa.RecordBatch:
            whole = pa.concat_tables(parts)
            basket = whole["basket"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            item, n = whole["item"].to_numpy(), whole["n"].to_numpy()
            if len(ranked):
                at = np.searchsorted(ranked, item).clip(max=len(ranked) - 1)
                row = np.where(ranked[at] == item, order[at], -1)
            else:
                row = np.full(len(item), -1)
            a, b, c = count_block(basket.astype(np.int64), item, n, row, heavy_items, ratio)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())],
                                              names=["a", "b", "c"])

        parts, held = [], 0
        for batch in batches:  # rows come sorted by basket; a block ends where a basket ends
            part = pa.Table.from_batches([batch])
            if held + part.num_rows >= block and part.num_rows:
                name = part["basket"].combine_chunks()
                last = name[len(name) - 1]
                cut = pa.compute.index(name, last).as_py()
                if cut or parts:
                    parts.append(part.slice(0, cut))
                    if not cut and parts[-2].num_rows:  # the last basket may have begun in the batch before
                        before = parts[-2]["basket"].combine_chunks()
                        if before[len(before) - 1] == last:
                            parts[-1] = part
                            held += part.num_rows
                            continue
                    yield counted(parts)
                    parts, held, part = [], 0, part.slice(cut)
            parts.append(part)
            held += part.num_rows
        if held:
            yield counted(parts)

    blocks = short.repartition("basket").sortWithinPartitions("basket").mapInArrow(run, "a bigint, b bigint, c bigint")
    pairs = blocks.groupBy("a", "b").agg(F.sum("c").alias("n_ab"))
    if n_long:
        pairs = _with_long(pairs, kept.join(long, "basket"), min_pair, min_cosine, n_long)
    name = items.select("item", "key", "n")
    left = name.select(F.col("item").alias("a"), F.col("key").alias("ka"), F.col("n").alias("na"))
    right = name.select(F.col("item").alias("b"), F.col("key").alias("kb"), F.col("n").alias("nb"))
    first = F.col("ka") < F.col("kb")
    scored = (pairs.where(F.col("n_ab") >= min_pair).join(left, "a").join(right, "b")
              .select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "n_ab",
                      F.when(first, F.col("na")).otherwise(F.col("nb")).alias("n_a"),
                      F.when(first, F.col("nb")).otherwise(F.col("na")).alias("n_b"))
              .withColumn("baskets", F.lit(total))
              .withColumn("lift", F.col("n_ab") * F.col("baskets") / (F.col("n_a").cast("double") * F.col("n_b"))))
    if min_cosine > 0:
        scored = scored.where(F.col("n_ab") * F.col("n_ab") >= min_cosine**2 * F.col("n_a") * F.col("n_b"))
    return scored


#: Long baskets of one block; bounds the lists that are intersected.
LONG_BLOCK = 1024


def _with_long(pairs: DataFrame, long: DataFrame, min_pair: int, min_cosine: float, n_long: int) -> DataFrame:
    """Adds what the long baskets contribute to the counted pairs, and the pairs that only meet there.

    Long baskets are numbered in blocks of LONG_BLOCK; an item has one short list a block, and pairs add up the intersections of their
    lists block by block. An item is in at most as many long baskets as there are rows over ``long_basket``.
    """
    names = staged(long.select("basket").distinct().withColumn("at", F.monotonically_increasing_id()), "numbered")
    # Numbers are consecutive within a partition, so a block holds LONG_BLOCK of them at most.
    long = staged(long.join(names, "basket").withColumn("block", F.floor(F.col("at") / LONG_BLOCK)), "long")
    lists = staged(long.groupBy("item", "block").agg(F.collect_list("at").alias("own")), "lists")
    pairs = pairs.select("a", "b", "n_ab")
    if n_long >= min_pair:
        least = F.greatest(F.lit(min_pair), F.ceil(F.lit(min_cosine**2) * F.col("n")))
        order, whole = Window.partitionBy("item").orderBy("length", "at"), Window.partitionBy("item")
        ranked = long.withColumn("rank", F.row_number().over(order)).withColumn("all", F.count("*").over(whole)).where(
            F.col("rank") <= F.col("all") - least + 1).select("item", "at")
        only = (ranked.select(F.col("item").alias("a"), "at").join(ranked.select(F.col("item").alias("b"), "at"), "at").where("a < b").select("a", "b").distinct())
        pairs = pairs.unionByName(only.withColumn("n_ab", F.lit(0).cast("bigint"))).groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))
    pairs = staged(pairs, "pairs")
    left = lists.select(F.col("item").alias("a"), "block", F.col("own").alias("la"))
    right = lists.select(F.col("item").alias("b"), "block", F.col("own").alias("lb"))
    shared = pairs.join(left, "a").join(right, ["b", "block"]).select("a", "b", F.size(F.array_intersect("la", "lb")).cast("bigint").alias("n_ab"))
    return pairs.unionByName(shared).groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))
