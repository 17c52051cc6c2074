import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.llm.cooccurrence import entity_key, pair_counts


def brute(rows, min_pair, cosine):
    baskets = {}
    for basket, key in rows:
        if basket is not None and key is not None:
            baskets.setdefault(basket, set()).add(key)
    n, nab = Counter(), Counter()
    for keys in baskets.values():
        n.update(keys)
        nab.update(itertools.combinations(sorted(keys), 2))
    return {(a, b): c for (a, b), c in nab.items() if c >= min_pair and c * c >= cosine**2 * n[a] * n[b]}


@pytest.mark.parametrize("heavy,long_basket,block,cosine", [(3, 1000, 60_000, .5), (8, 12, 50, 0.0), (0, 8, 10, .5), (4, 6, 7, .3)])
def test_against_brute_force(spark, heavy, long_basket, block, cosine):
    rng = random.Random(heavy * 100 + long_basket)
    rows = []
    for basket in range(120):
        size = rng.choice([1, 2, 3, 5, 9, 14])
        rows += [(f"b{basket}", f"T::k{min(int(rng.expovariate(.12)), 40)}") for _ in range(size)]
        if rng.random() < .4:
            rows.append((f"b{basket}", "T::hot"))
    rows += rows[:20] + [(None, "T::x"), ("b1", None)]
    df = spark.createDataFrame(rows, "basket string, key string").withColumn("n", F.lit(1)).withColumn("item", F.lit("z"))
    got = {(r.key_a, r.key_b): r.n_ab for r in
           pair_counts(df, "basket", F.col("key"), 5, cosine, heavy, long_basket, block).collect()}
    assert got == brute(rows, 5, cosine)


def test_keys_and_empty(spark):
    df = spark.createDataFrame([(" Zoë ", "P"), ("  ", "P"), (None, "P"), ("a", None), ("a", " ")], "name string, type string")
    assert [r[0] for r in df.select(entity_key()).collect()] == ["P::zoë", None, None, None, None]
    empty = spark.createDataFrame([], "basket string, key string")
    assert pair_counts(empty, "basket", F.col("key")).count() == 0


def test_long_baskets_in_small_blocks(spark, monkeypatch):
    from lodestrata.llm import cooccurrence

    monkeypatch.setattr(cooccurrence, "LONG_BLOCK", 3)
    test_against_brute_force(spark, 4, 6, 7, .3)
