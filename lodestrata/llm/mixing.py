"""Problem 9: mixing sources to target weights by capped water-filling.

Every source has a size (tokens), a weight and a cap on repetitions. The mix has a wanted total; a source whose share
of it exceeds ``size * max_repeats`` is clamped there and its excess is spread over the unclamped sources in
proportion to their weights, until no further source exceeds its cap. A source used ``r`` times contributes every
document ``floor(r)`` times and a seeded sample of them once more, so that the expected size is met.

The token counts are written once. Sizes are one aggregation of them; the water-filling runs over one row per *target* source (a list
given by hand, of ``MAX_TARGETS`` rows at most, that is checked), the sampling is a narrow pass over the documents, and the shares that are reported are measured
on what is drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .encoding import DEFAULT_VOCABULARY, encode_corpus


#: A list of targets is kept by hand; a longer one is refused rather than collected.
MAX_TARGETS = 100_000


def token_counts(docs: DataFrame, path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """``id_col, source, n_tokens`` of every document with a source, written once: sizes, plan and shares all read it."""
    return staged(encode_corpus(docs.where(F.col("source").isNotNull()), id_col=id_col, path=path, counts_only=True, keep=("source",)), "tokens")


def water_fill(sizes: dict[str, int], weights: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """Tokens that each source contributes to a mix of ``total`` tokens.

    Sources without a weight take no part. If all sources together cannot reach ``total``, every one stands at its cap.
    """
    room = {s: float(sizes.get(s) or 0) * max(0, caps.get(s) or 0) for s, w in weights.items() if w and w > 0}
    amounts: dict[str, float] = {}
    while room.keys() - amounts.keys():
        free = room.keys() - amounts.keys()
        left = total - sum(amounts.values())
        scale = left / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * scale >= room[s]]
        if not over:
            amounts |= {s: weights[s] * scale for s in free}
        else:
            amounts |= {s: room[s] for s in over}
    return amounts


def mix_plan(counts: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per target source: ``source, docs, tokens, weight, max_repeats, wanted, planned, repeats, short``.

    ``counts`` is from :func:`token_counts`. ``total`` defaults to the tokens of all documents with a source. ``short`` holds where
    ``tokens * max_repeats < weight * total``. Targets with a null source or weight are ignored, repeated target rows
    count once (largest weight and cap), a target without documents has size 0 and falls short unless its weight is 0. Sources that are no
    target only count towards the total.
    """
    spark = counts.sparkSession
    goals = targets.where(F.col("source").isNotNull() & F.col("weight").isNotNull()).groupBy("source").agg(
        F.max("weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    sizes = counts.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    rows = goals.join(sizes, "source", "left").limit(MAX_TARGETS + 1).collect()  # one row per target
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    whole = (counts.agg(F.sum("n_tokens")).head()[0] or 0) if total is None else total
    size = {r.source: int(r.tokens or 0) for r in rows}
    amounts = water_fill(size, {r.source: r.weight for r in rows}, {r.source: r.max_repeats for r in rows}, whole)
    out = [(r.source, int(r.docs or 0), size[r.source], float(r.weight), int(r.max_repeats), r.weight * whole, amounts.get(r.source, 0.0),
            amounts.get(r.source, 0.0) / size[r.source] if size[r.source] else 0.0, size[r.source] * r.max_repeats < r.weight * whole)
           for r in sorted(rows)]
    return spark.createDataFrame(out, "source string, docs bigint, tokens bigint, weight double, max_repeats int, "
                                      "wanted double, planned double, repeats double, short boolean")


def mix_report(counts: DataFrame, plan: DataFrame, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """The plan with what :func:`mix` really draws: ``used_docs, used`` (tokens) and ``share`` of all tokens drawn, measured by source.

    A source's copies are counted per task before the shuffle; what is drawn is what :func:`mix` gives with the same seed.
    """
    drawn = _times(counts, plan, seed, id_col).groupBy("source").agg(
        F.sum("__times").alias("used_docs"), F.sum(F.col("n_tokens") * F.col("__times")).alias("used"))
    report = plan.join(drawn, "source", "left").withColumn("used_docs", F.coalesce("used_docs", F.lit(0))).withColumn("used", F.coalesce("used", F.lit(0)))
    whole = drawn.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("__whole"))
    report = report.join(F.broadcast(whole), F.lit(True))  # one row
    return report.withColumn("share", F.when(F.col("__whole") > 0, F.col("used") / F.col("__whole")).otherwise(0.0)).drop("__whole")


def _fraction(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return (F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))


def _times(docs: DataFrame, plan: DataFrame, seed: int, id_col: str) -> DataFrame:
    """``docs`` of target sources with ``__times``: how often each document is drawn."""
    small = F.broadcast(plan.select(F.col("source").alias("__source"), F.col("repeats").alias("__repeats")))  # MAX_TARGETS rows at most
    times = F.floor("__repeats") + F.when(
        _fraction(seed, F.col(id_col)) < F.col("__repeats") - F.floor("__repeats"), 1).otherwise(0)
    return docs.join(small, docs["source"] == small["__source"]).withColumn("__times", times.cast("int")).where(
        "__times > 0").drop("__source", "__repeats")


def mix(docs: DataFrame, plan: DataFrame, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """The documents of the mix: ``docs`` with a ``copy`` number, each row as often as its source is repeated.

    Whole repetitions are unconditional; the fractional one takes a document if its seeded hash falls below the
    fraction, so a rerun, another partitioning or a lost executor gives the same rows. No source is gathered anywhere. Documents without a
    target source are left out; a column ``copy`` of the documents is replaced.
    """
    return _times(docs, plan, seed, id_col).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times")
