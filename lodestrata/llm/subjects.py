"""Problem 4: the subject areas of each document.

1. Vocabulary: words by the number of chunks that hold them, counted over all chunks; those in fewer than ``min_chunks`` say too little.
   General words are those that spread evenly over the subjects, however often they stand; they go. At most ``vocabulary`` of the others,
   the most frequent, are kept: that bounds the model.
2. Topics: latent Dirichlet allocation over the *sentences*, which are of one subject where a chunk or document is of several. It is fitted
   by distributed passes of collapsed variational inference (of order zero): each pass reads the whole corpus, every task sums its expected
   counts, the sums are combined per term in a shuffle. The topics begin near the subjects: ``topics / subjects`` of them at each subject's
   term counts in hinted documents, spread at random, so that a few passes settle them.
3. Inspection: each topic is mapped to subjects through its top terms: how often these stand in chunks of documents with a subject,
   relative to the size of that subject. Readers' labels count for a document where there are any, else its domain, mapped to the taxonomy.
4. Assignment: the model infers the topic proportions of every sentence; mapped to subjects they give the sentence to the subject with most
   of them. A document's proportions are the shares of its characters. Subjects with a share of ``least`` or more are the document's. The counts by
   hint have no say but through the topics.

What is broadcast is one matrix of ``vocabulary`` by ``topics`` numbers (at the defaults 16 MB at most, and twice that comes to the driver after a pass). Null and
blank texts say nothing; a document without any term has no subject; repeated chunks count once; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .canonical import NONE, Canonicaliser

_TERM = re.compile(r"[a-zà-öø-ÿœ]{4,}")
_TERM_SQL = "[a-zà-öø-ÿœ]{4,}"
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n\s*\n")


def hinted(docs: DataFrame, labels: DataFrame, entries: list, subject_of: dict[str, str]) -> DataFrame:
    """``source_doc, subject, weight``: what is said of a document; labels before domains, several share the weight."""
    made: list[Canonicaliser] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Canonicaliser(entries))
        for batch in batches:
            said = [subject_of.get(made[0](v)) if v and v.strip() and made[0](v) != NONE else None for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), batch.column(2)], names=["source_doc", "subject", "rank"])

    both = docs.select("source_doc", "domain", F.lit(2).alias("rank")).unionByName(
        labels.select("source_doc", F.col("subject").alias("domain"), F.lit(1).alias("rank"))).where("source_doc IS NOT NULL")
    said = both.mapInArrow(run, "source_doc string, subject string, rank int").where("subject IS NOT NULL").distinct()
    best = said.groupBy("source_doc").agg(F.min(F.struct("rank")).alias("b"), F.collect_set(F.struct("rank", "subject")).alias("all"))
    chosen = best.select("source_doc", F.filter("all", lambda x: x["rank"] == F.col("b.rank")).alias("own"))
    return chosen.select("source_doc", F.explode("own.subject").alias("subject"), (F.lit(1.0) / F.size("own")).alias("weight"))


def term_counts(chunks: DataFrame, hints: DataFrame, subjects: list[str], size: int, min_chunks: int) -> tuple[list[str], np.ndarray]:
    """The ``size`` terms in most chunks, and how many chunks of each subject hold each; one aggregation, combined before the shuffle."""
    said = hints.where(F.col("subject").isin(subjects)).groupBy("source_doc").agg(
        *[F.sum(F.when(F.col("subject") == name, F.col("weight")).otherwise(0.0)).alias(f"s{j}") for j, name in enumerate(subjects)])
    terms = chunks.select("source_doc", F.explode(F.array_distinct("terms")).alias("term")).join(said, "source_doc", "left")
    rows = terms.groupBy("term").agg(F.count("*").alias("df"), *[F.coalesce(F.sum(f"s{j}"), F.lit(0.0)).alias(f"s{j}") for j in range(len(subjects))]).where(
        F.col("df") >= min_chunks).orderBy(F.desc("df"), "term").limit(size).toArrow()  # at most `size` rows
    words = rows["term"].to_pylist()
    return words, np.stack([rows[f"s{j}"].to_numpy() for j in range(len(subjects))], axis=1) if subjects else np.zeros((len(words), 0))


def fair_counts(counts: np.ndarray) -> np.ndarray:
    """The evidence as if every subject were of the same size."""
    size = counts.sum(axis=0)
    return counts / np.where(size > 0, size, 1) * (size.sum() / max(1, (size > 0).sum()))


def specific(counts: np.ndarray) -> np.ndarray:
    """Which terms may say something of a subject: all but those whose evidence is surely even. Without evidence a term may."""
    fair = fair_counts(counts)
    n = np.maximum(fair.sum(axis=1), 1e-12)
    top = fair.max(axis=1) / n
    return top + 2 * np.sqrt(np.maximum(top * (1 - top), 1e-3) / n) >= 1.5 / counts.shape[1]


def inspect(topics: np.ndarray, counts: np.ndarray, top_terms: int = 30) -> np.ndarray:
    """The subject weights of topics by their top terms, rows sum to one."""
    fair = fair_counts(counts)
    even = np.full(counts.shape[1], 1 / counts.shape[1])
    by_topic = np.zeros((len(topics), counts.shape[1]))
    shares = topics / topics.sum(axis=1, keepdims=True)
    for k, row in enumerate(shares):
        top = np.argsort(-row)[:top_terms]
        each = (fair[top] + even) / (fair[top].sum(axis=1, keepdims=True) + 1)
        by_topic[k] = row[top] @ each
    return by_topic / np.maximum(by_topic.sum(axis=1, keepdims=True), 1e-12)


def sentences(chunks: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``source_doc, terms array<int>, counts array<int>, sizes array<int>``: the terms of every sentence that has any, one after another,
    how many there are and how many characters it has."""
    place = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                held, number, chars = [], [], []
                for sentence in _SENTENCE.split(text):
                    found = [place[w] for w in _TERM.findall(sentence.lower()) if w in place]
                    if found:
                        held += found
                        number.append(len(found))
                        chars.append(len(sentence))
                terms.append(held)
                counts.append(number)
                sizes.append(chars)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, ints) for c in (terms, counts, sizes))], names=["source_doc", "terms", "counts", "sizes"])

    return chunks.select("source_doc", "text").mapInArrow(run, "source_doc string, terms array<int>, counts array<int>, sizes array<int>")


#: Terms that are looked at together in a task; bounds its memory.
BLOCK = 20_000


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(terms, first term of each sentence, characters of each, row of each)`` of a batch, about BLOCK terms at a time."""
    terms, counts, sizes = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts", "sizes"))
    rows = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(batch.column("counts")).to_numpy(zero_copy_only=False))
    ends = np.cumsum(counts, dtype=np.int64)
    at = 0
    while at < len(ends):
        first = ends[at] - counts[at]
        stop = max(at + 1, int(np.searchsorted(ends, first + BLOCK, side="right")))
        yield terms[first: ends[stop - 1]], (ends[at:stop] - counts[at:stop] - first), sizes[at:stop], rows[at:stop]
        at = stop


def infer(terms: np.ndarray, starts: np.ndarray, by_term: np.ndarray, alpha: float = 0.1, steps: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """``(expected terms of each topic in each sentence, topic shares of each term)``; ``by_term`` holds a term's probability in each topic."""
    lengths = np.diff(np.append(starts, len(terms)))
    shares = np.empty((len(terms), by_term.shape[1]), np.float32)
    expected = np.empty((len(starts), by_term.shape[1]), np.float32)
    for n in np.unique(lengths):  # sentences of one length are one array
        at = np.flatnonzero(lengths == n)
        place = starts[at][:, None] + np.arange(n)
        likely = by_term[terms[place]]
        share = likely / np.maximum(likely.sum(axis=2, keepdims=True), 1e-30)
        for _ in range(steps):
            theta = share.sum(axis=1)
            theta += np.float32(alpha)
            np.multiply(likely, theta[:, None, :], out=share)
            scale = np.einsum("ijk->ij", share)
            share *= np.reciprocal(np.maximum(scale, 1e-30))[:, :, None]
        expected[at], shares[place] = share.sum(axis=1), share
    return expected, shares


def begin_topics(counts: np.ndarray, topics: int, seed: int, spread: float = 0.5) -> np.ndarray:
    """Topics near the subjects' own terms (counts by how far a term is the subject's alone), dealt in turn, and a tenth near the counts of all, for words of no subject; spread at random."""
    fair, rng = fair_counts(counts), np.random.default_rng(seed)
    own = fair * (fair / np.maximum(fair.sum(axis=1, keepdims=True), 1e-12)) ** 2
    near = own.T[np.arange(topics) % counts.shape[1]] + 0.01 * fair.mean(axis=1) + 0.02
    near[topics - max(1, topics // 10):] = fair.mean(axis=1) + 0.02
    near = near * np.exp(spread * rng.normal(size=near.shape))
    return near / near.sum(axis=1, keepdims=True)


def fit_topics(held: DataFrame, begin: np.ndarray, rounds: int, eta: float = 0.02) -> np.ndarray:
    """The topics (rows over terms, summing to one) after ``rounds`` passes over all sentences."""
    spark, topics = held.sparkSession, begin
    k, size = begin.shape
    columns = [f"c{i}" for i in range(k)]
    for _ in range(rounds):
        known = spark.sparkContext.broadcast(np.ascontiguousarray(topics.T, np.float32))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((size, k))
            for batch in batches:
                for terms, starts, _, _ in _blocks(batch):
                    _, share = infer(terms, starts, known.value)
                    order = np.argsort(terms, kind="stable")
                    names, first = np.unique(terms[order], return_index=True)
                    sums[names] += np.add.reduceat(share[order], first, axis=0)
            at = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(sums[at, i]) for i in range(k))], names=["term", *columns])

        summed = held.mapInArrow(run, "term int, " + ", ".join(f"{c} double" for c in columns)).groupBy("term").agg(
            *[F.sum(c).alias(c) for c in columns]).toArrow()  # one row per term of the vocabulary
        counts = np.full((k, size), eta)
        counts[:, summed["term"].to_numpy()] += np.stack([summed[c].to_numpy() for c in columns])
        topics = counts / counts.sum(axis=1, keepdims=True)
        known.destroy()
    return topics


def proportions(held: DataFrame, topics: np.ndarray, by_topic: np.ndarray, subjects: list[str], least: float = 0.3) -> DataFrame:
    """``source_doc, subject, share, chars``: the share of a document's characters, in sentences that say something.

    A topic speaks for a subject as far as that goes beyond half as much again as an even share, so a general topic speaks for none. A sentence with less than
    ``least`` terms (in expectation) that speak for some subject says nothing.
    """
    clear = np.maximum(by_topic - 1.5 / max(1, by_topic.shape[1]), 0)
    known = held.sparkSession.sparkContext.broadcast(np.ascontiguousarray(topics.T, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("source_doc").dictionary_encode()
            place = docs.indices.to_numpy(zero_copy_only=False)
            sums = np.zeros((len(docs.dictionary), len(subjects)))
            for terms, starts, sizes, rows in _blocks(batch):
                theta, _ = infer(terms, starts, known.value)
                said = theta @ clear
                at = np.flatnonzero(said.max(axis=1) >= least)
                np.add.at(sums, (place[rows[at]], said[at].argmax(axis=1)), sizes[at])
            doc, subject = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([docs.dictionary.take(pa.array(doc)), pa.array(subjects).take(pa.array(subject)), pa.array(sums[doc, subject])],
                                             names=["source_doc", "subject", "chars"])

    parts = held.mapInArrow(run, "source_doc string, subject string, chars double")
    sums = parts.groupBy("source_doc", "subject").agg(F.sum("chars").alias("chars"))
    whole = sums.groupBy("source_doc").agg(F.sum("chars").alias("all_chars"))
    return sums.join(whole, "source_doc").select("source_doc", "subject", (F.col("chars") / F.col("all_chars")).alias("share"), "chars")


def subject_shares(chunks: DataFrame, docs: DataFrame, labels: DataFrame, taxonomy: DataFrame, topics: int = 40, rounds: int = 5,
                   vocabulary: int = 100_000, min_chunks: int = 4, seed: int = 5) -> DataFrame:
    """``source_doc, subject, share, chars`` of every document with a subject-bearing sentence."""
    listed = taxonomy.where(F.col("canonical").isNotNull()).select("canonical", "parent", "label_fr", "synonyms").collect()  # a list kept by hand
    subject_of = {r.canonical: r.parent or r.canonical for r in listed}
    subjects = sorted(r.canonical for r in listed if r.parent is None)
    entries = [(r.canonical, [x for x in [r.label_fr, *(r.synonyms or [])] if x]) for r in sorted(listed)]
    texts = staged(chunks.where(F.col("source_doc").isNotNull() & F.col("text").isNotNull()).select("source_doc", "chunk_id", "text")
                   .dropDuplicates(["chunk_id", "text"]).withColumn("terms", F.regexp_extract_all(F.lower("text"), F.lit(_TERM_SQL), F.lit(0))), "terms")
    none = chunks.sparkSession.createDataFrame([], "source_doc string, subject string, share double, chars double")
    if not subjects:
        return none
    # A tenth more than are kept, so that general words take no other's place.
    words, counts = term_counts(texts, hinted(docs, labels, entries, subject_of), subjects, vocabulary + vocabulary // 10, min_chunks)
    kept = np.flatnonzero(specific(counts))[:vocabulary] if words else []
    if not len(kept):
        return none
    words, counts = [words[i] for i in kept], counts[kept]
    held = staged(sentences(texts, words), "sentences")
    found = fit_topics(held, begin_topics(counts, topics, seed), rounds)
    return proportions(held, found, inspect(found, counts), subjects)


def composition(shares: DataFrame) -> DataFrame:
    """``subject, chars, share, documents``: what the corpus is about."""
    total = shares.agg(F.sum("chars").alias("whole"))
    sums = shares.groupBy("subject").agg(F.sum("chars").alias("chars"), F.count(F.when(F.col("share") >= 0.2, 1)).alias("documents"))
    return sums.join(F.broadcast(total), F.lit(True)).select("subject", "chars", (F.col("chars") / F.col("whole")).alias("share"), "documents")
