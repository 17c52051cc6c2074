import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import encoding, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.DEFAULT_VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return encoding.PrefixEncoder(encoding.parse_ranks(open(encoding.DEFAULT_VOCABULARY, "rb").read()))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = encoding.parse_ranks(open(encoding.DEFAULT_VOCABULARY, "rb").read())
    return tiktoken.Encoding("own", pat_str=encoding.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t  　'abest1٣é漢😀.<|>"), st.characters(codec="utf-8")),
                    max_size=60))
def test_same_ids_as_the_library(encoder, reference, text):
    import pyarrow as pa

    want = reference.encode_ordinary(text)
    assert encoder.encode(text) == want
    offsets, ids = encoding.encode_batch(encoder, pa.array([text, None, text]))
    assert ids[: offsets[1]].tolist() == want and offsets[1] == offsets[2]
    assert ids[offsets[2]:].tolist() == want


def test_corpus_cases(spark, reference):
    rows = [(1, "plain text", "x"), (2, None, "x"), (3, "", None), (4, "   ", "x"), (5, "ab " * 50_000, "x"),
            (1, "plain text", "x"), (6, f"with {encoding.MARK} mark", "x"), (7, "<|endoftext|>", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encoding.encode_corpus(docs).collect())
    assert got == sorted((i, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    assert encoding.encode_corpus(docs.limit(0)).count() == 0


def test_water_fill_clamps_and_redistributes():
    got = mixing.water_fill({"a": 10, "b": 1000, "c": 1000}, {"a": .5, "b": .25, "c": .25}, {"a": 2, "b": 3, "c": 3}, 1000)
    assert got["a"] == 20 and got["b"] == got["c"] == 490
    got = mixing.water_fill({"a": 10, "b": 10}, {"a": .5, "b": .5}, {"a": 1, "b": 1}, 1000)
    assert got == {"a": 10, "b": 10}
    assert mixing.water_fill({}, {"a": 1.0}, {"a": 3}, 0) == {"a": 0}


def test_report_and_mix(spark):
    docs = spark.createDataFrame(
        [(i, "word " * 10, "big") for i in range(400)] + [(1000 + i, "word " * 10, "small") for i in range(10)]
        + [(5000, None, "small"), (5001, "lost", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", .8, 2), ("small", .15, 2), ("gone", .05, 3), (None, .1, 1)],
                                    "source string, weight double, max_repeats int")
    counts = mixing.token_counts(docs)
    report = mixing.mix_plan(counts, targets)
    rows = {r.source: r for r in report.collect()}
    assert rows["gone"].short and rows["small"].short and not rows["big"].short
    assert rows["small"].repeats == 2
    docs = docs.selectExpr("*", "'x' AS repeats", "'y' AS copy")
    mixed = mixing.mix(docs, report)
    assert mixed.columns == ["doc_id", "text", "source", "repeats", "copy"]
    again = sorted((r.doc_id, r["copy"]) for r in mixed.collect())
    assert again == sorted((r.doc_id, r["copy"]) for r in mixing.mix(docs.repartition(7), report).collect())
    small = [x for x in again if 1000 <= x[0] <= 5000]
    assert len(small) == 22
    big = sum(x[0] < 1000 for x in again)
    assert abs(big - 400 * rows["big"].repeats) < 40
    # The shares reported are those of what is drawn.
    shown = {r.source: r for r in mixing.mix_report(counts, report).collect()}
    drawn = mixed.join(counts.withColumnRenamed("source", "s"), "doc_id").groupBy("source").sum("n_tokens").collect()
    assert {r.source: r[1] for r in drawn} == {s: r.used for s, r in shown.items() if r.used}
    assert abs(sum(r.share for r in shown.values()) - 1) < 1e-9 and shown["gone"].used == 0 and shown["big"].used_docs == big
    nothing = mixing.token_counts(docs.limit(0))
    assert mixing.mix_report(nothing, mixing.mix_plan(nothing, targets)).where("used > 0 OR share > 0").count() == 0
