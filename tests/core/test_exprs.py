"""Scalar functions against direct restatements of their rules."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import exprs, udfs

NEGATION = [("supervised", "unsupervised", True), ("linear", "nonlinear", True), ("regular", "irregular", True), ("legal", "illegal", True), ("mature", "immature", True),
            ("active", "inactive", True), ("like", "dislike", True), ("body", "antibody", True), ("use", "misuse", True), ("code", "decode", True), ("stable", "unstable", True),
            ("Paris", "London", False), ("in", "inin", False), ("same", "same", False), ("un", "unun", False), ("art", "chart", False)]
NUMBERS = [("GPT 3", "GPT 4", True), ("2", "2.0", True), ("1", "01", True), ("v1 2", "v2 1", False), ("one", "1", False), ("a", "b", False), ("3.5", "3.5", False), ("10", "100", True)]


def evaluate(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row int, " + schema).orderBy("_row").select(column).collect()]


def test_negation(spark):
    got = evaluate(spark, [r[:2] for r in NEGATION], "a string, b string", exprs.negation_pair("a", "b"))
    assert got == [r[2] for r in NEGATION]


def test_numbers(spark):
    got = evaluate(spark, [r[:2] for r in NUMBERS], "a string, b string", exprs.numeric_conflict("a", "b"))
    assert got == [r[2] for r in NUMBERS]


@pytest.mark.parametrize("a,b,want", [("Law", "law ", False), ("Law", None, False), ("", "Law", False), ("Law", "Sport", True), (None, None, False)])
def test_domains(spark, a, b, want):
    assert evaluate(spark, [(a, b)], "a string, b string", exprs.domain_mismatch("a", "b")) == [want]


def test_confidence(spark):
    rows = [(0.9, 0.8), (None, 1.0), (-1.0, 0.5), (2.0, 0.5)]
    assert evaluate(spark, rows, "a double, b double", F.round(exprs.combine_confidence("a", "b"), 6)) == [0.72, 0.0, 0.0, 0.5]
    rows = [(1, 1.0, False), (2, None, False), (3, 0.5, True), (9, 2.0, False)]
    assert evaluate(spark, rows, "t int, q double, f boolean", F.round(exprs.extraction_confidence("t", "q", "f"), 6)) == [0.95, 0.85, 0.315, 0.75]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t!-_'1.", max_size=20), min_size=1, max_size=20))
def test_normalised_names(spark, names):
    want = [re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", n.strip().lower())) for n in names]
    assert evaluate(spark, [(n,) for n in names], "a string", exprs.normalize_name("a")) == want


def test_acronyms(spark):
    rows = [("Machine Learning (ML)", "ml", True), ("ML", "Machine Learning", True), ("Machine Learning", "M.L.", True), ("Deep Nets", "DNN", False), ("Bureau of Labor Statistics", "BLS", True),
            ("same", "SAME", True), ("(ML)", "ML", False), ("ml", "Machine Learning", False)]
    assert evaluate(spark, [r[:2] for r in rows], "a string, b string", exprs.acronym_match("a", "b")) == [r[2] for r in rows]
    assert evaluate(spark, [("support-vector of the machine",), ("",), ("a of",)], "a string", exprs.initials("a")) == ["SVM", "", ""]


def test_sections_and_tables(spark):
    rows = [("An overview", 0, 20), ("Title", 1, 20), ("appendix A", 19, 20), ("closing", 19, 20), ("our method", 5, 20), ("nothing", 5, 20), ("résumé", 5, 20), ("works cited", 5, 0)]
    assert evaluate(spark, rows, "t string, p int, n int", exprs.detect_section("t", "p", "n")) == [
        "abstract", "front_matter", "back_matter", "conclusion", "methodology", "body", "abstract", "conclusion"]
    assert evaluate(spark, [([[" a ", None], [], ["b", "c"]],)], "d array<array<string>>", exprs.table_text("d")) == ["a | \nb | c"]


def test_answers(spark):
    assert evaluate(spark, [("```json\n[\"a\", \" \", \"b \"]\n```",), ("no",)], "r string", exprs.json_strings("r")) == [["a", "b"], []]
    assert evaluate(spark, [("x {\"a\": {\"b\": 1}} y",), ("none",)], "r string", exprs.json_body("r")) == ["{\"a\": {\"b\": 1}}", None]
    rows = [("{\"results\": [{\"e\": 1}, 3]}", 3), ("[{\"e\": 1}]", 1), ("broken", 2), (None, 1), ("{\"e\": 1}", 1)]
    got = evaluate(spark, rows, "raw string, n int", udfs.batch_results("raw", "n"))
    assert got == [["{\"e\": 1}", "{}", "{}"], ["{\"e\": 1}"], ["{}", "{}"], ["{}"], ["{\"e\": 1}"]]


def test_udfs(spark):
    assert evaluate(spark, [("Été  à Paris",), (None,)], "t string", udfs.embedding_key("t")) == ["ete a paris", None]
    assert evaluate(spark, [("o'neil  data-sets",), (None,)], "t string", udfs.domain_name("t")) == ["O'Neil Data-Sets", None]
    assert evaluate(spark, [("abc", "abd"), ("learning", "learnings"), ("x", None)], "a string, b string", udfs.safe_fuzzy_match("a", "b")) == [False, True, None]


def test_validation_and_errors(spark):
    assert evaluate(spark, [("a", None), ("", "t"), ("a", "t")], "name string, type string", exprs.first_missing("name", "type")) == [
        "entity missing 'type'", "entity missing 'name'", None]
    assert evaluate(spark, [("429",), ("TPD reached",), ("Timeout",), ("?",)], "e string", exprs.classify_error("e")) == ["rate_limit", "daily_quota", "network", "unknown"]
