import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.splitting import kind, oversized, pieces, split_items


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="abcAB .!?…\n\f1é", max_size=400), limit=st.integers(5, 60), overlap=st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    cut = pieces(text, limit, overlap)
    assert all(b - a <= limit for a, b, _ in cut)
    if text:
        assert cut[0][0] == 0 and cut[-1][1] == len(text)
        assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(cut, cut[1:]))
    else:
        assert cut == []


@pytest.mark.parametrize("text,want", [
    ("A b c. " * 400, "natural"), ("word " * 500, "forced"), ("x" * 2001, "forced"), ("a b\n" * 600, "natural"),
    ("see no. 5 and Dr. Who with cf. Bell " * 60, "forced"), ("Count 12. Then " * 150, "forced"), ("what? Yes! " * 300, "natural"),
    ("what? yes! " * 300, "forced"), ("ends… " * 400, "forced"), ("Ends… " * 400, "natural"), ("y" * 1990 + ". " + "Z" * 1990, "natural")])
def test_kind(text, want):
    assert kind(text, 2000) == want


def test_natural_ends_are_used():
    text = "Some sentence here. " * 300
    assert all(text[:b].endswith(". ") for _, b, _ in pieces(text)[:-1])


def test_a_paragraph_that_fits_is_left_whole():
    first, second = "One sentence of it here. " * 57, "Another one of these. " * 40
    text = first.strip() + ".\n\n" + second.strip()
    cut = pieces(text)
    at = text.index("Another")
    assert cut[0][1] == at and cut[1] == (at - 200, len(text), 0)
    # A paragraph that no piece can hold is taken apart, and its sentences fill the piece that was begun.
    text = first.strip() + ".\n\n" + second * 5
    assert at < pieces(text)[0][1] <= 2000


def test_deeper_levels_only_where_needed():
    line = "word " * 300 + "\n"
    assert [b for _, b, _ in pieces(line * 3, 2000, 100)] == [1501, 3002, 4503]
    assert pieces("x" * 4500, 2000, 200) == [(0, 2000, 5), (1800, 3800, 5), (3600, 4500, 0)]


def test_frames(spark):
    rows = [("a", "Some words. " * 400, 1, "body"), ("a", "Some words. " * 400, 1, "body"), ("b", None, 2, None), ("c", "", 3, "x"),
            ("d", "short", 4, "x"), ("e", "q" * 100_001, 5, "x")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, page int, section string").selectExpr("*", "1 AS cut", "2 AS piece_no")
    assert sorted(map(tuple, oversized(df).collect())) == [("a", "natural"), ("a", "natural"), ("e", "forced")]
    out = split_items(df).collect()
    assert {r.chunk_id for r in out} == {"a", "d", "e"} and max(len(r.piece_text) for r in out) <= 2000
    whole = sorted((r.start, r.end, r.piece_text) for r in out if r.chunk_id == "e")
    text, at = "", 0
    for a, b, body in whole:
        text, at = text + body[at - a:], b
    assert text == "q" * 100_001
    assert split_items(df.limit(0)).count() == 0
