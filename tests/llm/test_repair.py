import random

import pytest

from lodestrata.llm import repair
from lodestrata.llm.repair import BREAK, furniture, misread, page_number, repaired, running_text, slug_of, train_editor

WORDS = """the baseline carefully shortens broad deforestation follow-up reduces preliminary monsoon records roughly committee
summarises drought frequent wetland openly estimate neither biodiversity independent number moderate clinic question appear from
which method interval ordinary remains under noted units every annual report long-term-plan change burden modern""".split()


@pytest.fixture(scope="module")
def editor():
    return train_editor(WORDS)


def test_held_out_misreadings(editor):
    rng, hits, whole = random.Random(99), 0, 0
    for _ in range(40):
        for word in WORDS:
            noisy, ops = misread(word, rng, 1)
            assert "".join(ops) == word
            if noisy == word:
                continue
            whole += 1
            known = [r for r, _ in editor.beam(noisy) if r in WORDS]
            hits += bool(known) and known[0] == word
    assert hits / whole > .95


@pytest.mark.parametrize("line,page,count,want", [
    ("9", 9, 20, True), ("- 9 -", 9, 20, True), ("— l2 —", 12, 20, True), ("[6]", 6, None, True), ("p. 55", 55, 58, True), ("3 / 15", 3, 15, True),
    ("Page 4 of 39", 4, 39, True), ("iv", 4, 9, True), ("9", 8, 20, False), ("704  395  398", 704, None, False), ("4.2 Overview", 4, 9, False),
    ("(number) 2-54", 2, 54, False), ("3531 units.", 3531, None, False), ("Page 4 of 38", 4, 39, False), ("", 1, 1, False), ("9", None, None, False)])
def test_page_numbers(line, page, count, want):
    assert page_number(line, page, count) == want


def test_furniture_lines():
    title, doc = "Notes on Branch, record and Reistubrabon", "branch-reistubrabon-0000040.pdf"
    text = "\n".join(["N0TES ON BRANCH, RECORD AND REISTUBRABON   40", "The branch of Reistubrabon records a", "Draft — N0tes on Branch, rec0rd and Reistubrabon",
                      "NOTES ON BRANCH, RECORD AND REI", "4.2 Overview of record", "12  40  13", "Notes on Branch, record and Reistubrabon · body | 40", "change."])
    assert furniture(text, 40, 69, title, doc) == [0, 2, 3, 6]
    assert furniture("Draft — Branch and record at Reistubrabon\nsome words here.", 1, 2, None, doc) == [0]
    assert furniture("Branch and record\nthat recur.", 1, 2, None, None, {repair._looks("Branch and record")}) == [0]
    assert furniture("one line only", 1, 1, "one line only", doc) == [] and furniture("", None, None, None, None) == []
    assert slug_of(doc) == ["branch", "reistubrabon"] and slug_of(None) == []
    assert running_text("a samp- \n9\nles of it\nhere\n\nfollow-\nup", [1]) == f"a samp{BREAK}les of it here\n\nfollow{BREAK}up"


def test_corpus(spark):
    clean = " ".join(WORDS)
    rows = [(f"c{i}", "plain.pdf", 2, clean, "x") for i in range(8)]
    rows += [("n1", "noisy-words-0001.pdf", 3, "Noisy words\nthe base-\nline carcfully short-\n3\nens a f0llow-\nup fr0m the Comm1ttee.\n\nwbich aрpear", "x"),
             ("n1", "noisy-words-0001.pdf", 3, "Noisy words\nthe base-\nline carcfully short-\n3\nens a f0llow-\nup fr0m the Comm1ttee.\n\nwbich aрpear", "x"),
             ("n2", "noisy-words-0001.pdf", 4, None, "x"), ("n3", None, None, "   ", "x"), ("n4", "plain.pdf", 9, "the modern " * 30_000, "x")]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_doc string, page int, text string, word string").selectExpr("*", "1 AS title")
    docs = spark.createDataFrame([("noisy-words-0001.pdf", "Noisy words", 5, [3]), ("plain.pdf", None, None, None)],
                                 "source_doc string, title string, page_count int, ocr_pages array<int>")
    bodies, changed = repair.repair(chunks, docs)
    got = {(r.kind, r.token) for r in changed.collect() if r.chunk_id == "n1"}
    assert got == {("line", "Noisy words"), ("line", "3"), ("hyphen", "baseline"), ("hyphen", "shortens"), ("hyphen", "follow-up"), ("char", "follow-up"),
                   ("char", "carefully"), ("char", "from"), ("char", "committee"), ("char", "which"), ("char", "appear")}
    assert {r.chunk_id for r in changed.collect()} == {"n1"}
    text = {r.chunk_id: r.repaired for r in repaired(bodies, changed).collect()}
    assert text["n1"] == "the baseline carefully shortens a follow-up from the Committee.\n\nwhich appear"
    assert text["c1"] == clean and text["n3"] == ""
    names = spark.createDataFrame([("Noisy Committee",), (None,)], "name string")
    assert repair.repair(chunks.limit(0), docs, names)[1].count() == 0


def test_four_misread_places_in_the_corpus(spark):
    lexicon = spark.createDataFrame([("deforestation", 40, 40), ("biodiversity", 40, 40), ("def0re5tat10n", 0, 1), ("bi0d1ver5itv", 0, 1)], "word string, clean long, n long")
    got = {r.word: r.right for r in repair.corrections(lexicon).collect()}
    assert got == {"def0re5tat10n": "deforestation", "bi0d1ver5itv": "biodiversity"}


def test_no_reading_of_a_known_word_is_lost(editor):
    for word, noisy in (("biodiversity", "bi0d1ver5itv"), ("deforestation", "def0re5tat10n"), ("internationalisation", "1nternati0na1i5ati0n")):
        begun = {word[:n] for n in range(1, len(word) + 1)}
        assert word in dict(editor.beam(noisy, begins=begun.__contains__)), noisy
    begun = {w[:n] for w in WORDS for n in range(1, len(w) + 1)}
    rng = random.Random(3)
    for word in WORDS:
        for times in (2, 3, 4):
            noisy, _ = misread(word, rng, times)
            assert word in dict(editor.beam(noisy, begins=begun.__contains__)), (word, noisy)
