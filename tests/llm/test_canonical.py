import pytest

from lodestrata.llm import canonical
from lodestrata.llm.canonical import NONE, Canonicaliser, canonical_values, edits, entries_of, fold

ENTRIES = [("Wound Care", ["Soin des plaies", "Dressing Practice"]), ("Medicine", ["Médecine"]), ("Law", []),
           ("LOCATED_IN", ["SITUATED_AT"]), ("CITES", ["QUOTES_FROM"]), ("Urban Air Quality", ["City Smog Watch"])]


@pytest.mark.parametrize("value,want", [
    ("Wound Care", "Wound Care"), ("  WOUND care​", "Wound Care"), ("WoundCare", "Wound Care"), ("woundcare", "Wound Care"),
    ("Care, wound", "Wound Care"), ("soin des plaies", "Wound Care"), ("medecine", "Medicine"), ("Medicine - unit 2", "Medicine"),
    ("ＬＯＣＡＴＥＤ＿ＩＮ", "LOCATED_IN"), ("has been situated at", "LOCATED_IN"), ("locat. in", "LOCATED_IN"), ("CIES", "CITES"),
    ("Urban Air Qaulity", "Urban Air Quality"), ("Laws", "Law"), ("tbd", NONE), ("???", NONE), ("Cheese tasting", NONE), ("17", NONE),
    ("woundcarefulness", NONE), ("x" * 100_000 + " wound care", "Wound Care")])
def test_values(value, want):
    assert Canonicaliser(ENTRIES)(value) == want


def test_longest_mention_wins():
    made = Canonicaliser([("Care", []), ("Wound Care", [])])
    assert made("about wound care") == "Wound Care" and made("care home") == "Care"


def test_edits_and_fold():
    assert edits("abcd", "abdc", 1) == 1 and edits("abc", "", 2) == 3 and edits("same", "same", 0) == 0
    assert fold("designedBy") == "designed by" and fold("ÉTÉ_deux") == "ete deux"


def test_frame(spark):
    rows = spark.createDataFrame([(1, "wound care"), (2, None), (3, "  "), (1, "wound care"), (4, "nope")], "id long, value string")
    rows = rows.selectExpr("*", "'x' AS canonical", "1 AS __value2")
    got = sorted((r.id, r.canonical) for r in canonical_values(rows, "id", "value", ENTRIES).collect() if r.canonical)
    assert got == [(1, "Wound Care"), (1, "Wound Care"), (4, NONE)]
    assert canonical_values(rows.limit(0), "id", "value", ENTRIES).count() == 0
    assert {r.canonical for r in canonical_values(rows, "id", "value", []).collect()} == {None, NONE}
    listed = spark.createDataFrame([("A", ["b", None], None), (None, ["c"], "d")], "canonical string, synonyms array<string>, label_fr string")
    assert entries_of(listed, ["synonyms", "label_fr"]) == [("A", ["b"])]


def _all_patterns(own, folded):
    """The fallback without its index."""
    words = folded.split()
    meant = [w for w in words if w not in canonical.FILLER and not w.isdigit()] or words
    together = "".join(words)
    best, found = own.least, None
    for n, (tokens, joined, _) in enumerate(own.patterns):
        score = max(own._tokens(tokens, words, meant), own._joined(joined, together))
        if score > best or (score == best and found is None):
            best, found = score, n
    return None if found is None else (best, found)


def _made(seed):
    import random

    rng = random.Random(seed)
    syllables = "ba co di fu ge hi jo ka lu me no pi qua re so tu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    stock = [word() for _ in range(40)] + ["of", "and", "law"]
    entries = [(" ".join(rng.choice(stock) for _ in range(rng.randint(1, 4))), []) for _ in range(150)]

    def typed():
        name = rng.choice(entries)[0] if rng.random() < .8 else f"{word()} {word()}"
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(name) + 1)
            name = rng.choice([name[:i] + name[i + 1:], name[:i] + rng.choice("aeiou ") + name[i:], name[:i] + name[i:i + 2][::-1] + name[i + 2:], name[:-1]])
        return name

    return entries, [typed() for _ in range(400)]


def test_the_index_leaves_out_no_entry():
    for seed in range(4):
        entries, values = _made(seed)
        own = canonical.Canonicaliser(entries)
        for v in values:
            folded = canonical.fold(v)
            assert own.scored(folded) == _all_patterns(own, folded), v


def test_a_long_list_in_blocks_is_as_one_in_a_piece(spark):
    entries, values = _made(9)
    entries = sorted(dict(entries).items())
    values += [entries[0][0], "", "  ", None, "see " + entries[3][0] + " and " + entries[70][0]]
    listed = spark.createDataFrame([(c, None) for c, _ in entries] + [(None, None)], "canonical string, synonyms array<string>")
    got = dict(map(tuple, canonical.by_blocks(spark.createDataFrame([(v,) for v in values], "value string"), listed, ["synonyms"], block=40).collect()))
    own = canonical.Canonicaliser(entries)
    assert got == {v: own(v) if v.strip() else None for v in values if v is not None}
