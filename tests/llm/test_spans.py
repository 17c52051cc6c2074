import random

import numpy as np
import pytest

from lodestrata.llm import spans


def brute(docs, n):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            where.setdefault(t[i:i + n], set()).add(d)
    out = set()
    for d, t in dict(docs).items():
        hit = [i for i in range(len(t or "") - n + 1) if where[t[i:i + n]] - {d}]
        a = None
        for i in hit:
            if a is None or i > b:
                if a is not None:
                    out.add((d, a, b))
                a = i
            b = i + n
        if a is not None:
            out.add((d, a, b))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé😀 ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            s = s[a: a + rng.randint(10, len(s))]
            if rng.random() < .3:
                s = s[: len(s) // 2] + "#" + s[len(s) // 2 + 1:]
            at = rng.randint(0, len(t))
            t = t[:at] + s + t[at:]
        docs.append((i, t))
    docs += [(100 + i, shared[0] + shared[1]) for i in range(20)]
    docs += [(200, "a" * 500), (201, "xyz" + "a" * 130), (202, None), (203, ""), (204, shared[2] * 3), (205, "b" * 400)]
    return docs


@pytest.mark.parametrize("seed,section", [(1, 600_000), (2, 150), (3, 37)])
def test_against_brute_force(spark, seed, section, monkeypatch):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, t, 1) for d, t in docs], "doc_id long, text string, seed string, start int")
    if section != 600_000:
        whole = list(spans._sections([1], ["".join(t or "" for _, t in docs)], 40))
        assert len(whole) >= 1
        monkeypatch.setattr(spans, "SECTION", section)
        assert len(list(spans._sections([1], ["".join(t or "" for _, t in docs)], 40))) > 5
    found = spans.matches(df, min_len=40, k=20)
    chained = spans.passages(found)
    got = [(r.doc_id, r.span_start, r.span_end) for r in spans.shared_spans(chained).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, 40)
    shares = {r.doc_id: r for r in spans.shared_part(spans.shared_spans(chained), df).collect()}
    assert shares[202].share == 0 and shares[100].share == 1.0 and len(shares) == len(docs)


def test_chain_takes_every_run_once():
    rng = random.Random(5)
    runs = sorted({(a, a + rng.randint(5, 40), rng.randint(0, 500)) for a in range(0, 600, 13)})
    chains = spans.chain(runs)
    assert sorted(x for c in chains for x in c) == runs
    for c in chains:
        assert all(x[0] < y[0] and x[2] < y[2] for x, y in zip(c, c[1:]))
    assert spans.chain([(0, 50, 100), (60, 110, 160)]) == [[(0, 50, 100), (60, 110, 160)]]


def test_sections_give_the_same_windows():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abc"), 2000))
    who, position, low, high, seed, context = spans.seeds_of([1], [text], 40, 20)
    whole = {(int(p), int(s)) for p, s in zip(position, seed)}
    starts = sorted(x for p, a, b in zip(position, low, high) for x in range(p - b, p - a + 1))
    assert starts == list(range(len(text) - 39)) and whole


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_spans(spans.passages(spans.matches(empty))).count() == 0


def test_common_subsequence():
    from lodestrata.llm.spans import agreeing

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert agreeing(a, b) == row[-1]


def _next(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
    return new


def test_gaps_between_runs_are_aligned(spark):
    from lodestrata.llm.spans import agreeing, aligned, matches, passages

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    first, gap, last = (" ".join(word() for _ in range(n)) for n in (80, 20, 80))
    edited = gap[:30] + "XYZ" + gap[35:60] + gap[64:]
    rows = [(1, "own start " + first + gap + last), (2, first + edited + last + " own end"), (3, None), (4, "x" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS doc")
    got = {r.doc: r for r in aligned(passages(matches(docs)), docs).collect()}
    assert set(got) == {1, 2} and len(got[1].runs) == 2
    left, right = got[1].runs
    mid, other = rows[0][1][left.end: right.start], rows[1][1][left.other_end: right.other_start]
    assert got[1].agree == got[1].exact + agreeing(mid, other) > got[1].exact + 20
    assert .97 < got[1].identity < 1 and got[2].agree == got[1].agree
    assert aligned(passages(matches(docs.limit(0))), docs).count() == 0
