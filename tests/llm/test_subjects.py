import random

import numpy as np

from lodestrata.llm import subjects

WORDS = {"Law": "verdict tribunal barrister litigation clause hearing plaintiff ruling covenant bylaw".split(),
         "Sport": "hurdle dribble jersey medal pitch goalkeeper sprint relay marathon trophy".split(),
         "Medicine": "sepsis vein suture triage remission kidney tumour surgeon dosage insulin".split()}


def corpus(spark, docs=90):
    rng, rows, about, truth = random.Random(1), [], [], {}
    names = sorted(WORDS)
    for d in range(docs):
        main = names[d % 3]
        other = names[(d + 1) % 3] if d % 4 == 0 else None
        truth[f"d{d}"] = {main} | ({other} if other else set())
        for c in range(4):
            sentences = []
            for k in range(6):
                s = other if other and k % 2 else main
                if k == 5 and c == 0:
                    s = names[(d + 2) % 3]
                words = rng.sample(WORDS[s], 3)
                sentences.append(f"The {words[0]} of the {words[1]} summarises every {words[2]} again.")
            rows.append((f"d{d}", f"d{d}-{c}", " ".join(sentences), "x"))
        said = main if rng.random() < .7 else rng.choice([None, names[(d + 1) % 3], "tbd"])
        about.append((f"d{d}", said.lower() if said else None))
    rows += [("d0", "d0-0", rows[0][2], "x"), ("blank", "b-0", "  ", "x"), ("none", "n-0", None, "x"), (None, "z", "verdict", "x")]
    chunks = spark.createDataFrame(rows, "source_doc string, chunk_id string, text string, terms string").selectExpr("*", "1 AS share")
    docs_df = spark.createDataFrame(about, "source_doc string, domain string")
    labels = spark.createDataFrame([("d1", names[1], None), ("d2", names[2], "r"), (None, "Law", "r")], "source_doc string, subject string, labeller string")
    taxonomy = spark.createDataFrame([(n, None, None, []) for n in names] + [("Wound Care", "Medicine", "Soin", ["Dressing"])],
                                     "canonical string, parent string, label_fr string, synonyms array<string>")
    return chunks, docs_df, labels, taxonomy, truth


def test_planted_subjects(spark):
    chunks, docs, labels, taxonomy, truth = corpus(spark)
    shares = subjects.subject_shares(chunks, docs, labels, taxonomy, topics=6, rounds=10, min_chunks=2)
    rows = shares.collect()
    got = {}
    for r in rows:
        if r.share >= .2:
            got.setdefault(r.source_doc, set()).add(r.subject)
    assert sum(got.get(d) == t for d, t in truth.items()) >= .97 * len(truth)
    assert "blank" not in got and "none" not in got
    mixed = {r.subject: r for r in subjects.composition(shares).collect()}
    assert abs(sum(r["share"] for r in mixed.values()) - 1) < 1e-9 and len(mixed) == 3


def test_empty(spark):
    chunks, docs, labels, taxonomy, _ = corpus(spark, 3)
    assert subjects.subject_shares(chunks.limit(0), docs, labels, taxonomy).count() == 0
    assert subjects.subject_shares(chunks, docs, labels, taxonomy.limit(0)).count() == 0


def test_inspection_maps_topics_by_their_top_terms():
    topics = np.array([[9.0, 9, 1, 0, 2], [0, 1, 9, 8, 2], [1, 1, 1, 1, 20]])
    counts = np.array([[90.0, 2], [80, 3], [1, 70], [0, 60], [50, 50]])
    by_topic = subjects.inspect(topics, counts)
    assert by_topic.argmax(axis=1)[:2].tolist() == [0, 1] and by_topic[:2].max(axis=1).min() > .75
    assert by_topic[2].max() < .6


def test_core_terms_of_large_subjects_stay(spark):
    chunks, docs, labels, taxonomy, truth = corpus(spark)
    got = {}
    for r in subjects.subject_shares(chunks, docs, labels, taxonomy, topics=6, rounds=10, min_chunks=2).where("share >= 0.2").collect():
        got.setdefault(r.source_doc, set()).add(r.subject)
    assert sum(got.get(d) == t for d, t in truth.items()) >= .97 * len(truth)


def test_general_words_are_even_over_subjects():
    counts = np.array([[900.0, 300, 100], [400, 20, 5], [3, 40, 2], [0, 0, 0]] + [[0, 10, 30]] * 3)
    assert subjects.specific(counts).tolist() == [False, True, True, True, True, True, True]


def test_sentences_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(subjects, "BLOCK", 3)
    chunks = spark.createDataFrame([("a", "The pitch. No such. A goalkeeper and pitch!"), ("b", "Nothing here."), ("a", "Kidney kidney.")], "source_doc string, text string")
    batch = subjects.sentences(chunks, ["pitch", "goalkeeper", "kidney"]).coalesce(1).toArrow().combine_chunks().to_batches()[0]
    assert batch.column("terms").to_pylist() == [[0, 1, 0], [], [2, 2]] and batch.column("counts").to_pylist() == [[1, 2], [], [2]]
    got = [tuple(x.tolist() for x in block) for block in subjects._blocks(batch)]
    assert got == [([0, 1, 0], [0, 1], [10, 23], [0, 0]), ([2, 2], [0], [14], [2])]


def test_the_topics_decide(spark):
    chunks, docs, labels, taxonomy, truth = corpus(spark)
    held = {}

    def found(topics, by_topic):
        rows = subjects.proportions(held["sentences"], topics, by_topic, sorted(WORDS)).where("share >= 0.2").collect()
        return {(r.source_doc, r.subject) for r in rows}

    own = subjects.proportions

    def spy(sentences, topics, by_topic, names, least=0.3):
        held.update(sentences=sentences, topics=topics, by_topic=by_topic)
        return own(sentences, topics, by_topic, names, least)

    subjects.proportions = spy
    try:
        subjects.subject_shares(chunks, docs, labels, taxonomy, topics=6, rounds=5, min_chunks=2)
    finally:
        subjects.proportions = own
    want = {(d, s) for d, subject in truth.items() for s in subject}
    assert len(found(held["topics"], held["by_topic"]) & want) >= .97 * len(want)
    flat = np.full_like(held["topics"], 1 / held["topics"].shape[1])
    random = np.random.default_rng(2).dirichlet(np.full(flat.shape[1], .1), len(flat))
    for other in (flat, random):
        assert len(found(other, held["by_topic"]) & want) < .7 * len(want)


def test_passes_sharpen_topics(spark):
    """Terms that stand with a subject's terms join its topics, though no hint speaks of them."""
    rows = [("d", "striker corner"), ("d", "striker whistle"), ("d", "tribunal corner"), ("d", "tribunal affidavit")] * 20
    held = subjects.sentences(spark.createDataFrame(rows, "source_doc string, text string"), ["striker", "tribunal", "corner", "whistle", "affidavit"])
    begin = subjects.begin_topics(np.array([[9.0, 0], [0, 9], [1, 1], [1, 1], [1, 1]]), 4, 1)
    topics = subjects.fit_topics(held, begin, 4)
    assert np.allclose(topics.sum(axis=1), 1)
    by_term = topics / topics.sum(axis=0)
    sport, law = by_term[:, 0], by_term[:, 1]
    assert by_term[:, 3] @ sport > 3 * (by_term[:, 3] @ law) and by_term[:, 4] @ law > 3 * (by_term[:, 4] @ sport)
