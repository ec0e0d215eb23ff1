import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.operators import emotions as em

LABELS = ["anger", "fear", "joy"]


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        label = rng.choice(LABELS)
        words = [f"{label}{rng.randrange(30)}" if rng.random() < 0.25 else f"w{rng.randrange(80)}" for _ in range(rng.randrange(3, 30))]
        out.append((label, " ".join(words)))
    return out


def plain(train, tests):
    """Labels and probabilities by a matrix of word counts."""
    names = sorted({label for label, _ in train})
    words = sorted({w for _, t in train for w in t.lower().split()})
    place = {w: i for i, w in enumerate(words)}
    counts, prior = np.zeros((len(names), len(words))), np.zeros(len(names))
    for label, t in train:
        prior[names.index(label)] += 1
        for w in t.lower().split():
            counts[names.index(label), place[w]] += 1
    logs = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + len(words)))
    out = []
    for t in tests:
        x = np.zeros(len(words))
        for w, n in Counter((t or "").lower().split()).items():
            if w in place:
                x[place[w]] = n
        s = np.log(prior / prior.sum()) + logs @ x
        e = np.exp(s - s.max())
        out.append(dict(zip(names, e / e.sum())))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    train = texts(1, 400)
    frame = spark.createDataFrame([(i, t, label) for i, (label, t) in enumerate(train)], "id int, text string, label string").repartition(4)
    return train, em.fit_emotions(frame.select("id", "text"), frame.select("id", "label"), ["id"])


def test_probabilities_against_numpy(spark, fitted):
    train, model = fitted
    tests = [t for _, t in texts(2, 100)] + ["", None, "unknown words only", "joy1 " * 3000]
    frame = spark.createDataFrame(list(enumerate(tests)), "id int, text string").withColumns({c: F.lit("x") for c in ("word", "label", "gains")})
    got = {}
    for r in em.emotion_probabilities(frame.repartition(3), model, ["id"]).collect():
        got.setdefault(r.id, {})[r.label] = r.probability
    for i, want in enumerate(plain(train, tests)):
        assert got[i].keys() == want.keys() and all(abs(got[i][k] - want[k]) < 1e-9 for k in want), i


def test_held_out_accuracy(spark, fitted):
    held = texts(3, 300)
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(held)], "id int, text string")
    rows = em.emotion_probabilities(frame, fitted[1], ["id"])
    best = {r.id: r.label for r in rows.groupBy("id").agg(F.max_by("label", "probability").alias("label")).collect()}
    assert sum(best[i] == label for i, (label, _) in enumerate(held)) / len(held) >= 0.9


def test_labels_by_terms_and_authors(spark):
    lexicon = spark.createDataFrame([("happy", "joy"), ("glad", "joy"), ("afraid", "fear"), ("thing", None)], "term string, emotion string")
    rows = [("a", 1, "Happy and GLAD thing"), ("a", 2, "happy but afraid"), ("a", 3, "thing"), ("b", 1, "afraid, afraid"), (None, 1, "glad"), ("c", 1, None)]
    frame = spark.createDataFrame(rows, "author string, seq int, text string")
    labels = em.label_by_terms(frame, lexicon, ["author", "seq"])
    assert sorted(map(tuple, labels.collect()), key=repr) == sorted([("a", 1, "joy"), ("b", 1, "fear"), (None, 1, "joy")], key=repr)
    shares = em.fitted_emotions(em.emotion_probabilities(frame, em.fit_emotions(frame, labels, ["author", "seq"]), ["author", "seq"]), k=1)
    assert {(r.author, r.label) for r in shares.collect()} == {("a", "joy"), ("b", "fear"), ("c", "joy"), (None, "joy")}


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([], "id int, text string, label string")
    with pytest.raises(ValueError):
        em.fit_emotions(frame, frame, ["id"])


def test_words_move_as_counts_only(spark):
    """No shuffle holds a row per text and word on the way to the counts, and the counts are read from where they were written."""
    rows = [("a", 1, "joy joy w1"), ("a", 1, "w1 w2"), ("b", None, "w1 fear"), (None, 2, "w3"), ("c", 3, None), ("d", 4, "joy fear")]
    df = spark.createDataFrame(rows, "author string, seq int, text string")
    terms = spark.createDataFrame([("joy", "joy"), ("fear", "fear")], "term string, emotion string")
    labels = em.label_by_terms(df, terms, ["author", "seq"])
    assert sorted(map(str, labels.collect())) == sorted(["Row(author='a', seq=1, label='joy')", "Row(author='b', seq=None, label='fear')"])
    sizes, counts = em.label_counts(df, labels, ["author", "seq"])
    assert counts.inputFiles()
    assert {(r.word, r.label): r.n for r in counts.collect()} == {("joy", "joy"): 2, ("w1", "joy"): 2, ("w2", "joy"): 1, ("w1", "fear"): 1, ("fear", "fear"): 1}
    assert {(r.label, r.texts, r.words) for r in sizes.collect()} == {("joy", 1, 5), ("fear", 1, 2)}
