"""Ordinal toxicity: held-out accuracy, ordered thresholds, odd rows."""

import random

import numpy as np
import pytest

from faultline.llm import toxicity

MILD, GRAVE = ["silly", "dummkopf"], ["vile", "filthy", "rotten", "wretched"]


def corpus(seed, n=1200):
    """(id, text, toxic): toxic texts hold one to six of the bad words among common ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randrange(1, 7)):
                words.insert(rng.randrange(len(words)), rng.choice(MILD + GRAVE))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    return toxicity.train(docs, labels, rows=500)


def test_held_out_accuracy_and_grades(spark, trained):
    rows = corpus(2)
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string"), trained).collect()}
    assert all(scored[i]["toxic"] == bool(y) for i, _, y in rows)
    assert np.all(np.diff(trained.thresholds) > 0) and len(trained.thresholds) == 3
    assert all(0 <= r["severity"] <= 3 and r["grade"] == round(r["severity"]) for r in scored.values())
    bad = {i: len(set(t.split()) & set(MILD + GRAVE)) for i, t, y in rows if y}
    assert np.mean([scored[i]["severity"] for i, n in bad.items() if n >= 4]) > np.mean([scored[i]["severity"] for i, n in bad.items() if n == 1]) + 0.5


def test_expected_grade_is_the_sum_of_the_links(trained):
    score = np.linspace(-5, 20, 50)
    expected = trained.expected(score)
    links = np.array([[1 / (1 + np.exp(t - s)) for t in trained.thresholds] for s in score])
    assert np.allclose(expected, links.sum(1)) and np.all(np.diff(expected) > 0)
    # The chances of the single grades are the differences of neighbouring links.
    chances = -np.diff(np.hstack([np.ones((50, 1)), links, np.zeros((50, 1))]), axis=1)
    assert np.all(chances > 0) and np.allclose((chances * np.arange(4)).sum(1), expected)


def test_odd_rows(spark, trained):
    rows = [(1, None), (2, ""), (3, "w1 VILE w2 Filthy"), (3, "w1 VILE w2 Filthy"), (None, "rotten vile wretched"), (4, "w5 " * 100_000), (5, "w5 " * 100_000 + "vile rotten")]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id bigint, text string, toxic int, _id string")
    got = [(r["doc_id"], r["toxic"]) for r in toxicity.score_toxicity(docs, trained).collect()]
    assert got == [(1, False), (2, False), (3, True), (3, True), (None, True), (4, False), (5, True)]
    kept = toxicity.drop_toxic(docs, trained)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1, 2, 4]
    assert toxicity.score_toxicity(docs.where("false"), trained).collect() == [] and toxicity.drop_toxic(docs.where("false"), trained).collect() == []


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1), (2, 1)], [(1, None), (None, 1)], [(1, 0), (1, 1), (2, 0), (77, 1)]])
def test_labels_that_teach_nothing_call_nothing_toxic(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (None, "e")], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert not any(r["toxic"] for r in toxicity.score_toxicity(docs, model).collect())


def test_sample_is_bounded_and_deterministic(spark):
    rows = corpus(3, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id bigint, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 20)
    assert sorted(r["_label"] for r in sample.collect()) == [0] * 20 + [1] * 20
    a, b = (toxicity.train(docs, labels, rows=20) for _ in range(2))
    assert np.array_equal(a.features, b.features) and np.allclose(a.weights, b.weights) and a.cut == b.cut
