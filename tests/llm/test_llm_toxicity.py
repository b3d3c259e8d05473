import random

import numpy as np
import pytest

from dayzero.llm import toxicity as tx

RUDE = ["blockhead", "nitwit", "dunce"]


@pytest.fixture
def corpus(docs, spark, prose):
    """Toxic texts hold rude words, or words with a rude beginning; a few labels are wrong."""
    pick = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(pick.randint(5, 60)).split(), i % 5 == 0
        for _ in range(pick.choice([1, 2, 4, 8]) if toxic else 0):
            rude = pick.choice(RUDE) if i % 2 else f"grob{pick.choice('abcdefg')}{pick.randint(0, 9)}x"
            words.insert(pick.randint(0, len(words)), rude.upper() if i % 3 else rude + "!")
        rows.append((i, " ".join(words), "en", "s"))
        if i % 3:
            labels.append((i, 1, int(toxic) if i % 40 else 1 - toxic))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_unseen_texts_are_told_apart(corpus):
    table, labels = corpus
    model = tx.train(table, labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.weights) <= tx.FEATURES
    got = {r.row.doc_id: r for r in tx.grade_documents(table, model, ["doc_id", "toxic"]).collect()}
    unseen = [i for i in range(900) if i % 3 == 0]
    right = sum(got[i].toxic == (i % 5 == 0) for i in unseen)
    assert right >= 0.97 * len(unseen)
    assert all(0 <= r.severity <= 3 and r.toxic == (r.p_toxic > 0.5) for r in got.values())
    assert all(r.grade >= 1 for r in got.values() if r.toxic)


def test_severity_grows_with_rude_words(corpus, docs):
    table, labels = corpus
    model = tx.train(table, labels)
    texts = [None, "", "alpha beta", "alpha nitwit beta", "nitwit " * 4, "nitwit dunce blockhead " * 4, "dunce " * 100_000]
    rows = docs([(i, t, None, None) for i, t in enumerate(texts)] * 2)
    got = sorted(tx.grade_documents(rows, model, ["doc_id"]).collect(), key=lambda r: r.row.doc_id)
    assert got[::2] == got[1::2]
    severity = [r.severity for r in got[::2]]
    assert severity[:2] == [0, 0]
    assert severity[2] < severity[3] < severity[4] < severity[5] <= severity[6] <= 3
    assert not got[4].toxic and got[8].toxic


def test_sample_is_bounded_and_repeatable(corpus):
    table, labels = corpus
    one, two = (tx.train(table.repartition(n), labels.repartition(n), sample=300, n_features=50) for n in (2, 5))
    assert len(one.weights) <= 50 and one.weights.keys() == two.weights.keys()
    np.testing.assert_allclose(list(one.weights.values()), list(two.weights.values()), rtol=1e-6, atol=1e-6)


def test_a_repeated_id_is_sampled_once(corpus, docs):
    table, labels = corpus
    hot = labels.first().doc_id
    more = table.unionByName(docs([(hot, f"text {i % 50}", "en", "s") for i in range(5000)]))
    n = labels.select("doc_id").distinct().count()
    for sample in (100, 10 * n):
        rows = tx._sampled(more, labels, sample, "doc_id", "text").collect()
        assert len(rows) <= min(n, 2 * sample)
    one, two = (tx.train(more.repartition(k), labels) for k in (2, 5))
    assert one.weights.keys() == two.weights.keys()


def test_without_labels_of_both_kinds(corpus, docs, spark):
    table, labels = corpus
    for known in (labels.where("false"), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        assert tx.train(table, known) is None
    out = tx.grade_documents(docs([(1, "nitwit", "en", "s"), (None, None, None, None)]), None, ["doc_id"]).collect()
    assert [(r.severity, r.grade, r.toxic) for r in out] == [(0.0, 0, False)] * 2
    assert tx.grade_documents(table.where("false"), tx.train(table, labels), ["doc_id"]).collect() == []


def test_repeated_labels_and_documents(corpus):
    table, labels = corpus
    again = labels.unionByName(labels).unionByName(labels.selectExpr("cast(null as long) doc_id", "quality", "toxic"))
    assert tx.train(table, again) == tx.train(table, labels)


def test_slopes_of_the_fit():
    """A fit of a known ordinal model finds weights of the right sign and order."""
    pick = np.random.default_rng(0)
    x = pick.integers(0, 4, (3000, 3)).astype(float)
    score = x @ np.array([2.0, -1.0, 0.0]) + pick.logistic(size=3000)
    grades = (score[:, None] > np.array([1.0, 3.0, 5.0])[None, :]).sum(1)
    found = [{f"f{i}": v for i, v in enumerate(row) if v} for row in x]
    model = tx.fit_ordinal(found, grades, ["f0", "f1", "f2"])
    assert [model.weights[f"f{i}"] for i in range(3)] == pytest.approx([2, -1, 0], abs=0.25)
    assert model.thresholds == pytest.approx((1, 3, 5), abs=0.4)
