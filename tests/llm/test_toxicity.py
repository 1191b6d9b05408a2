import itertools
import random

import numpy as np
import pytest

from docloom.llm import toxicity as T

BAD = ["grumph", "zortle", "blarg"]
GOOD = [f"{a}{b}{c}" for a in ("ma", "li", "so", "te", "ru") for b in ("na", "po", "ki", "du") for c in ("ra", "mo", "n", "st")]


def document(rng, toxic, n=60):
    words = [rng.choice(GOOD) for _ in range(n)]
    for _ in range(3 if toxic else 0):
        words[rng.randrange(n)] = rng.choice(BAD) + rng.choice(["", "s", "er"])
    return " ".join(words)


def brute(emission, move, start):
    n, total, one = len(emission), 0.0, np.zeros(len(emission))
    for tags in itertools.product((0, 1), repeat=n):
        w = start[tags[0]]
        for t in range(n):
            w *= emission[t] if tags[t] else 1.0
            w *= move[tags[t - 1], tags[t]] if t else 1.0
        total += w
        one += w * np.array(tags)
    return one / total


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    move, start = np.array([[1.0, 0.2], [0.4, 0.7]]), np.array([0.8, 0.3])
    sizes = [1, 4, 7, 2, 9, 1, 5, 8, 8, 8, 8, 6]
    chains = [rng.uniform(0.05, 6, n) for n in sizes]
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes])[:-1]] = True
    got = T.marginals(np.concatenate(chains), first, move, start)[0]
    assert np.allclose(got, np.concatenate([brute(c, move, start) for c in chains]))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    y = [int(i % 4 == 0) for i in range(400)]
    return T.train([document(rng, v) for v in y], y)


def test_held_out_accuracy(model):
    rng = random.Random(2)
    y = np.array([int(i % 5 == 0) for i in range(300)])
    chances = model.tag([T.words_of(document(rng, v)) for v in y])
    assert np.mean((model.score(chances) >= 0.7) == y) > 0.98


def test_spans_and_odd_rows(spark, model):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (3, "İ mana grumph mana", 1), (None, "so " * 30000 + "zortle blarg", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity int")
    got = T.score_documents(df, model).collect()
    assert len(got) == 5
    by = {(r.doc_id): r for r in got}
    assert by[1].toxicity == by[2].toxicity < 0.5 and by[1].toxic_spans == []
    assert [(s.start, s.end) for s in by[3].toxic_spans] == [(7, 13)]
    assert by[None].toxicity > 0.7 and by[None].toxic_spans[0].start == 90000
    assert T.score_documents(df.limit(0), model).count() == 0


def test_learning_leaves_the_held_out_fold_alone(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, document(rng, i % 4 == 0, 20)) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(90)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows = T.sample_labels(docs, labels, "toxic", 3, 1, 1000, 1000)
    import zlib

    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(90))
    assert len(T.sample_labels(docs, labels, "toxic", 3, 1, 4, 6)) == 10
    assert T.learn(docs, labels.limit(0)).score([np.empty(0)])[0] == pytest.approx(0.5)


def test_toxic_words_in_three_hundredths_of_toxic_documents(spark):
    rng = random.Random(9)
    stems = ["".join(rng.choice("bcdfghjkvwxz") for _ in range(8)) for _ in range(33)]
    y = [int(i % 3 == 0) for i in range(4200)]
    texts = [document(rng, 0, 20) + f" {rng.choice(stems)}" * v for v in y]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    model = T.learn(docs, labels)
    scores = model.score(model.tag([T.words_of(t) for t in texts]))
    assert np.mean(scores[np.array(y) == 1] >= 0.7) > 0.9
    assert np.mean(scores[np.array(y) == 0] < 0.7) > 0.99


def test_training_in_parts_is_training_at_once(monkeypatch):
    rng = random.Random(6)
    y = [int(i % 4 == 0) for i in range(200)]
    texts = [document(rng, v) for v in y]
    whole = T.train(texts, y)
    monkeypatch.setattr(T, "TRAIN_AT_ONCE", 500)
    parts = T.train(texts, y)
    assert np.allclose(whole.move, parts.move, rtol=1e-3, atol=1e-6)
    assert np.allclose(whole.score(whole.tag([T.words_of(t) for t in texts])), parts.score(parts.tag([T.words_of(t) for t in texts])), atol=1e-2)
