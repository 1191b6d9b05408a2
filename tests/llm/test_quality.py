import random

import numpy as np

from docloom.llm import quality as Q

WORDS = [a + b + c for a in ("ma", "li", "so", "te") for b in ("na", "po", "ki") for c in ("ra", "mo", "n", "st")]


def good(rng, n=80):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def bad(rng, n=80):
    kind = rng.randrange(3)
    words = [rng.choice(WORDS) for _ in range(n)]
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w for w in words[: n // 8] for _ in range(8))
    return " ".join(w + "***" for w in words)


def fitted(n=600):
    rng = random.Random(1)
    y = [int(rng.random() < 0.6) for _ in range(n)]
    return Q.train([good(rng) if v else bad(rng) for v in y], y)


def test_held_out_accuracy():
    model, rng = fitted(), random.Random(2)
    y = np.array([int(rng.random() < 0.7) for _ in range(200)])
    scores = model.vote(model.project([good(rng) if v else bad(rng) for v in y]))
    assert np.mean((scores >= 0.3) == y) > 0.98
    assert scores.min() >= 0 and scores.max() <= 1


def test_votes_match_brute_force():
    model, rng = fitted(), random.Random(3)
    v = model.project([good(rng) for _ in range(300)] + [bad(rng) for _ in range(300)])
    got = model.vote(v)
    for i in range(0, 600, 37):
        like = [float(np.dot(v[i], w)) for w in model.vectors]
        best = sorted(range(len(like)), key=lambda k: -like[k])[: Q.K]
        w = [np.exp(Q.SHARPNESS * (like[k] - 1)) for k in best]
        assert abs(got[i] - sum(a * model.labels[k] for a, k in zip(w, best)) / sum(w)) < 1e-3


def test_frames(spark):
    model = fitted()
    rows = [(1, None, 0.1), (2, "", 0.2), (3, " .. ", 0.3), (4, "sonara " * 40000, 0.4), (4, "mana", 0.5), (None, "mana", 0.6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality double")
    got = Q.score_documents(df, model).collect()
    assert len(got) == 6 and all(0 <= r.quality <= 1 for r in got)
    assert {r.quality for r in got if r.doc_id in (1, 2)} == {model.base}
    assert Q.score_documents(df.limit(0), model).count() == 0
    empty = Q.train([], [])
    assert {r.quality for r in Q.score_documents(df, empty).collect()} == {0.5}
    assert Q.train(["", ""], [0, 1]).vote(np.zeros((2, 2), np.float32)).tolist() == [0.5, 0.5]
