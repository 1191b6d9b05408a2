import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docloom.llm import fingerprints as P
from docloom.llm.common import BATCH_BYTES


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def brute(counts, samples=P.SAMPLES):
    """One term and one sample at a time, in double precision."""
    terms = list(counts)
    one, r, b = (x.astype(float) for x in P.draws(P.term_hashes(terms), samples))
    codes = []
    for k in range(samples):
        best = None
        for i, t in enumerate(terms):
            level = np.floor(np.log(counts[t]) / r[i, k] + b[i, k])
            value = one[i, k] - r[i, k] * level
            if best is None or value < best[0]:
                best = (value, t, int(level))
        codes.append(best[1:])
    return codes


def test_collisions_follow_generalised_jaccard():
    rng = random.Random(1)
    sampler = P.Sampler()
    errors = []
    for z in range(200):  # other terms for each pair, so that errors are independent
        a = Counter({b"t%d %d" % (z, i): rng.randint(1, 6) for i in range(40)})
        b = Counter({t: (n if rng.random() < 0.6 else rng.randint(1, 9)) for t, n in a.items() if rng.random() < 0.8})
        b.update({b"u%d %d" % (z, i): 1 for i in range(rng.randint(0, 20))})
        errors.append(P.likeness(sampler.fingerprint(a), sampler.fingerprint(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_samples_match_brute_force():
    a = Counter({b"one": 1, b"two": 2, b"six": 6, b"many": 900, b"x": 1})
    b = Counter({b"one": 1, b"two": 3, b"six": 6, b"many": 500})
    s = P.Sampler()
    same = [x == y for x, y in zip(brute(a), brute(b))]
    got = (s.fingerprint(a) == s.fingerprint(b)).tolist()
    assert sum(x != y for x, y in zip(same, got)) <= 1


def test_table_and_long_texts():
    s = P.Sampler(16)
    many = Counter({b"w%d" % i: 1 + i % 3 for i in range(P.TABLE + 5000)})
    first = s.fingerprint(many)
    s.fingerprint(Counter(a=1) and Counter({b"a": 1}))
    assert (s.fingerprint(many) == first).all()


def test_next_and_edited(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice("alpha beta gamma délta 🙂 eps".split()) for _ in range(rng.randint(0, 30))) for i in rng.sample(range(1000), 150)}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, bucket string")
    got = {r.doc_id: r for r in P.fingerprint_documents(df).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    s = P.Sampler()
    for k, i in enumerate(order):
        following = texts[order[(k + 1) % len(order)]]
        half = len(texts[i]) // 2
        want = texts[i][: len(texts[i]) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        a, b, c = (s.fingerprint(P.counts_of(t)) for t in (texts[i], want, following))
        assert (r.fingerprint, r.edited_fingerprint) == (P.to_text(a), P.to_text(b))
        assert (r.near_edited, r.near_next) == (P.likeness(a, b), P.likeness(a, c))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "a b c d"), (1, "a b c d"), (None, "x y"), (None, ""), (2, "w " * 60000)], "doc_id long, text string")
    got = P.fingerprint_documents(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 3, 7, 7, 120000]
    assert {r.fingerprint for r in got if r.n_chars == 0} == {"0" * 512}
    assert P.fingerprint_documents(df.limit(0)).count() == 0
    alone = P.fingerprint_documents(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_ids_stay_longs(spark):
    big = 2**53
    ids = [big + 1, big, None, big + 2, -(2**63), 2**63 - 1, -1, 0, None]
    df = spark.createDataFrame([(i, f"text of {i} {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = P.fingerprint_documents(df).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i in ids if i is not None)
    order = sorted((i for i in ids if i is not None), reverse=True)
    text = {i: f"text of {i} {k}" for k, i in enumerate(ids)}
    by_id = {r.doc_id: r for r in got}
    for i, j in zip(order, order[1:]):
        assert by_id[i].edited_sha256 == hashlib.sha256(P.edited(text[i], text[j]).encode()).hexdigest()


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")  # other tests may have left a bound
    frame = type(spark.range(0))

    def sizes(frames):
        for f in frames:
            yield pd.DataFrame({"size": [int(f["text"].str.len().sum())]})

    monkeypatch.setattr(frame, "mapInPandas", lambda df, walk, schema, f=frame.mapInPandas: f(df, sizes, "size long"))
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 10_000).alias("text"))
    got = [r["size"] for r in P.fingerprint_documents(df).collect()]
    assert sum(got) >= 400 * 60_000 and max(got) <= BATCH_BYTES + 60_000


def test_buckets_by_halving(spark):
    rng = random.Random(3)
    ids = [-(2**63), -1, 0, 1, 2**53, 2**53 + 1, 2**63 - 1] + [rng.randrange(-50, 50) for _ in range(60)]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for n in (0, 1, 2, 7, 8, 40):
        cuts = np.unique(np.array([rng.choice(ids) for _ in range(n)], np.int64))
        got = [tuple(r) for r in df.select("id", P._count_below(cuts, F.col("id"))).collect()]
        assert got == [(i, int(np.searchsorted(cuts, i, "left"))) for i in ids]


def test_texts_pass_through_python_once(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    plan = P.fingerprint_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInPandas") == 1
