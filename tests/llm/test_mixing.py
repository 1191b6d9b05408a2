import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing as M


def corpus(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [(f"{s}{i}", s, " ".join(["w"] * rng.randint(1, 9)), i) for s, n in sizes.items() for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id string, source string, text string, epoch long")


def weights(tokens, a):
    total = sum(tokens.values())
    raised = {s: (t / total) ** a for s, t in tokens.items()}
    return {s: r / sum(raised.values()) for s, r in raised.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values()) / math.log(len(w))


def brute_exponent(tokens, target, most, budget):
    def repeats(w):
        b = budget or max(tokens[s] / w[s] for s in w)
        return max(w[s] * b / tokens[s] for s in w)

    grid = [i / 2000 for i in range(2001)]
    even = max([a for a in grid if entropy(weights(tokens, a)) >= target - 1e-9], default=0)
    rare = min([a for a in grid if repeats(weights(tokens, a)) <= most * (1 + 1e-9)], default=1)
    return max(even, rare)


@pytest.mark.parametrize("target,most,budget", [(0.9, 4, None), (0.99, 1.5, None), (0.95, 50, 3000), (0.99, 2.0, 3000)])
def test_exponent_and_budgets(spark, target, most, budget):
    rows, df = corpus(spark, {"a": 900, "b": 90, "c": 40, "d": 200})
    tokens = Counter()
    for _, s, t, _ in rows:
        tokens[s] += len(t.split())
    out, names = M.mix_sources(df, target_entropy=target, max_repeats=most, budget=budget)
    got = out.collect()
    a = brute_exponent(tokens, target, most, budget)
    w = weights(tokens, a)
    b = budget or max(tokens[s] / w[s] for s in w)
    given, times = Counter(), defaultdict(Counter)
    for r in got:
        given[r.source] += r[names["tokens"]]
        times[r.source][r.doc_id] += 1
    for s in tokens:
        want = w[s] * b
        assert want * 0.99 - 12 <= given[s] <= want * 1.01 + 1
        each = set(times[s].values()) | ({0} if len(times[s]) < sum(r[1] == s for r in rows) else set())
        assert max(each) - min(each) <= 1
    assert all(0 <= r[names["position"]] <= 1.01 for r in got)
    if budget is None:
        assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert len({(r.doc_id, r[names["epoch"]]) for r in got}) == len(got)


def test_odd_rows(spark):
    rows = [(1, None, "a b", 1), (1, None, "a b", 1), (None, "x", None, 2), (2, "y", "", 3), (3, "z", "w " * 30000, 4), (4, "z", "w", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_epoch long")
    out, names = M.mix_sources(df)
    assert names["epoch"] == "mix_epoch_" and out.columns[:4] == df.columns
    once = out.where(F.col(names["epoch"]) == 0)
    key = lambda r: tuple(str(x) for x in r)[:4]
    assert sorted(map(key, once.collect())) == sorted(map(key, rows))
    assert M.mix_sources(df.limit(0))[0].count() == 0


def test_same_result_twice(spark):
    _, df = corpus(spark, {"a": 300, "b": 20})
    one, two = (sorted(map(tuple, M.mix_sources(df.repartition(k), budget=900)[0].collect())) for k in (1, 7))
    assert one == two
