import random
from collections import defaultdict

from docloom.llm import sharding as S


def brute(rows, limit):
    """rows: (hash, bytes) -> depth by hash, splitting one shard at a time."""
    todo, out = [(0, rows)], {}
    while todo:
        depth, part = todo.pop()
        if sum(b for _, b in part) <= limit or len({h for h, _ in part}) == 1:
            out.update({h: depth for h, _ in part})
            continue
        sides = defaultdict(list)
        for h, b in part:
            sides[(h >> (S.BITS - depth - 1)) & 1].append((h, b))
        todo += [(depth + 1, side) for side in sides.values()]
    return out


def check(spark, rows, limit):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    hashed = [(r["hash"], r["bytes"]) for r in S.hashed_rows(df, "doc_id", "text").collect()]
    got = S.shard_rows(df, limit=limit).collect()
    assert len(got) == len(rows)
    want = brute(hashed, limit)
    assert sorted((r.shard, r.depth) for r in got) == sorted(
        (format(h, f"0{S.BITS}b")[: want[h]], want[h]) for h, _ in hashed
    )
    total = defaultdict(int)
    for r in got:
        total[r.shard] += r.bytes
    assert all(r.shard_bytes == total[r.shard] and r.oversized == (total[r.shard] > limit) for r in got)
    shards = sorted(total)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))
    return got


def test_splits_match_brute_force(spark):
    rng = random.Random(1)
    check(spark, [(i, "x" * rng.randint(0, 200), "s") for i in range(400)], 1500)


def test_single_shard(spark):
    assert {r.shard for r in check(spark, [(i, "abc", "s") for i in range(20)], 1000)} == {""}


def test_odd_rows(spark):
    rows = [(1, None, "s"), (None, "", "s"), (None, "a" * 50, "s"), (2, "b" * 5000, "s"), (3, "c" * 60, "s"), (3, "c" * 60, "s"), (3, "d" * 60, "s")]
    got = check(spark, rows, 100)
    assert {r.doc_id for r in got if r.oversized} == {2, 3}
    empty = spark.createDataFrame([], "doc_id long, text string, shard string")
    assert S.shard_rows(empty).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    plan = S.shard_rows(df, limit=100)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
