import random

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import simhash as S


def brute(rows):
    """rows: (id, fp). id -> least id reachable at two bits or fewer."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin((rows[i][1] ^ rows[j][1]) & (2**64 - 1)).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprint_by_hand():
    assert S.simhash64(S.shingle_hashes("", 3)) == 0 == S.simhash64(S.shingle_hashes(None, 3))
    one = S.shingle_hashes("Two words", 3)
    assert len(one) == 1 and S.simhash64(one) == int(one[0])
    h = S.shingle_hashes("a B c\x0bd a b c", 3)
    assert len(h) == 5 and h[0] == h[4]
    want = sum(1 << b for b in range(64) if 2 * sum((int(x) >> b) & 1 for x in h) > len(h))
    assert S.simhash64(h) == want


def test_spark_hash_is_the_same(spark):
    got = spark.createDataFrame([("café un deux",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got == signed(int(S.shingle_hashes("café un deux", 3)[0]))


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for base in list(prints[:12]):
        for _ in range(6):
            x = base
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    centre = rng.getrandbits(64)  # a crowd around one value, and a chain
    prints += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)]
    x = rng.getrandbits(64)
    for i in range(20):
        prints.append(x)
        x ^= 3 << (3 * i)
    rng.shuffle(prints)
    rows = [(i * 7 % 1009, p) for i, p in enumerate(prints)]
    df = spark.createDataFrame([(i, signed(p)) for i, p in rows], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in S.cluster_prints(df).collect()}
    assert got == brute(rows)


def test_edges_of_input(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "y"), (4, "same words here now", "z"), (4, "same words here now", "z"), (None, "alone " * 5, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_clusters(df).collect()]
    assert len(got) == 6
    assert {g for g in got if g[0] in (1, 2, 3)} == {(i, "0" * 16, 1) for i in (1, 2, 3)}
    assert [g[2] for g in got if g[0] == 4] == [4, 4]
    assert [g[2] for g in got if g[0] is None] == [None]
    assert S.simhash_clusters(df.limit(0)).count() == 0


def test_text_fingerprints(spark):
    long = " ".join(f"w{i}" for i in range(70000))
    df = spark.createDataFrame([(1, long), (2, long + " "), (3, "A b C d"), (4, "a B c D")], "doc_id long, text string")
    got = {r.doc_id: r for r in S.simhash_clusters(df).collect()}
    assert got[2].component_id == 1 and got[4].component_id == 3
    assert int(got[1].fingerprint, 16) == S.simhash64(S.shingle_hashes(long, 3))
    assert np.uint64(int(got[3].fingerprint, 16)) == np.uint64(S.simhash64(S.shingle_hashes("a b c d", 3)))
