import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vector
from docloom.operators import assets, cards, context, evaluate, search, sync
from docloom.plans import catalogue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_vectors(spark):
    pair = lambda a, b: one(spark, vector.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert pair([1.0, 0.0], [1.0, 1.0]) == pytest.approx(1 / math.sqrt(2)) and pair([0.0, 0.0], [1.0, 1.0]) is None


def test_bm25_matches_plain_python(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("red green blue tree sun moon".split()) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    df = spark.createDataFrame(docs, "id int, text string")
    asked = spark.createDataFrame([(1, "Red tree tree"), (2, "")], "query_id int, query string")
    got = {r.id: r.score for r in search.bm25(search.postings(df, "id", "text"), asked, 60, "id").collect()}
    for i, t in docs:
        words = t.split()
        want = 0.0
        for q in ("red", "tree"):
            n = sum(q in d.split() for _, d in docs)
            tf = words.count(q)
            want += math.log(1 + (60 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / 256))
        assert got.get(i, 0) == pytest.approx(want, abs=2e-6)


def test_bm25_topk_is_the_top_of_bm25(spark):
    rng = random.Random(2)
    docs = [(i % 50, " ".join(rng.choice("red green blue tree sun moon".split()) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "Tree-tree, RED")]
    df = spark.createDataFrame(docs, "id int, text string")
    asked = spark.createDataFrame([(1, "Red tree tree"), (2, ""), (3, "sun"), (4, "absent")], "query_id int, query string")
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = search.bm25_topk(df, asked, 7, "id", "text")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    want = search.top_per_query(search.bm25(search.postings(df, "id", "text"), asked, df.count(), "id"), 7, "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert search.bm25_topk(df, asked.where("query_id = 2"), 7, "id", "text").count() == 0


def test_hits_are_ranked_once(spark):
    """What follows the ranking neither ranks again nor cuts texts of files without a hit."""
    for name in ("small_to_big", "context_format"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and plan.count("LeftSemi") >= plan.count("Relation ["), name


def test_sizes_and_fusion(spark):
    assert search.fetch_sizes(5) == (15, 30) and search.fetch_sizes(8) == (24, 48) and search.fetch_sizes(1) == (11, 22)
    a = spark.createDataFrame([(1, "x", 1, 0.9), (1, "y", 2, 0.8)], "query_id int, id string, rank int, semantic_score double")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    refs = "Smith et al. 2019, doi 10.1, pp. 3. " * 20
    chunks = spark.createDataFrame([("x", "h", "t"), ("y", "7 References", "t"), ("z", "h", refs)], "id string, section_heading string, text string")
    got = search.hybrid(a, b, chunks, 3).orderBy("rank").collect()
    assert [(r.id, r.score, r.semantic_score) for r in got] == [("x", 0.5, 0.9), ("y", round((1 / 3 + 1 / 2) * 0.4, 6), 0.8), ("z", round(1 / 3 * 0.4, 6), 0.0)]


def test_references(spark):
    tables = lambda t: one(spark, X.table_references(F.lit(t)))
    assert tables("See Table 2, Bảng 3.1 and table A.1.") == ["2", "3.1", "A.1", "a.1"] and tables("the table shows") == []
    assert tables("Table 3a, Table2 and bang 4") == ["3a", "3A", "2", "4"] and tables("table of 3, stable 4") == []
    sections = lambda t: one(spark, X.section_references(F.lit(t)))
    assert sections("section 3.2 and chapter 4 of GPT-4, then 5.1") == ["3.2", "4", "5.1"]
    named = lambda q, p: one(spark, X.mentions_document(F.lit(q), F.lit(p)))
    assert named("what does my-file say", "a/My_File.pdf") and not named("what does it say", "a/file.md") and not named("x", "a/--.md")
    assert one(spark, X.stem(F.lit("a/b.c.md"))) == "b.c" and one(spark, X.stem(F.lit(".env"))) == ".env"
    assert one(spark, X.section_number(F.lit("2.1. Two"))) == "2.1" and one(spark, X.section_title(F.lit("Plain"))) == "Plain"
    assert one(spark, X.json_object(F.lit('so: {"a": {"b": 1}} end'))) == '{"a": {"b": 1}}'


def test_counting_within_rows(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))) for _ in range(50)] + [None, "", "A a. B-b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    index = search.postings(df, "id", "text")
    got = sorted((r.id, r.term, r.tf, r.length) for r in index.collect())
    want = []
    for i, t in enumerate(texts):
        words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        want += [(i, w, words.count(w), len(words)) for w in set(words)]
    assert got == sorted(want)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()


def test_results(spark):
    df = spark.createDataFrame([("c", 2, None)], "chunk_id string, section_level int, section_number string")
    row = search.results(df).first().asDict()
    assert len(row) == 34 and list(row) == list(search.RESULT)
    assert (row["section_level"], row["section_depth"], row["section_number"], row["breadcrumbs"], row["chunk_type"], row["text"]) == (2, 1, "", [], "text", None)


def test_scans(spark):
    rows = [("r", "p", i, f"c{i}", ["s1"] if i < 3 else ["s1", "s1.1"], "s1" if i < 3 else "s1.1", "table_stub" if i == 4 else "text", "2" if i == 4 else None) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "root string, path string, seq int, chunk_id string, section_ancestors array<string>, section_id string, chunk_type string, table_number string")
    seqs = lambda d: [r.seq for r in d.collect()]
    assert seqs(search.section_scan(df, "r", "p", ["s1", "s1"])) == [1, 2, 3, 4, 5] and seqs(search.section_scan(df, "r", "p", ["s1"], descendants=False)) == [1, 2]
    assert seqs(search.section_scan(df, "r", "p", [])) == [] and seqs(search.section_scan(df, "r", "p", ["s1.1"], limit=1)) == [3]
    assert seqs(search.table_scan(df, ["2"], "r")) == [4] and seqs(search.table_scan(df, ["2"], "other")) == []


def test_union_and_expansion(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "id string, n int")
    b = spark.createDataFrame([("y", 1), ("x", 2), (None, 3)], "id string, n int")
    assert [r.id for r in context.ordered_union([a, b], "id", "n").collect()] == ["x", None, "y", None]
    chunks = spark.createDataFrame([(f"c{i}", "r", "p", "s", i) for i in range(12)], "chunk_id string, root string, path string, section_id string, seq int")
    hit = lambda *ids: spark.createDataFrame([(c, i, "r", "p", "s") for i, c in enumerate(ids)], "chunk_id string, rank int, root string, path string, section_id string")
    wide = lambda *ids, **k: [r.chunk_id for r in context.expand(hit(*ids), chunks, **k).orderBy("ord").collect()]
    assert wide("c7", "c0") == ["c7", "c0", "c1", "c2", "c3"] and wide("c1", "c3") == ["c1", "c0", "c2", "c3", "c4"]
    assert wide("c7", "c9", "c7") == ["c7", "c0", "c1", "c2", "c3", "c9", "c4"] and wide("c7", "c9", limit=6) == ["c7", "c0", "c1", "c2", "c3", "c9"]
    alone = hit("c2").withColumn("section_id", F.lit(None).cast("string"))
    assert [r.chunk_id for r in context.expand(alone, chunks).collect()] == ["c2"] and context.expand(hit("c1").limit(0), chunks).count() == 0
    gate = lambda rows: context.grade_gate(spark.createDataFrame(rows, "semantic_score double, score double")).first()["skip"]
    assert gate([(0.0, 0.6)]) and gate([(0.7, 0.1)]) and not gate([(0.4, 0.9)]) and not gate([])


def test_budgets(spark):
    of = lambda n, rows: spark.createDataFrame([("r", f"p{d}", s, f"{d}:{s}") for d in range(n) for s in range(rows)], "root string, path string, seq int, chunk_id string")
    per = lambda n, rows, k: [sum(r.path == f"p{d}" for r in got) for got in [context.budgeted(of(n, rows), k).collect()] for d in range(n)]
    assert per(8, 9, 8) == [5, 5, 5, 0, 0, 0, 0, 0] and per(4, 30, 20) == [4, 4, 4, 0] and per(2, 30, 8) == [12, 12] and per(3, 3, 8) == [3, 3, 3] and per(1, 30, 8) == [24]


def test_hydration(spark):
    stubs = spark.createDataFrame([("t1", "table_stub", "S"), ("t2", "table_stub", "S"), ("t3", "text", "S")], "asset_id string, chunk_type string, text string")
    tables = spark.createDataFrame([("t1", [["a"], ["1"]]), ("t2", [])], "table_id string, rows array<array<string>>")
    got = {r.asset_id: r.text for r in context.hydrate_tables(stubs, tables).collect()}
    assert got["t1"].endswith("| 1 |") and got["t2"] == got["t3"] == "S"
    images = spark.createDataFrame([("i.png", 4, 3)], "image_path string, width int, height int")
    found = context.hydrate_images(spark.createDataFrame([("i.png",), ("j.png",)], "asset_path string"), images)
    assert {r.asset_path: r.width for r in found.collect()} == {"i.png": 4, "j.png": None}


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, chunk_id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "z"), ("e", "b")], "query_id string, chunk_id string")
    got = {(r.query_id, r.k): (r.hit, r.recall, r.precision, r.mrr) for r in evaluate.score_questions(hits, gold).collect()}
    assert got["q", 1] == (0, 0, 0, 0) and got["q", 10] == (1, 0.5, pytest.approx(1 / 3), 0.5) and got["e", 5] == (0, 0, 0, 0)


@pytest.mark.parametrize("answer", ['{"faithfulness": 5, "answer_relevance": 4, "citation_accuracy": 3}', '```json\n{"Faithfulness": {"score": 5, "why": "x"}, "answer relevance": {"score": 4}, "citation-accuracy": {"score": "3"}}\n```', '{"scores": {"faithfulness": 5, "answer_relevance": 4, "citation_accuracy": 3}}', "Faithfulness: 5\nAnswer relevance: 4\nCitation accuracy: 3"])
def test_judge_answers(answer):
    assert evaluate.parse_scores(answer) == {"faithfulness": 5, "answer_relevance": 4, "citation_accuracy": 3}


def test_judge_answer_without_a_score():
    for bad in ("", '{"faithfulness": 5}', '{"faithfulness": 9, "answer_relevance": 4, "citation_accuracy": 3}'):
        with pytest.raises(ValueError):
            evaluate.parse_scores(bad)


@pytest.mark.parametrize("change,want", [({}, None), ({"w": 64, "h": 64}, "too_small"), ({"w": 1000, "h": 120}, "thin"), ({"ink": 0.0}, "blank"), ({"px": 30.0, "py": 30.0}, "small_on_page"), ({"ix": 0.5, "iy": 0.5}, "small_on_page"), ({"w": 200, "h": 100, "n": 3}, "repeated"), ({"b": 10}, "tiny_file")])
def test_rejected_pictures(spark, change, want):
    v = {"b": 4096, "w": 400, "h": 300, "ink": 0.2, "px": None, "py": None, "ix": None, "iy": None, "n": 1} | change
    c = {k: F.lit(x).cast("double") for k, x in v.items()}
    assert one(spark, assets.reject_reason(c["b"], c["w"], c["h"], c["ink"], (c["px"], c["py"]), (c["ix"], c["iy"]), c["n"])) == want


def test_pixels(spark):
    df = spark.createDataFrame([("i", v) for v in [0] * 4 + [100] * 4 + [5] * 8], "k string, value int")
    row = assets.pixel_metrics(df, "k").first()
    assert (row.entropy, row.ink) == (1.5, 0.25)


def test_groups(spark):
    texts = ["a" * 3000, "b" * 3000, "c" * 7000, "d"]
    got = one(spark, cards.greedy_groups(F.array(*map(F.lit, texts))))
    assert [[len(t) for t in g] for g in got] == [[3000, 3000], [7000], [1]]
    calls = []
    assert cards.summarise(["x" * 20], lambda kind, t: calls.append(kind) or kind) == "single"
    cards.summarise(["x" * 8000, "y" * 8000], lambda kind, t: calls.append(kind) or kind)
    assert calls == ["single", "map", "map", "reduce"]


STATE = "root string, path string, size long, mtime_ns long, content_hash string, status string, index_version string"


def test_diff_and_state(spark):
    disk = spark.createDataFrame([("r", "new", 1, 1), ("r", "same", 1, 1), ("r", "touched", 1, 9), ("r", "bad", 1, 1), ("r", "old", 1, 1)], "root string, path string, size long, mtime_ns long")
    v = sync.INDEX_VERSION
    state = spark.createDataFrame([("r", "same", 1, 1, "h", "indexed", v), ("r", "touched", 1, 1, "h", "indexed", v), ("r", "bad", 1, 1, "h", "error", v), ("r", "old", 1, 1, "h", "indexed", "0"), ("r", "gone", 1, 1, "h", "indexed", v)], STATE)
    kinds = lambda df: {r.path: r.change for r in df.collect()}
    found = sync.diff(disk, state)
    assert kinds(found) == {"new": "added", "same": "unchanged", "touched": "modified", "bad": "modified", "old": "modified", "gone": "deleted"}
    hashes = disk.select("root", "path").withColumn("content_hash", F.lit("h"))
    sure = sync.confirm(found, hashes, state)
    assert kinds(sure)["touched"] == "touched" and kinds(sure)["bad"] == kinds(sure)["old"] == "modified"
    after = sync.next_state(state, disk, sure.withColumn("error", F.when(F.col("path") == "old", "broken")))
    rows = {r.path: r for r in after.collect()}
    assert set(rows) == {"new", "same", "touched", "bad", "old"} and rows["touched"].mtime_ns == 9
    assert (rows["old"].status, rows["old"].index_version) == ("error", "0") and rows["bad"].status == "indexed"
    again = kinds(sync.diff(disk, after))
    assert again["old"] == "modified" and {again[p] for p in ("new", "same", "touched", "bad")} == {"unchanged"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = sync.replace_by_key(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sync.replace_by_key(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sync.needs_pruning(500, 100) and not sync.needs_pruning(300, 100)
