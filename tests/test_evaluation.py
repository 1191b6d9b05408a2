from docloom.plans.engine import Engine
from docloom.plans.evaluation import Evaluation
from docloom.plans.watch import Watch
from docloom.sources.embedders import HashedWords

QUESTION = "id string, question string, category string, difficulty string, url string, section_heading string, chunk_ids array<string>"


def test_report_keeps_hits(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# Pumps\n\npumps move water\n\n# Valves\n\nvalves stop steam")
    engine = Engine(spark, str(tmp_path / "home"), HashedWords(64))
    engine.sync(str(folder))
    asked, ticks = [], iter(range(100))

    def counting(e, question, root, k):
        asked.append((question, k))
        return e.search(question, root, k=k)

    evaluation = Evaluation(engine, str(folder), {"counted": counting}, lambda: next(ticks))
    rows = [("q1", "valves steam", "fact", "easy", "a.md", "Valves", ["old"]), ("q2", "pumps water", "fact", "hard", "gone.md", "None", ["lost"])]
    questions = spark.createDataFrame(rows, QUESTION)
    report = evaluation.report(questions, cuts=(1, 2))
    result = report["results"]["counted"]
    assert report["cuts"] == [1, 2] and report["questions"] == 2 and len(asked) == 2 and result["latency_ms"] == 1000.0
    found = {(r["query_id"], r["k"]): (r["hit"], r["mrr"]) for r in result["per_question"]}
    assert found == {("q1", 1): (1.0, 1.0), ("q1", 2): (1.0, 1.0), ("q2", 1): (0.0, 0.0), ("q2", 2): (0.0, 0.0)}
    assert {(r["k"], r["part"], r["value"]): r["hit"] for r in result["summary"] if r["k"] == 1} == {(1, "all", ""): 0.5, (1, "category", "fact"): 0.5, (1, "difficulty", "easy"): 1.0, (1, "difficulty", "hard"): 0.0}

    again = evaluation.report(questions, cuts=(1,))["results"]["counted"]
    assert len(asked) == 2 and again["latency_ms"] == 0.0 and again["per_question"][0]["latency_ms"] is None
    evaluation.report(questions, cuts=(1,), use_kept=False)
    assert len(asked) == 4
    (folder / "b.md").write_text("# More\n\nmore steam")
    engine.sync(str(folder))
    evaluation.report(questions, cuts=(1,))
    assert len(asked) == 6


def test_watch():
    seen = []

    def look():
        seen.append(1)
        if len(seen) == 1:
            raise OSError("away")

    watch = Watch(look, 0.0)
    assert watch.every == 0.5
    watch.start()
    assert watch.wait_looks(2, 20)
    watch.stop()
    assert watch.errors == ["OSError: away"] and not watch._thread.is_alive()
    assert not watch.wait_looks(10**6, 0.01)


def test_engine_watch(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    engine = Engine(spark, str(tmp_path / "home"))
    watch = engine.watch(str(folder), 0.5)
    assert watch.wait_looks(1, 60)
    (folder / "b.md").write_text("two")
    assert watch.wait_looks(watch.looks + 2, 90)
    watch.stop(30)
    assert not watch.errors and {r.path for r in engine.state.collect()} == {"a.md", "b.md"}
