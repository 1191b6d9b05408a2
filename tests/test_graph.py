"""Turns with scripted models: each way through the steps."""

import pytest

from docloom.operators import context
from docloom.plans import graph, turn
from docloom.plans.engine import Engine

ONE = "# 1 Intro\n\nalpha beta\n\n# 2 Data sources used\n\n## 2.1 Web\n\ngamma delta\n\n| k | v |\n|---|---|\n| x | 1 |\n\nTable 7: the numbers\n\n# 3 End\n\nomega"
TWO = "# 1 Start\n\nalpha only\n\n# 4 Method of the work\n\nkappa"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    (folder / "one.md").write_text(ONE)
    (folder / "two.md").write_text(TWO)
    e = Engine(spark, str(tmp_path_factory.mktemp("home")))
    e.sync(str(folder))
    e.root = str(folder)
    return e


class Script:
    """Answers by the first phrase a prompt holds; records the prompts."""

    def __init__(self, **answers):
        self.answers, self.prompts = answers, []

    def __call__(self, prompt):
        self.prompts.append(prompt)
        for phrase, answer in self.answers.items():
            if phrase.replace("_", " ") in prompt:
                if isinstance(answer, Exception):
                    raise answer
                return answer
        return ""


def run(engine, question, plan=None, model=None, utility=None, external=None, history="", **more):
    g = graph.Graph(engine, model or (lambda p: "said: " + p), utility, external, top_k=4)
    plan = plan or turn.TurnPlan(None, turn.GLOBAL, "question", [], [])
    return g.run(graph.Turn(question, engine.root, plan, history), **more)


def plan(paths=None, intent="question", queries=(), **k):
    return turn.TurnPlan(paths, turn.EXPLICIT if paths else turn.GLOBAL, intent, [], list(queries), **k)


def test_turns_without_the_index(engine):
    t = run(engine, "hello", plan(intent="chat"), history="User: hi")
    assert t.steps == ["chat"] and "User: hi" in t.answer and t.sources == [] and t.context == ""
    t = run(engine, "which files?", plan(intent="workspace"))
    assert t.steps == ["workspace"] and "- one.md\n- two.md" in t.answer and "these 2 files" in t.answer
    t = run(engine, "what now?", plan([], no_context=True), notes=["my note", " "])
    assert t.steps == ["no_context"] and "my note" in t.answer and "never claim to have read" in t.answer and "alpha beta" not in t.answer


def test_plain_question(engine):
    t = run(engine, "where is omega")
    assert t.steps == ["retrieve", "grade", "answer"] and "omega" in t.context and t.context.startswith("[Source 1]\nTitle: one\nURL: one.md\n")
    assert t.answer.startswith("said: ") and t.sources[0]["path"] == "one.md"


def test_follow_up_is_condensed(engine):
    u = Script(User_before='"where is kappa"')
    t = run(engine, "and there?", plan(intent="followup"), utility=u, history="User before: x")
    assert t.steps[0] == "condense" and t.asked == "where is kappa" and t.sources[0]["path"] == "two.md"


def test_sections_are_locked(engine):
    u = Script(Which_sections='{"found": true, "section_ids": ["s2"]}', Which_passages='{"relevant_indices": []}')
    t = run(engine, "what does section 2 say", plan(["one.md"]), utility=u)
    assert t.locks == {"one.md": ["s2"]} and len(t.locked_ids) == 3 and {r["section_id"] for r in t.rows} == {"s2.1"}
    assert "answer" == t.steps[-1] and not any("Which passages" in p for p in u.prompts)  # only locked rows: nothing to grade
    assert "| x | 1 |" in t.context


def test_sections_of_two_documents(engine):
    answers = iter(['{"section_ids": ["s3"]}', '{"section_ids": ["s4"]}'])
    t = run(engine, "compare section 3 with section 4", plan(["one.md", "two.md"]), utility=lambda p: next(answers) if "Which sections" in p else "")
    assert t.locks == {"one.md": ["s3"], "two.md": ["s4"]} and [r["path"] for r in t.rows] == ["one.md", "two.md"]
    t = run(engine, "compare section 1, section 2 and section 3", plan(["one.md", "two.md"]), utility=lambda p: "s1")
    assert t.locks == {}  # numbers that do not line up with the documents lock nothing


def test_tables_named_come_first(engine):
    t = run(engine, "what does table 7 hold about omega")
    assert t.rows[0]["chunk_type"] == "table_stub" and t.rows[0]["chunk_id"] in t.locked_ids and any(r["chunk_id"] not in t.locked_ids for r in t.rows)


def test_sub_queries_are_merged(engine):
    t = run(engine, "both", plan(["one.md", "two.md"], queries=["alpha", "alpha kappa"]))
    ids = [r["chunk_id"] for r in t.rows]
    assert len(ids) == len(set(ids)) and {r["path"] for r in t.rows} == {"one.md", "two.md"}


def test_grading_rewriting_and_fallback(engine, monkeypatch):
    monkeypatch.setattr(context, "GRADE_AT", 2.0)  # so that no row is near enough to go ungraded
    u = Script(Which_passages='{"relevant_indices": []}', in_other_words="where is omega")
    t = run(engine, "alpha?", utility=u)
    assert t.steps == ["retrieve", "grade", "rewrite", "retrieve", "grade", "fallback"] and t.answer.startswith(graph.UNSUPPORTED) and t.sources == []
    u = Script(Which_passages="unreadable")
    assert run(engine, "alpha?", utility=u).steps == ["retrieve", "grade", "answer"]
    u = Script(Which_passages=RuntimeError("down"))
    assert run(engine, "alpha?", utility=u).steps[-1] == "answer"


def test_external_search(engine, monkeypatch):
    monkeypatch.setattr(context, "GRADE_AT", 2.0)
    u = Script(Which_passages='{"relevant_indices": []}', in_other_words="nothing here")
    found = {"answer": "from outside", "sources": [{"url": "u", "title": "t"}, {"url": "u", "title": "again"}]}
    t = run(engine, "alpha?", utility=u, external=lambda q: found, allow_external=True)
    assert t.steps[-2:] == ["external_search", "answer_with_fallback"] and "from outside" in t.context and [s["url"] for s in t.sources] == ["u"]
    t = run(engine, "alpha?", utility=u, external=lambda q: {"reason": "closed"}, allow_external=True)
    assert t.steps[-1] == "fallback" and t.answer.endswith("closed")
    assert run(engine, "alpha?", utility=u, external=lambda q: found).steps[-1] == "fallback"


def test_tables_by_tool(engine):
    stub = engine.tables(engine.root).first()["table_id"]
    u = Script(Which_tables='{"table_ids": ["%s", "none"]}' % stub)
    t = run(engine, "see table 9 on omega", plan(["one.md"]), utility=u)
    assert [s["asset_id"] for s in t.sources].count(stub) == 1 and "| x | 1 |" in t.context


def test_engine_session(engine):
    got = engine.ask("where is kappa", engine.root)
    assert got["session"].last_used == ("two.md",) and got["answer"] is None and got["steps"][-1] == "answer"
    empty = engine.ask("x", engine.root, turn.Session(scope=engine.root, excluded=("one.md", "two.md")))
    assert empty["steps"] == ["no_context"] and empty["plan"].no_context
