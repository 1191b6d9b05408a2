import threading

from docloom.plans.app_state import AppState
from docloom.plans.jobs import Jobs


def test_jobs(spark):
    jobs = Jobs(spark)
    gate = threading.Event()
    first = jobs.submit("sync", lambda: gate.wait(10) and spark.range(5).count(), once=True)
    assert jobs.submit("sync", lambda: 0, once=True) == first
    gate.set()
    bad = jobs.submit("bad", lambda: 1 / 0)
    jobs.pool.shutdown(wait=True)
    assert jobs.get(first)["result"] == 5 and jobs.get(first)["status"] == "done"
    assert jobs.get(bad)["status"] == "failed" and "ZeroDivisionError" in jobs.get(bad)["error"]
    assert len(jobs.list()) == 2 and jobs.get("none") is None


def test_state_file(tmp_path):
    now = [0.0]
    state = AppState(str(tmp_path / "s.json"), lambda: now[0])
    assert state.load()["conversations"] == {} and state.conversations() == []
    for f in ("/a", "/b", "/a"):
        state.set_scope(f)
    assert state.load()["recent"] == ["/a", "/b"]
    for i in range(25):
        now[0] = float(i)
        state.append_turn(f"c{i}", "q", "a", ["d", "d", "e", "f", "g"], [])
    saved = state.load()["conversations"]
    assert len(saved) == 20 and "c24" in saved and "c0" not in saved
    assert saved["c24"]["primary_docs"] == ["d", "e", "f"] and state.conversations()[0]["id"] == "c24"
    for i in range(15):
        state.append_turn("c24", str(i), "a", [], ["t"])
    assert len(state.load()["conversations"]["c24"]["messages"]) == 20 and state.load()["conversations"]["c24"]["primary_docs"] == ["t"]
    state.set_excluded(["x", "", "x"])
    assert state.load()["excluded_docs"] == ["x"] and state.clear("c24")["conversations"]["c24"]["messages"] == []
    assert state.set_active("c24", ["y", "y"])["conversations"]["c24"]["active_docs"] == ["y"]
    assert state.set_scope("/new")["conversations"] == {}


def test_old_and_broken_state(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"scope": "/a", "messages": [{"role": "user", "content": "q"}]}')
    assert len(AppState(str(path)).load()["conversations"]["default"]["messages"]) == 1
    path.write_text("not json")
    assert AppState(str(path)).load()["scope"] is None
