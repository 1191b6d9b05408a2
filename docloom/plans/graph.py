"""One question from its plan to its answer: the steps of a turn and what leads from one to the next.

chat and workspace questions are answered without the index; a follow-up is first made to stand by itself.  Then
rows are retrieved (tables and sections that the question names are locked in first), graded, once rewritten and
retrieved again if nothing holds, and answered from their sections; what still finds nothing goes to the external
search if there is one and it is allowed, else to a fixed reply.  Only bounded rows come to the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import context, search

from . import turn

# Prompts of the steps; __NAME__ is filled in.
CHAT = "Reply briefly; no documents are at hand.\n\n__HISTORY__\n\nUser: __QUESTION__"
WORKSPACE = "Answer about the folder __ROOT__ with these __COUNT__ files:\n__FILES__\n\nQuestion: __QUESTION__"
ANSWER = "Answer from the sources only and cite them by number.\n\n__CONTEXT__\n\nQuestion: __QUESTION__"
SECTIONS = 'Which sections of "__TITLE__" does the question ask for? JSON: {"found": bool, "section_ids": [...]}\n\n__OUTLINE__\n\nQuestion: __QUESTION__'
GRADE = 'Which passages help to answer the question? JSON: {"relevant_indices": [...]}\n\n__PASSAGES__\n\nQuestion: __QUESTION__'
REWRITE = "Put this question for a search of documents in other words, the question alone.\n\n__QUESTION__"
TABLES = 'Which tables must be read whole? JSON: {"table_ids": [...]}\n\n__TABLES__\n\n__CONTEXT__\n\nQuestion: __QUESTION__'
NO_CONTEXT = (
    "All documents are switched off: nothing of them was read. Use the notes, the names of the files, the conversation and general"
    " knowledge; never claim to have read a file, never restore one from the conversation.\n\nFiles (__COUNT__):\n__FILES__\n\n"
    "Notes:\n__NOTES__\n\n__HISTORY__\n\nUser: __QUESTION__"
)
UNSUPPORTED = "I could not find strong enough support in the knowledge base."
PASSAGE_CHARS, TOOL_CHARS = 800, 6000


@dataclass
class Turn:
    """What is known so far in a turn; `steps` names those taken."""

    question: str
    root: str
    plan: turn.TurnPlan
    history: str = ""
    standalone: str = ""
    locks: dict[str, list[str]] = field(default_factory=dict)
    locked_ids: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    external: dict = field(default_factory=dict)
    context: str = ""
    answer: str | None = None
    sources: list[dict] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)

    @property
    def asked(self) -> str:
        return self.standalone or self.question


class Graph:
    """Runs turns over an engine.

    model answers prompts; utility (default: model) does the small tasks; external takes a question and gives
    {"answer", "sources"} or None; trace is called with the name of each step and the turn.  Without a model
    every step takes what needs none: all rows are relevant, no section is resolved, the answer is None."""

    def __init__(
        self, engine, model: turn.Model | None = None, utility: turn.Model | None = None, external: Callable[[str], dict | None] | None = None,
        top_k: int = 8, trace: Callable[[str, Turn], None] | None = None,
    ):
        self.engine, self.model, self.utility, self.external, self.top_k = engine, model, utility or model, external, top_k
        self.trace = trace or (lambda step, t: None)

    def run(self, t: Turn, allow_external: bool = False, notes: list[str] | None = None) -> Turn:
        if t.plan.no_context:
            return self._reply(t, "no_context", NO_CONTEXT, notes="\n\n".join(n for n in notes or [] if n.strip()), **self._files(t))
        if t.plan.intent == "chat":
            return self._reply(t, "chat", CHAT)
        if t.plan.intent == "workspace":
            return self._reply(t, "workspace", WORKSPACE, **self._files(t))
        if t.plan.intent == "followup" and self.utility:
            t.standalone = turn.condense(t.question, t.history, self.utility)
            self._step(t, "condense")
        rewrites = 0
        while True:
            self.retrieve(t)
            good = self.grade(t)
            then = turn.after_grading(good, rewrites if self.utility else 1, allow_external and self.external is not None)
            if then != "rewrite":
                break
            t.standalone = self._ask(REWRITE, t).strip() or t.asked
            rewrites += 1
            self._step(t, "rewrite")
        if then == "external":
            t.external = self.external(t.asked) or {}
            self._step(t, "external_search")
            then = "answer_with_fallback" if t.external.get("answer") or t.external.get("sources") else "fallback"
        if then == "fallback":
            t.answer = f"{UNSUPPORTED} {t.external.get('reason') or 'Insufficient retrieved context.'}"
            return self._step(t, "fallback")
        self.assemble(t)
        if t.external:
            parts = (("Internal knowledge base context:\n", t.context), ("External web context:\n", t.external.get("answer") or ""))
            t.context = "\n\n".join(title + words for title, words in parts if words)
            t.sources += [dict(s, doc_type="external_search") for s in _first_by(t.external.get("sources") or [], "url")]
        t.answer = self.model(turn.fill(ANSWER, context=t.context, question=t.asked)) if self.model else None
        return self._step(t, then)

    def _step(self, t: Turn, name: str) -> Turn:
        t.steps.append(name)
        self.trace(name, t)
        return t

    def _ask(self, prompt: str, t: Turn, **values: str) -> str:
        """The small model's answer, empty if it fails."""
        try:
            return self.utility(turn.fill(prompt, **values, question=t.asked)) or ""
        except Exception:  # a model may fail in any way; the turn goes on
            return ""

    def _reply(self, t: Turn, name: str, prompt: str, **values: str) -> Turn:
        t.answer = self.model(turn.fill(prompt, root=t.root, history=t.history, **values, question=t.question)) if self.model else None
        return self._step(t, name)

    def _files(self, t: Turn) -> dict[str, str]:
        names = [r["path"] for r in self.engine.sources(t.root).select("path").orderBy("path").limit(300).collect()]
        return {"files": "\n".join(f"- {n}" for n in names), "count": str(self.engine.sources(t.root).count())}

    def _section_ids(self, t: Turn, path: str, query: str) -> list[str]:
        sections = self.engine.outline(t.root, path).select("section_id", "number", "title", "depth").orderBy("ord").collect()
        if not self.utility or not sections or not turn.asks_for_section(query, [(s["number"], s["title"]) for s in sections]):
            return []
        lines = "\n".join(f"{'  ' * (s['depth'] - 1)}{s['section_id']}: {s['number']} {s['title']}" for s in sections)
        try:
            answer = self.utility(turn.fill(SECTIONS, title=path, outline=lines, question=query)) or ""
        except Exception:  # as in _ask
            return []
        return turn.parse_section_ids(answer, {s["section_id"]: s["title"] for s in sections})

    def retrieve(self, t: Turn) -> None:
        """Rows of a turn, CAP at most: tables named, sections resolved (both locked), then hits of the search."""
        engine, paths = self.engine, t.plan.paths
        rows: list[dict] = []
        locked: set[str] = set()
        t.locks = {}

        def take(found, most: int) -> int:
            new = _first_by([r for r in found if r["chunk_id"] not in locked], "chunk_id")[: max(0, min(most, context.CAP - len(rows)))]
            locked.update(r["chunk_id"] for r in new)
            rows.extend(new)
            return len(new)

        numbers = engine.spark.range(1).select(X.table_references(F.lit(t.asked)).alias("n")).first()["n"]
        if numbers:
            take(_rows(search.table_scan(engine.chunks, numbers, t.root, paths)), context.CAP)
        focus = list(paths or [])[: turn.FOCUS]
        queries = turn.section_queries(t.asked, turn.section_references(t.asked), t.plan.queries, focus, turn.names_document) if focus else []
        if focus:
            cap = max(context.CAP - self.top_k, context.CAP_LEAST) if len(paths) > turn.FOCUS else context.CAP
            most = max(context.PER_DOC_LEAST, cap // len(focus))
            for path, query in zip(focus, queries):
                ids = self._section_ids(t, path, query) if query else []
                found = _rows(search.section_scan(engine.chunks, t.root, path, ids, cap)) if ids else []
                if found:
                    t.locks[path] = ids
                    take(found, most)
        t.locked_ids = sorted(locked)
        rest = [p for p in paths if p not in t.locks] if paths else None
        if rest != [] and len(rows) < context.CAP:
            many = len(t.plan.queries) > 1
            asked = t.plan.queries if many else [t.asked]
            hits = [r for q in asked for r in _rows(engine.search(q, t.root, rest, self.top_k).orderBy("rank"))]
            hits = _first_by([r for r in hits if r["chunk_id"] not in locked], "chunk_id")
            rows += hits[: self.top_k * len(asked)][: context.CAP - len(rows)]
        t.rows = rows
        self._step(t, "retrieve")

    def grade(self, t: Turn) -> bool:
        """Keeps the rows that help; locked rows are not asked about, nor any if the best row is near enough."""
        locked = [r for r in t.rows if r["chunk_id"] in set(t.locked_ids)]
        others = [r for r in t.rows if r["chunk_id"] not in set(t.locked_ids)]
        best = max((r.get("semantic_score") or r.get("score") or 0.0 for r in others), default=0.0)
        if others and best < context.GRADE_AT and self.utility:
            passages = "\n\n".join(f"[{i}] {(r['text'] or '')[:PASSAGE_CHARS]}" for i, r in enumerate(others))
            others = [others[i] for i in turn.parse_grades(self._ask(GRADE, t, passages=passages), len(others))]
        t.rows = locked + others
        self._step(t, "grade")
        return bool(t.rows)

    def assemble(self, t: Turn) -> None:
        """Sources and prompt text of the rows: their sections, tables and pictures whole, tables asked for besides."""
        engine = self.engine
        if not t.rows:
            return
        hits = engine.spark.createDataFrame(
            [(r["chunk_id"], i, r["root"], r["path"], r["section_id"]) for i, r in enumerate(t.rows)], "chunk_id string, rank int, root string, path string, section_id string"
        )
        chunks = engine.chunks.where(search.in_scope(t.root, list({r["path"] for r in t.rows})))
        scores = {r["chunk_id"]: (r.get("score"), r.get("semantic_score")) for r in t.rows}
        wide = context.expand(hits, chunks).select("ord", "chunk_id").join(chunks, "chunk_id")
        wide = context.hydrate_images(context.hydrate_tables(wide, engine.tables(t.root)), engine.images(t.root))
        t.sources = [r | dict(zip(("score", "semantic_score"), scores.get(r["chunk_id"], (0.0, 0.0)))) for r in _rows(wide.orderBy("ord"))]
        t.context = self._text(t.sources)
        t.sources += self._tool_tables(t)
        t.context = self._text(t.sources)

    def _text(self, sources: list[dict]) -> str:
        schema = "n int, title string, url string, section_heading string, section_title_clean string, section_titles array<string>, score double, text string"
        rows = [(i, *(s.get(k) for k in ("title", "url", "section_heading", "section_title_clean", "section_titles", "score", "text"))) for i, s in enumerate(sources)]
        blocks = context.format_context(self.engine.spark.createDataFrame(rows, schema).withColumnRenamed("n", "rank"))
        return "\n\n".join(r["block"] for r in blocks.orderBy("n").collect())

    def _tool_tables(self, t: Turn) -> list[dict]:
        """Tables the small model asks for, of those of the documents at hand, that are not among the sources."""
        numbers = self.engine.spark.range(1).select(X.table_references(F.lit(t.asked)).alias("n")).first()["n"]
        if not self.utility or not numbers and all(s.get("chunk_type") != "table_stub" for s in t.sources):
            return []
        paths = t.plan.paths or list({s["path"] for s in t.sources})
        known = self.engine.tables(t.root).where(F.col("path").isin(paths))
        listed = known.select("table_id", "caption", "row_count").orderBy("table_id").limit(100).collect()
        if not listed:
            return []
        lines = "\n".join(f"{r['table_id']}: {r['caption']} ({r['row_count']} rows)" for r in listed)
        chosen = turn.choose_tables(self._ask(TABLES, t, tables=lines, context=t.context[:TOOL_CHARS]), [r["table_id"] for r in listed])
        missing = [c for c in chosen if c not in {s.get("asset_id") for s in t.sources}]
        if not missing:
            return []
        stubs = self.engine.chunks.where(search.in_scope(t.root) & F.col("asset_id").isin(missing))
        full = _rows(context.hydrate_tables(stubs, known))
        return sorted((r | {"score": 1.0} for r in full), key=lambda r: missing.index(r["asset_id"]))


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _first_by(rows: list[dict], key: str) -> list[dict]:
    """Each key once, at its first place; rows without a key all stay."""
    seen: set = set()
    return [r for r in rows if r.get(key) is None or not (r[key] in seen or seen.add(r[key]))]
