"""What the engine remembers between runs: scope, recent folders, selection, conversations.

One JSON file, replaced as a whole; every change is read, made and written under a lock."""

from __future__ import annotations

import json
import os
import tempfile
import threading
import time
from collections.abc import Callable

from .turn import distinct

RECENT, MESSAGES, CONVERSATIONS, PRIMARY = 8, 20, 20, 3
DEFAULT = "default"


def new_conversation() -> dict:
    return {"messages": [], "active_docs": [], "primary_docs": [], "last_used_docs": [], "updated_at": 0.0}


class AppState:
    def __init__(self, path: str, clock: Callable[[], float] = time.time):
        self.path, self.clock, self.lock = path, clock, threading.RLock()

    def load(self) -> dict:
        """The state; unreadable or missing: an empty one.  A state of a single conversation becomes the default one."""
        try:
            with open(self.path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            found = {}
        found = found if isinstance(found, dict) else {}
        state = {"scope": found.get("scope"), "recent": distinct(found.get("recent") or []), "excluded_docs": distinct(found.get("excluded_docs") or [])}
        talks = {k: new_conversation() | v for k, v in (found.get("conversations") or {}).items() if isinstance(v, dict)}
        if not talks and found.get("messages"):
            talks[DEFAULT] = new_conversation() | {"messages": found["messages"]}
        return state | {"conversations": talks}

    def change(self, edit: Callable[[dict], None], keep: tuple[str, ...] = ()) -> dict:
        with self.lock:
            state = self.load()
            edit(state)
            talks = state["conversations"]
            order = sorted(talks, key=lambda k: (k not in (*keep, DEFAULT), -talks[k]["updated_at"], k))
            state["conversations"] = {k: talks[k] for k in order[: max(CONVERSATIONS, len(keep))]}
            folder = os.path.dirname(self.path) or "."
            os.makedirs(folder, exist_ok=True)
            handle, name = tempfile.mkstemp(dir=folder)
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                json.dump(state, f, ensure_ascii=False)
            os.replace(name, self.path)
            return state

    def set_scope(self, scope: str) -> dict:
        """Another folder starts without selection and conversations."""

        def edit(state):
            if scope != state["scope"]:
                state.update(scope=scope, excluded_docs=[], conversations={})
            state["recent"] = [scope, *(r for r in state["recent"] if r != scope)][:RECENT]

        return self.change(edit)

    def append_turn(self, conversation: str, question: str, answer: str, used: list[str], target: list[str]) -> dict:
        """Both messages and the documents of the answer in one write."""

        def edit(state):
            talk = state["conversations"].setdefault(conversation, new_conversation())
            talk["messages"] = [*talk["messages"], {"role": "user", "content": question}, {"role": "assistant", "content": answer}][-MESSAGES:]
            talk["last_used_docs"] = distinct(used)
            talk["primary_docs"] = distinct(used)[:PRIMARY] or distinct(target)
            talk["updated_at"] = self.clock()

        return self.change(edit, (conversation,))

    def set_excluded(self, paths: list[str]) -> dict:
        return self.change(lambda state: state.update(excluded_docs=distinct(paths)))

    def set_active(self, conversation: str, paths: list[str]) -> dict:
        return self.change(lambda s: s["conversations"].setdefault(conversation, new_conversation()).update(active_docs=distinct(paths)), (conversation,))

    def clear(self, conversation: str) -> dict:
        return self.change(lambda s: s["conversations"].update({conversation: new_conversation()}), (conversation,))

    def conversations(self) -> list[dict]:
        talks = self.load()["conversations"]
        return [{"id": k, "messages": len(talks[k]["messages"]), "updated_at": talks[k]["updated_at"]} for k in sorted(talks, key=lambda k: -talks[k]["updated_at"])]
