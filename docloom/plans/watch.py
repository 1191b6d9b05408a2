"""Polling a folder."""

from __future__ import annotations

import threading
from collections.abc import Callable

# Seconds between two looks, and the least.
EVERY, LEAST = 4.0, 0.5


class Watch:
    """Calls look() again and again in a thread of its own until it is stopped.

    With Engine.sync as look, the snapshot to compare with is the state stored beside the index: changes made while
    nothing watched are found as well.  An error of one look is kept in `errors` and does not end the watch."""

    def __init__(self, look: Callable[[], object], every: float = EVERY):
        self.look, self.every = look, max(LEAST, every)
        self.errors: list[str] = []
        self.looks = 0
        self._stop, self._seen = threading.Event(), threading.Condition()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> "Watch":
        self._thread.start()
        return self

    def _run(self) -> None:
        while not self._stop.is_set():
            try:
                self.look()
            except Exception as e:  # whatever a look raises, the next may go well
                self.errors.append(f"{type(e).__name__}: {e}")
            with self._seen:
                self.looks += 1
                self._seen.notify_all()
            self._stop.wait(self.every)

    def wait_looks(self, n: int, timeout: float) -> bool:
        """Wait until n looks are over in all; false if the time (seconds) runs out before."""
        with self._seen:
            return self._seen.wait_for(lambda: self.looks >= n, timeout)

    def stop(self, timeout: float = 5.0) -> None:
        self._stop.set()
        self._thread.join(timeout)
