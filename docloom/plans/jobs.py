"""Background work of the driver: jobs by id, and one writer at a time."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

#: Held while the index is written; the thread that holds it may take it again.
WRITER = threading.RLock()


class Jobs:
    def __init__(self, spark: SparkSession, workers: int = 4):
        self.spark, self.pool = spark, ThreadPoolExecutor(workers)
        self.jobs: dict[str, dict] = {}
        self.lock = threading.Lock()

    def submit(self, name: str, work: Callable[[], object], once: bool = False) -> str:
        """Id of the started job; with once, that of the job of this name if it still runs."""
        with self.lock:
            if once:
                for key, job in self.jobs.items():
                    if job["name"] == name and job["status"] in ("queued", "running"):
                        return key
            key = uuid.uuid4().hex
            self.jobs[key] = {"id": key, "name": name, "status": "queued", "created": time.time(), "finished": None, "result": None, "error": None}
        self.pool.submit(self._run, key, work)
        return key

    def _run(self, key: str, work: Callable[[], object]) -> None:
        job = self.jobs[key]
        job["status"] = "running"
        self.spark.sparkContext.setJobGroup(key, job["name"])
        try:
            job["result"] = work()
            job["status"] = "done"
        except Exception as e:  # whatever a job raises is its result
            job["error"], job["status"] = f"{type(e).__name__}: {e}", "failed"
        job["finished"] = time.time()

    def wait_idle(self, timeout: float | None = None) -> bool:
        """Wait until no job is queued or running; false if the time (seconds) runs out before."""
        end = None if timeout is None else time.monotonic() + timeout
        while any(job["finished"] is None for job in list(self.jobs.values())):
            if end is not None and time.monotonic() >= end:
                return False
            time.sleep(0.02)
        return True

    def get(self, key: str) -> dict | None:
        return self.jobs.get(key)

    def list(self) -> list[dict]:
        return sorted(self.jobs.values(), key=lambda j: j["created"], reverse=True)
