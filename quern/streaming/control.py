"""Control of the indexing worker: a bounded queue of projects and the verbs of its interface."""

from __future__ import annotations

import queue
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery

from quern.sources.records import Registry


class Worker:
    """Runs projects one after the other; at most ``capacity`` wait, further triggers are refused."""

    def __init__(self, registry: Registry, run: Callable[[str], dict], capacity: int = 100):
        self.registry, self.run = registry, run
        self.waiting: queue.Queue[str] = queue.Queue(capacity)
        self.query: StreamingQuery | None = None
        self.done = 0

    def trigger(self, project: str) -> bool:
        """Queue a project; False if it waits already or the queue is full."""
        if project in self.waiting.queue:
            return False
        try:
            self.waiting.put_nowait(project)
        except queue.Full:
            return False
        return True

    def drain(self) -> int:
        """Run everything that waits and stamp the registry; a failing project does not stop the others."""
        n = 0
        while not self.waiting.empty():
            project = self.waiting.get_nowait()
            try:
                stats = self.run(project)
                self.registry.update(project, stats, int(time.time()))
            except Exception as error:  # reported, and retried by the next event
                self.registry.update(project, {"last_error": str(error)})
            n += 1
        self.done += n
        return n

    def batch(self, df, batch_id: int) -> None:
        """A foreachBatch function: queue the due projects of a micro-batch and run them."""
        for row in df.select("project").distinct().toLocalIterator():
            self.trigger(str(row["project"]))
        self.drain()

    def handle(self, command: str, project: str | None = None) -> dict:
        """status, stop, reindex, add and remove."""
        if command == "status":
            return {"ok": True, "waiting": self.waiting.qsize(), "done": self.done, "projects": len(self.registry.projects), "stream": self.query.status if self.query else None}
        if command == "stop":
            if self.query:
                self.query.stop()
            return {"ok": True}
        if command in ("reindex", "add", "remove") and not project:
            return {"ok": False, "error": "project is required"}
        if command == "reindex":
            return {"ok": self.trigger(project)}
        if command == "add":
            self.registry.add(project)
            return {"ok": True}
        if command == "remove":
            try:
                self.registry.remove(project)
            except KeyError:
                return {"ok": False, "error": "unknown project"}
            return {"ok": True}
        return {"ok": False, "error": f"unknown command {command!r}"}
