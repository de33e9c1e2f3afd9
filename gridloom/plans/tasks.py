"""Dependent tasks: Spark jobs that run once their predecessors have."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock
from typing import Any


class TaskGraph:
    """launch() gives an id; a task starts when all tasks it names are done, at most `workers` at once."""

    def __init__(self, workers: int = 4):
        self._pool = ThreadPoolExecutor(workers)
        self._tasks: list[Future] = []

    def launch(self, procedure: Callable[..., Any], *args: Any, after: tuple[int, ...] = ()) -> int:
        own, left, lock = Future(), [len(set(after)) + 1], Lock()

        def run() -> None:
            try:
                for i in after:
                    self._tasks[i].result()
                own.set_result(procedure(*args))
            except BaseException as e:  # handed on to whoever waits
                own.set_exception(e)

        def one_less(_: Future | None = None) -> None:
            with lock:
                left[0] -= 1
                ready = left[0] == 0
            if ready:
                self._pool.submit(run)

        self._tasks.append(own)
        for i in set(after):
            self._tasks[i].add_done_callback(one_less)
        one_less()
        return len(self._tasks) - 1

    def wait(self) -> list[Any]:
        """Results of all tasks, in the order of their ids; the first failure is raised."""
        out = [f.result() for f in self._tasks]
        self._pool.shutdown()
        return out
