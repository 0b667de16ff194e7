"""Calls of functions that may fail or hang, inside tasks."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

_clients: dict[str, Any] = {}


def client(name: str, connect: Callable[[], Any]) -> Any:
    """What `connect` gives, made once a worker for each name."""
    if name not in _clients:
        _clients[name] = connect()
    return _clients[name]


def timed(function: Callable[[Any], Any], items: list, seconds: float, at_once: int = 4) -> Iterator[tuple[Any, str | None]]:
    """(result, None) or (None, error) of each item, in order. `at_once` calls run at a time; one
    that takes longer than `seconds` is an error, and its thread is left behind."""
    done: queue.SimpleQueue = queue.SimpleQueue()

    def call(i: int) -> None:
        try:
            done.put((i, function(items[i]), None))
        except Exception as e:  # whatever the function raises is the item's error
            done.put((i, None, str(e) or type(e).__name__))

    out: list[tuple[Any, str | None] | None] = [None] * len(items)
    running: dict[int, float] = {}
    begun = 0
    while begun < len(items) or running:
        while begun < len(items) and len(running) < at_once:
            running[begun] = time.monotonic() + seconds
            threading.Thread(target=call, args=(begun,), daemon=True).start()
            begun += 1
        try:
            i, result, error = done.get(timeout=max(min(running.values()) - time.monotonic(), 0))
            if i in running:  # else it was given up before
                del running[i]
                out[i] = result, error
        except queue.Empty:
            now = time.monotonic()
            for i in [i for i, end in running.items() if end <= now]:
                del running[i]
                out[i] = None, f"timed out after {seconds:g} s"
    yield from out  # type: ignore[misc]
