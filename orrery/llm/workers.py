"""What a Python worker holds between tasks.

Spark hands a worker from stage to stage, whatever ran in it before, and an
executor's workers share its memory with the JVM. So what a module keeps from
task to task goes when a task of another module begins, and freed memory goes
back to the system with the task, where allocators would hold it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

#: By module: what drops that which its tasks keep.
_forgets: dict[str, Callable[[], None]] = {}
#: glibc's; other libraries have no such function.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def keeps(module: str, forget: Callable[[], None]) -> None:
    """States that tasks of the module keep what forget() drops."""
    _forgets[module] = forget


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """The task, a generator, without what tasks of other modules keep and
    without freed memory at its begin and end."""

    @wraps(task)
    def run(*given, **named):
        for module, forget in _forgets.items():
            if module != task.__module__:
                forget()
        _give_back()
        yield from task(*given, **named)
        _give_back()

    return run
