"""Memory of what a Python worker has seen, for one operator at a time.

Spark reuses a worker for task after task. An operator's memory pays off in
its own tasks only, so the first task of another operator lets it go.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

_live: dict[str, Callable[[], None]] = {}


def claim(name: str, forget: Callable[[], None]) -> None:
    """From now on this worker remembers for the named operator; others forget."""
    for other in [o for o in _live if o != name]:
        _live.pop(other)()
    _live[name] = forget


def release() -> None:
    """Give what Arrow holds but does not use back to the machine, for the tasks of the JVM beside this worker."""
    pa.default_memory_pool().release_unused()
