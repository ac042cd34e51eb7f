"""What a worker process keeps from task to task: one large thing of a kind at a time.

Workers are used again by stage after stage, so a table that stays behind counts
against the memory of all later ones.  Holding a thing lets go of the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[str, tuple[Hashable, Any]] = {}


def resident(kind: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """The thing of this kind called ``key``, made if another one (or none) is held.

    ``kind`` is ``table`` for all that is large: a worker holds one of these.
    """
    if kind not in _held or _held[kind][0] != key:
        release(kind)
        _held[kind] = (key, make())
    return _held[kind][1]


def release(kind: str = "table") -> None:
    """Let go of what is held of a kind."""
    _held.pop(kind, None)
    pa.default_memory_pool().release_unused()
