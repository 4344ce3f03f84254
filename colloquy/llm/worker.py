"""What a Python worker keeps between tasks: the tables of one operator at a time.

Spark reuses workers, also for other operators of the same session. What one of them has learned goes when another
begins, so that a session of several operators needs no more memory than the largest of them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

_HELD: dict[Hashable, object] = {}


def owned(name: Hashable, make: Callable[[], object]):
    """The worker's object of that name, made when first asked for; those of other names go."""
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed, unless told not to
            if trim:
                trim(0)
        _HELD[name] = make()
    return _HELD[name]
