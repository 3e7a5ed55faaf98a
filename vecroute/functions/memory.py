"""Memory of Python workers, which stay on and are reused."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa


def give_back() -> None:
    """Return to the system what a task has freed."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)
