"""Memory of Python workers: each keeps what one operator has learned, and gives back what it has freed."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from contextlib import suppress
from typing import Any

import pyarrow as pa

_KEPT: dict[str, Any] = {}


def kept(key: str, build: Callable[[], Any]) -> Any:
    """What ``build`` returned when this worker first asked for ``key``; another operator's goes."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def drop_kept() -> None:
    """Let go what earlier operators have learned in this worker; for operators that keep nothing."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Hand freed memory back to the system, since idle workers live on beside the next stage."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)
