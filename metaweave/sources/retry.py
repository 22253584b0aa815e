"""What fails in part: lists of names or texts that are halved until only single ones fail, and failures by what they say."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..functions.scalar import SKIPS, UNKNOWN

#: Categories that may pass if tried again.
TRANSIENT = ("rate_limit", "network")


def category(message: str) -> str:
    text = message.upper()
    return next((name for name, words in SKIPS if any(w in text for w in words)), UNKNOWN)


def halved(call: Callable[[list], list], items: list) -> tuple[list[tuple[Any, Any]], list[tuple[Any, str]]]:
    """(item, result) of what works and (item, error) of what doesn't, each in order; call gives one result for each item, or raises.

    A list that fails is asked again in halves. With b bad ones among n that is at most about 2 b log2(n) calls more.
    """
    if not items:
        return [], []
    try:
        found = call(items)
        if len(found) != len(items):
            raise ValueError(f"{len(found)} results for {len(items)} items")
        return list(zip(items, found)), []
    except Exception as error:
        if len(items) == 1:
            return [], [(items[0], f"{type(error).__name__}: {error}")]
    middle = len(items) // 2
    (good, bad), (more, worse) = halved(call, items[:middle]), halved(call, items[middle:])
    return good + more, bad + worse
