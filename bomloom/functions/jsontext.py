"""Strict JSON parsing for Arrow stages, shared by the drift and nesting operators."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

#: Bits of a leaf's type; a path's type set is the union of its records' bits.
TYPE_BITS = {"string": 1, "number": 2, "boolean": 4}


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse(text: str | None) -> Any:
    """The parsed value, or None where the text is no JSON (NaN and the like included)."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def storable(text: str) -> str:
    """Lone surrogates can't be stored as UTF-8; they become U+FFFD."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def leaf_text(value: Any) -> str:
    """A scalar as text: strings as they stand, numbers and booleans as in JSON, 7.0 as 7."""
    if isinstance(value, str):
        return storable(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return str(value)


def leaves(value: Any) -> Iterator[tuple[str, int, str]]:
    """(path, type bit, text) of every non-null scalar; arrays add nothing to a path."""
    stack: list[tuple[str, Any]] = [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((path, x) for x in reversed(v))
        elif isinstance(v, str):
            yield storable(path), 1, storable(v)
        elif isinstance(v, bool):
            yield storable(path), 4, leaf_text(v)
        elif v is not None:
            yield storable(path), 2, leaf_text(v)
