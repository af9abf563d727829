"""Names for added columns that never meet a table's own."""

from __future__ import annotations

from collections.abc import Iterable


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many more leading underscores as it takes to be new (case ignored)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name
