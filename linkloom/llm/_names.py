"""Column names that a caller's table doesn't have."""

from __future__ import annotations


def fresh(name: str, taken: list[str]) -> str:
    """The name, with as many underscores after it as it takes to differ from all of ``taken``, whatever their case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
