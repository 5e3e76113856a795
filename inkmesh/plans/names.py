"""Column names of our own that no caller's column can clash with."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each behind as many underscores as keep it apart from those taken, whatever their case."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out
