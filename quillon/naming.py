"""Application names to SQL names."""

from __future__ import annotations

from collections import defaultdict

from .types import QueryError


def _kind(ch: str) -> str:
    """upper, low (lower case and digits), gap (blanks and hyphens) or other"""
    if "A" <= ch <= "Z":
        return "upper"
    if "a" <= ch <= "z" or "0" <= ch <= "9":
        return "low"
    return "gap" if ch == "-" or ch.isspace() else "other"


def snake_case(name: str) -> str:
    """``userID`` -> user_id, ``APIKey`` -> api_key; a run of blanks and hyphens becomes one underscore.

    A capital letter opens a word after a small letter or a digit, and so does the last one of several before a
    small letter.
    """
    kinds = [_kind(ch) for ch in name] + ["end"]
    out = []
    for i, ch in enumerate(name):
        before = kinds[i - 1] if i else "start"
        if kinds[i] == "gap":
            out.append("" if before == "gap" else "_")
            continue
        if kinds[i] == "upper" and (before == "low" or before == "upper" and "a" <= name[i + 1 : i + 2] <= "z"):
            out.append("_")
        out.append(ch.lower())
    return "".join(out)


def sql_names(fields: dict[str, str | None]) -> dict[str, str]:
    """SQL name of each application name; an explicit one wins. Empty and colliding names are errors."""
    chosen = {f: snake_case(f) if own is None else own for f, own in fields.items()}
    holders = defaultdict(list)
    for f, name in chosen.items():
        holders[name].append(f)
    for name, own in holders.items():
        if not name or name.isspace():
            raise QueryError(f"the SQL name of {own[0]!r} is empty")
        if own[1:]:
            raise QueryError(f"{' and '.join(map(repr, own))} would all be {name!r} in SQL")
    return chosen


def fresh(columns, name: str) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
