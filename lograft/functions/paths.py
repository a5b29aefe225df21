"""Field paths: ``a.b[0].c`` and JSON pointers."""

from __future__ import annotations

import re

Path = tuple[str | int, ...]
_PART = re.compile(r"\[(\d+)\]|([^.\[\]]+)|\.")


def parse_path(path: str | Path) -> Path:
    """Names and indices of a dotted path; an index may also come first or follow another."""
    if not isinstance(path, str):
        return tuple(path)
    out: list[str | int] = []
    at = 0
    while at < len(path):
        m = _PART.match(path, at)
        if not m:
            raise ValueError(f"no field path: {path!r}")
        if m[1] is not None:
            out.append(int(m[1]))
        elif m[2] is not None:
            out.append(m[2])
        at = m.end()
    return tuple(out)


def variant_path(path: Path) -> str:
    """The path as Spark's variant functions take it."""
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else "['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path)


def pointer_tokens(pointer: str) -> list[str] | None:
    """Tokens of an RFC 6901 pointer; none for the whole record, None if it is no pointer."""
    if not pointer:
        return []
    if not pointer.startswith("/"):
        return None
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]
