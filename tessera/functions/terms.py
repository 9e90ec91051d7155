"""Patterns over whole terms, as Java regular expressions."""

from __future__ import annotations

import re

_SPECIAL = set(r".+*?()[]{}|^$\/-&#~@<>\"")


def wildcard_to_java(pattern: str) -> str:
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out.append(_quoted(pattern[k]))
        else:
            out.append({"*": r"[\s\S]*", "?": r"[\s\S]"}.get(c) or _quoted(c))
        k += 1
    return "^(?:" + "".join(out) + r")\z"


def _quoted(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def regexp_to_java(pattern: str) -> str:
    """Operators that only the index's own dialect has are an error."""
    bare = re.sub(r"\\.", "", pattern)
    if found := set(bare) & set('~&@#<>"'):
        raise ValueError(f"the operators {' '.join(sorted(found))} aren't supported in a regular expression; escape them")
    return f"^(?:{pattern.replace('^', '\\^').replace('[\\^', '[^').replace('$', '\\$')})\\z"
