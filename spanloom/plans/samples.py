"""Strings that a regular expression matches, read off its parsed form."""

from __future__ import annotations

from re import _constants as _ops
from re import _parser

_OF_CLASS = {_ops.CATEGORY_DIGIT: "7", _ops.CATEGORY_SPACE: " ", _ops.CATEGORY_WORD: "k"}


def example(regex: str, pick: int = 0) -> str:
    """A string that the whole expression matches.

    pick: which alternative of each branch, modulo their number, and how often to repeat
    what may be repeated, as near as the bounds allow. Boundaries and
    look-arounds add nothing, so they hold only where the surroundings let them.
    """
    return _string(_parser.parse(regex), pick, {})


def _string(items, pick: int, groups: dict[int, str]) -> str:
    out = ""
    for op, value in items:
        if op is _ops.LITERAL:
            out += chr(value)
        elif op is _ops.IN:
            out += _member(value)
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT):
            least, most, what = value
            out += "".join(_string(what, pick, groups) for _ in range(min(max(least, pick), most)))
        elif op is _ops.SUBPATTERN:
            found = _string(value[3], pick, groups)
            if value[0] is not None:
                groups[value[0]] = found
            out += found
        elif op is _ops.BRANCH:
            out += _string(value[1][pick % len(value[1])], pick, groups)
        elif op is _ops.GROUPREF:
            out += groups[value]
        elif op is _ops.ANY:
            out += "k"
        elif op is _ops.NOT_LITERAL:
            out += "k" if value != ord("k") else "m"
        elif op not in (_ops.AT, _ops.ASSERT, _ops.ASSERT_NOT):
            raise ValueError(f"no example for {op} in an expression")
    return out


def _member(choices) -> str:
    """A character of a set."""
    first, value = choices[0]
    if first is _ops.NEGATE:
        out = {chr(v) for op, v in choices[1:] if op is _ops.LITERAL}
        return next(c for c in "km7 " if c not in out)
    if first is _ops.LITERAL:
        return chr(value)
    return chr(value[0]) if first is _ops.RANGE else _OF_CLASS[value]
