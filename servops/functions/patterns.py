"""Error patterns in Python's dialect: validity, and whether a match can reach over a line end."""

from __future__ import annotations

import re
from re import _constants as C  # the parsed form of a pattern has no public interface
from re import _parser as P

# Nodes and categories that never match a line feed (by name: the nodes themselves can't be sent to tasks).
_PLAIN = {"LITERAL", "ANY", "GROUPREF"}
_WITHIN_LINE_CATEGORIES = {"CATEGORY_DIGIT", "CATEGORY_WORD", "CATEGORY_NOT_SPACE"}


def compiled(pattern: str | None):
    """The pattern as the catalog means it (case-insensitive), or None if Python refuses it."""
    if pattern is None:
        return None
    try:
        return re.compile(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None


def _local(nodes) -> bool:
    for op, arg in nodes:
        if op is C.LITERAL:
            if arg == 10:
                return False
        elif str(op) in _PLAIN:
            continue
        elif op is C.AT:
            if arg is not C.AT_BOUNDARY:
                return False
        elif op is C.IN:
            for kind, value in arg:
                if kind is C.NEGATE or kind is C.CATEGORY and str(value) not in _WITHIN_LINE_CATEGORIES:
                    return False
                if kind is C.LITERAL and value == 10 or kind is C.RANGE and value[0] <= 10 <= value[1]:
                    return False
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            if not _local(arg[2]):
                return False
        elif op is C.SUBPATTERN:
            if arg[1] & re.DOTALL or not _local(arg[3]):
                return False
        elif op is C.BRANCH:
            if not all(_local(b) for b in arg[1]):
                return False
        elif op is C.ATOMIC_GROUP:
            if not _local(arg):
                return False
        else:
            return False
    return True


def line_local(pattern: str) -> bool:
    """Whether the pattern matches a text of several lines exactly when it matches one of the lines.

    True only for patterns without anchors, look-around, and anything that can match a line feed.
    """
    tree = P.parse(pattern, re.IGNORECASE)
    return not tree.state.flags & (re.DOTALL | re.MULTILINE) and _local(tree)


def _runs(nodes, out: list[list[str]]) -> None:
    """Appends the characters that every match holds one behind the other; the last list of ``out`` is open."""
    for op, arg in nodes:
        if op is C.LITERAL:
            out[-1].append(chr(arg))
        elif op is C.SUBPATTERN:
            _runs(arg[3], out)
        elif op is C.ATOMIC_GROUP:
            _runs(arg, out)
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue  # takes no characters
        else:
            out.append([])


def required_literals(pattern: str) -> list[str]:
    """Strings that every match of the pattern holds (in any case of their letters)."""
    out: list[list[str]] = [[]]
    _runs(P.parse(pattern, re.IGNORECASE), out)
    return ["".join(run) for run in out if run]


#: no bound on the line feeds of a match, or one that depends on where the text begins and ends
UNBOUNDED = float("inf")


def _reach(nodes, flags: int, groups: dict) -> float:
    """Most line feeds that a match of the nodes can hold."""
    total = 0.0
    for op, arg in nodes:
        if op is C.LITERAL:
            total += arg == 10
        elif op is C.NOT_LITERAL:
            total += arg != 10
        elif op is C.ANY:
            total += bool(flags & re.DOTALL)
        elif op is C.IN:
            total += not _local([(op, arg)])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            one = _reach(arg[2], flags, groups)
            total += 0 if one == 0 else UNBOUNDED if arg[1] is C.MAXREPEAT else one * arg[1]
        elif op is C.SUBPATTERN:
            one = _reach(arg[3], (flags | arg[1]) & ~arg[2], groups)
            groups[arg[0]] = one
            total += one
        elif op is C.ATOMIC_GROUP:
            total += _reach(arg, flags, groups)
        elif op is C.BRANCH:
            total += max(_reach(b, flags, groups) for b in arg[1])
        elif op is C.GROUPREF:
            total += groups.get(arg, UNBOUNDED)
        elif op is C.AT and arg in (C.AT_BOUNDARY, C.AT_NON_BOUNDARY):
            continue
        else:  # ends of the text or of a line, look-around, conditions
            return UNBOUNDED
    return total


def line_reach(pattern: str) -> float:
    """Most line feeds that a match of the pattern can hold, ``UNBOUNDED`` if it has no bound.

    A match with r of them lies in r + 1 neighbouring lines; a pattern with a bound has no anchors or
    look-around, so it matches a text of lines exactly when it matches r + 1 of them, one behind the other.
    """
    tree = P.parse(pattern, re.IGNORECASE)
    return _reach(tree, tree.state.flags, {})
