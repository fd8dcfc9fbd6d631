"""Text expressions that reproduce Python string semantics with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split()/str.strip() treat as whitespace
# (str.isspace): tab, line feed, vertical tab, form feed, carriage return,
# 0x1c-0x1f (file/group/record/unit separators), space, 0x85, 0xa0, 0x1680,
# 0x2000-0x200a, 0x2028, 0x2029, 0x202f, 0x205f, 0x3000.
# Written in a syntax that both Java regex and RE2 accept.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PY_NON_WHITESPACE_RUN = PY_WHITESPACE_CLASS.replace("[", "[^", 1) + "+"
# The same set as characters, derived from Python itself, for btrim().
PY_WHITESPACE_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
PY_STRIP_PATTERN = "^" + PY_WHITESPACE_CLASS + "+|" + PY_WHITESPACE_CLASS + r"+\z"

# Characters Python's re.escape() prefixes with a backslash.
RE_ESCAPE_CLASS = r"([\\()\[\]{}?*+\-|^$.&~# \t\n\r\x0b\f])"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()`` with Python's whitespace set (plain trim() strips spaces only).

    ``btrim`` with an explicit character set: no regex, stays in codegen.
    """
    return F.btrim(col_(c), F.lit(PY_WHITESPACE_CHARS))


def py_is_blank(c) -> Column:
    """``not s.strip()``; a null counts as blank."""
    return F.coalesce(F.char_length(py_strip(c)) == 0, F.lit(True))


def py_word_count(c) -> Column:
    """``len(s.split())``: number of maximal runs of non-whitespace characters."""
    return F.regexp_count(col_(c), F.lit(PY_NON_WHITESPACE_RUN))


def re_escape(c, max_chars: int | None = None) -> Column:
    """``re.escape(s[:max_chars])`` character for character."""
    s = col_(c)
    if max_chars is not None:
        s = F.substring(s, 1, max_chars)
    return F.regexp_replace(s, RE_ESCAPE_CLASS, r"\\$1")


def unescape_unicode(c) -> Column:
    """Replace ``\\uXXXX`` escapes by the characters they name (UTF-16 units).

    Surrogate pairs written as two escapes are decoded together first; a lone
    surrogate decodes to U+FFFD since UTF-8 strings cannot hold it.
    """
    s = col_(c)
    pair_re = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    one_re = r"\\u[0-9a-fA-F]{4}"
    pairs = F.array_distinct(F.regexp_extract_all(s, F.lit(pair_re), 0))
    s1 = F.aggregate(
        pairs, s,
        lambda acc, x: F.replace(
            acc, x,
            F.decode(F.unhex(F.concat(F.substring(x, 3, 4), F.substring(x, 9, 4))), "UTF-16BE")))
    singles = F.array_distinct(F.regexp_extract_all(s1, F.lit(one_re), 0))
    return F.aggregate(
        singles, s1,
        lambda acc, x: F.replace(acc, x, F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE")))
