"""Column functions for text: Python-compatible strip/split, word tokens, substring tests.

All are built-in Spark expressions (JVM side, whole-stage codegen where the
expression supports it).  Python's ``str.strip()`` / ``str.split()`` treat
more characters as whitespace than Spark's ``trim`` / ``split(' ')`` do, so the
whitespace class below is spelled out once and shared with the SQL oracle.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.isspace() sees it: ASCII controls, the \x1c-\x1f
# separators, NEL, and every Unicode space/line/paragraph separator.  Written
# so Java regex and RE2 read it the same way.
WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
STRIP_RE = r"\A" + WS + r"+|" + WS + r"+\z"
# The same whitespace as an explicit character set (for btrim): every code
# point with str.isspace() — built by that rule, not listed by hand.
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WORD_RE = r"[\p{L}\p{N}_]{2,}"        # two or more word characters, any script
BASENAME_RE = r"([^/\\]*)$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``; NULL stays NULL (``btrim`` with the whitespace set, no regex)."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def words(c) -> Column:
    """``str.split()`` with no argument: whitespace runs, no empty tokens."""
    return F.filter(F.split(col_(c), WS + "+"), lambda x: x != "")


def word_count(c) -> Column:
    return F.size(words(c))


def word_tokens(c) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(WORD_RE), F.lit(0))


def contains_any(c, needles: Iterable[str]) -> Column:
    """True when any needle is a substring (OR chain, stays in codegen)."""
    c = col_(c)
    needles = list(needles)
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def starts_with_any(c, prefixes: Iterable[str]) -> Column:
    c = col_(c)
    prefixes = list(prefixes)
    if not prefixes:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def basename(c) -> Column:
    return F.regexp_extract(col_(c), BASENAME_RE, 1)


def blank(c) -> Column:
    """Python truthiness of a stripped string: NULL and '' are both blank."""
    return F.coalesce(F.length(py_strip(c)), F.lit(0)) == 0
