"""Python-compatible string helpers as native Spark expressions (see SURVEY §2.9 traps)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters for which Python's str.isspace() is true (what str.strip() removes).
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def char_ranges(chars: str) -> str:
    """A regex character-class body for ``chars`` as compact ``\\x{..}-\\x{..}`` ranges (valid in Java and
    RE2).  A class of many single escapes is several times slower to match in Java than a few ranges."""
    cps = sorted({ord(c) for c in chars})
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\x{{{cps[i]:x}}}" + (f"-\\x{{{cps[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


PY_SPACE_CLASS = char_ranges(PY_WHITESPACE)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x: Column | str) -> Column:
    """Python ``str.strip()`` (Unicode whitespace, not just spaces)."""
    return F.btrim(_c(x), F.lit(PY_WHITESPACE))


def strip_chars(x: Column | str, chars: str) -> Column:
    return F.btrim(_c(x), F.lit(chars))


def lstrip_chars(x: Column | str, chars: str) -> Column:
    return F.regexp_replace(_c(x), "^[" + _cls(chars) + "]+", "")


def rstrip_chars(x: Column | str, chars: str) -> Column:
    return F.regexp_replace(_c(x), "[" + _cls(chars) + "]+\\z", "")


def _cls(chars: str) -> str:
    return "".join("\\" + ch if ch in "\\^]-[" else ch for ch in chars)


def count_sub(x: Column | str, sub: str) -> Column:
    """Python ``str.count(sub)``: non-overlapping occurrences."""
    x = _c(x)
    return ((F.length(x) - F.length(F.replace(x, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("int")
