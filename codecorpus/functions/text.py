"""Column expressions for text, tokens and paths (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions.patterns import LINE_BREAK, LINE_ENDS, LINE_TERM_CLASS, SPACES, py_regex

_LT_BODY = LINE_TERM_CLASS[1:-1]
# one line with its terminator, or a final unterminated line
_LINE_KEEPENDS = "[^" + _LT_BODY + "]*" + LINE_BREAK + "|[^" + _LT_BODY + "]+"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_lines(text: Column | str) -> Column:
    """Python ``str.splitlines()``: no terminators, no empty last element.

    Every terminator becomes a line feed by plain replacement, which leaves a
    text without it as it is, and the cut at one character needs no regex.
    """
    flat = F.replace(col_(text), F.lit("\r\n"), F.lit("\n"))
    for end in LINE_ENDS:
        flat = F.replace(flat, F.lit(end), F.lit("\n"))
    parts = F.split(flat, "\n")
    return F.slice(parts, F.lit(1), F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))


def lines_keepends(text: Column | str) -> Column:
    """Python ``str.splitlines(keepends=True)``."""
    return F.regexp_extract_all(col_(text), F.lit(_LINE_KEEPENDS), 0)


def count_tokens(text: Column | str) -> Column:
    """Token estimate: max(1, code points // 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(col_(text)) / 4)).cast("long")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col_(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """``Path.suffix``: last '.x' of the basename; dot-files have none."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def suffix_lower(path: Column | str) -> Column:
    return F.lower(suffix(path))


def stem(path: Column | str) -> Column:
    """``Path.stem``: basename without its suffix."""
    name = basename(path)
    sfx = suffix(path)
    return F.when(sfx == "", name).otherwise(
        F.substring(name, F.lit(1), F.length(name) - F.length(sfx)))


_PATH_RE = py_regex(r"^[\w./\\-]+\.\w{1,10}$")


def looks_like_path(text: Column | str) -> Column:
    """Editblock filename test; returns the cleaned path or NULL.

    strip, strip trailing ':' (the caller's), strip quotes/backticks, no
    space, must contain a dot and fully match word/./slash/backslash/dash
    characters plus a 1-10 character extension.
    """
    t = F.regexp_replace(col_(text), r"^[`'\"]+|[`'\"]+$", "")
    ok = (t != "") & ~t.contains(" ") & t.contains(".") & t.rlike(_PATH_RE)
    return F.when(ok, t)


def strip_py(text: Column | str) -> Column:
    """Python ``str.strip()`` (Unicode whitespace), not Spark's space-only trim."""
    return F.btrim(col_(text), F.lit(SPACES))


def replace_first(content: Column | str, original: Column | str,
                  updated: Column | str) -> Column:
    """Literal first-occurrence replace; NULL when ``original`` is absent."""
    c, o, u = col_(content), col_(original), col_(updated)
    # position() takes columns on both sides; an empty needle gives 1 as in Python
    p = F.position(o, c)
    return F.when(p > 0, F.concat(F.substring(c, F.lit(1), p - 1), u,
                                  F.substring(c, p + F.length(o), F.lit(2147483647))))


def normalise_ws(text: Column | str) -> Column:
    """strip, then collapse runs of spaces/tabs to one space."""
    # a single space is left as it is
    return F.regexp_replace(strip_py(text), "[ \t]{2,}|\t", " ")
