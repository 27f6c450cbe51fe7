"""Driver-side pattern translation (tiny literal inputs only).

Globs and Python-style regexes are turned into regex *strings* once on the
driver; the matching itself always runs JVM-side (``rlike`` /
``regexp_extract``). Two dialects are produced: Java (Spark) and RE2
(the DuckDB oracle). Python's ``\\w`` / ``\\s`` / ``\\d`` are Unicode-aware,
Java's and RE2's are ASCII, so both are rewritten to explicit classes.
"""

from __future__ import annotations

# Python str-pattern class bodies, written out explicitly.
WORD_BODY = r"\p{L}\p{N}_"
DIGIT_BODY = r"\p{Nd}"
SPACE_BODY = (r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
              r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

# The same white space as characters.
SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_CLASS_BODIES = {"w": WORD_BODY, "s": SPACE_BODY, "d": DIGIT_BODY}

# Line terminators recognised by Python's str.splitlines.
LINE_TERM_CLASS = r"[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
# All of them but the line feed.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAK = r"(?:\r\n|" + LINE_TERM_CLASS + ")"


def py_regex(pattern: str) -> str:
    """Rewrite a Python regex so Java and RE2 give Python's Unicode answers."""
    out: list[str] = []
    i, n, in_class = 0, len(pattern), False
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            body = _CLASS_BODIES.get(nxt)
            if body is not None:
                out.append(body if in_class else "[" + body + "]")
            else:
                out.append(c + nxt)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            # a leading ']' or '^]' is literal inside the class
            if i + 1 < n and pattern[i + 1] == "^":
                out.append("^")
                i += 1
            if i + 1 < n and pattern[i + 1] == "]":
                out.append(r"\]")
                i += 1
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


_META = set(".^$*+?{}[]|()\\/-")


def _lit(ch: str) -> str:
    return "\\" + ch if ch in _META else ch


def _char_class(pat: str, i: int) -> tuple[str | None, int]:
    """Translate a glob bracket expression starting at pat[i] == '['."""
    j = i + 1
    if j < len(pat) and pat[j] in "!^":
        j += 1
    if j < len(pat) and pat[j] == "]":
        j += 1
    while j < len(pat) and pat[j] != "]":
        j += 1
    if j >= len(pat):
        return None, i + 1          # no closing bracket: literal '['
    body = pat[i + 1:j]
    neg = body[:1] in ("!", "^")
    if neg:
        body = body[1:]
    parts = []
    k = 0
    while k < len(body):
        if k + 2 < len(body) and body[k + 1] == "-":
            parts.append(_lit(body[k]) + "-" + _lit(body[k + 2]))
            k += 3
        else:
            parts.append(_lit(body[k]))
            k += 1
    return ("[^" if neg else "[") + "".join(parts) + "]", j + 1


def fnmatch_regex(pat: str) -> str:
    """fnmatch semantics: '*' and '?' also match '/'; whole-string match."""
    out, i = [], 0
    while i < len(pat):
        c = pat[i]
        if c == "*":
            while i < len(pat) and pat[i] == "*":
                i += 1
            out.append(".*")
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            cls, i = _char_class(pat, i)
            out.append(cls if cls is not None else r"\[")
            continue
        else:
            out.append(_lit(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def _segment(seg: str, hidden_guard: bool) -> str:
    """One path component of a glob: '*' and '?' stay inside the component."""
    out, i = [], 0
    while i < len(seg):
        c = seg[i]
        if c == "*":
            while i < len(seg) and seg[i] == "*":
                i += 1
            out.append("[^/]*")
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[":
            cls, i = _char_class(seg, i)
            out.append(cls if cls is not None else r"\[")
            continue
        else:
            out.append(_lit(c))
        i += 1
    body = "".join(out)
    if hidden_guard and not seg.startswith(".") and any(ch in seg for ch in "*?["):
        body = "(?!\\.)" + body
    return body


def glob_regex(pat: str, hidden_guard: bool = True) -> str:
    """glob.glob(recursive=True) over relative paths.

    '**' as a whole component matches zero or more directories; wildcards
    never match a leading '.' of a component unless the pattern has one.
    RE2 has no look-ahead, so the oracle passes ``hidden_guard=False`` and
    the fixture paths avoid leading-dot names under wildcards.
    """
    segs = pat.split("/")
    out = []
    for idx, seg in enumerate(segs):
        last = idx == len(segs) - 1
        if seg == "**":
            if last:
                out.append("(?:[^/]+(?:/[^/]+)*)?" if not hidden_guard
                           else "(?:(?!\\.)[^/]+(?:/(?!\\.)[^/]+)*)?")
            else:
                out.append("(?:[^/]+/)*" if not hidden_guard else "(?:(?!\\.)[^/]+/)*")
            continue
        out.append(_segment(seg, hidden_guard) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def gitwildmatch_regex(line: str) -> tuple[str, bool] | None:
    """gitignore pattern -> (regex over a relative file path, is_negation).

    Returns None for blank lines and comments. A pattern with a slash
    before its last character is anchored at the root; otherwise it
    matches at any depth. A match on a directory covers everything below.
    """
    pat = line.rstrip("\n")
    # trailing spaces are ignored unless escaped
    while pat.endswith(" ") and not pat.endswith("\\ "):
        pat = pat[:-1]
    if not pat or pat.startswith("#"):
        return None
    neg = pat.startswith("!")
    if neg:
        pat = pat[1:]
    if pat.startswith("\\"):
        pat = pat[1:]
    dir_only = pat.endswith("/")
    if dir_only:
        pat = pat[:-1]
    anchored = "/" in pat
    pat = pat.lstrip("/")
    if not pat:
        return None
    segs = pat.split("/")
    out = []
    if not anchored:
        out.append("(?:.+/)?")
    for idx, seg in enumerate(segs):
        last = idx == len(segs) - 1
        if seg == "**":
            if last:
                out.append(".*" if idx == 0 else "")
                continue
            out.append("(?:.+/)?" if idx == 0 else "(?:[^/]+/)*")
            continue
        out.append(_segment(seg, hidden_guard=False) + ("" if last else "/"))
    body = "".join(out)
    if segs[-1] == "**" and len(segs) > 1:
        # "dir/**" matches everything inside dir
        body = body + ".+"
    elif dir_only:
        body = body + "/.*"
    else:
        body = body + "(?:/.*)?"
    return "^" + body + "$", neg


def combined_ignore_regex(patterns: list[str]) -> str:
    """One alternation for a fixed list of ignore patterns (no negations)."""
    parts = []
    for p in patterns:
        r = gitwildmatch_regex(p)
        if r is None:
            continue
        rx, neg = r
        if neg:
            raise ValueError("negations need ordered evaluation: " + p)
        parts.append("(?:" + rx[1:-1] + ")")
    return "^(?:" + "|".join(parts) + ")$"
