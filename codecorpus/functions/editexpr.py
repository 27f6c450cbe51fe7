"""Edit parsing and application as Column expressions (E-1..E-7, W8).

A reply or a file is one row: its lines are an array, and parsing or applying
is a fold over that array inside the JVM. Nothing here needs Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions.patterns import SPACE_BODY, py_regex
from codecorpus.functions.text import lines_keepends, looks_like_path, replace_first, split_lines, strip_py

# FIXED VALUES -- block markers, fences and headers of the edit formats
SEARCH = "<<<<<<< SEARCH"
DIVIDER = "======="
REPLACE = ">>>>>>> REPLACE"
WHOLE_FENCE = "(?s)" + py_regex(r"```[\w]*\s*\n(.*?)```")
NAME_COMMENT = "(?md)" + py_regex(r"^#\s*(.+?\.\w+)\s*$")
NAME_BEFORE = "(?d)" + py_regex(r"`?([^\s`]+\.\w+)`?\s*\n?$")
NAME_REACH = 200
DIFF_FENCE = r"(?s)```diff\n(.*?)```"
DIFF_HEADER = "(?md)" + py_regex(r"^--- (?:a/)?(.+?)\s*\n\+\+\+ (?:b/)?(.+?)\s*$")
HUNK = py_regex(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")

BLOCK = "struct<path:string,original:string,updated:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _block(path: Column, original: Column, updated: Column) -> Column:
    return F.struct(path.alias("path"), original.alias("original"), updated.alias("updated"))


def _between(lines: Column, after: Column, before: Column) -> Column:
    """Text of the lines strictly between two 0-based positions."""
    return F.array_join(F.slice(lines, after + 2, F.greatest(before - after - 1, F.lit(0))), "")


def editblocks(response: Column) -> Column:
    """E-1: the SEARCH/REPLACE blocks of a reply, in order.

    A fold over the lines with three states: outside a block (0), in its search
    part (1), in its replace part (2). Only line positions are carried; the
    texts are cut out at the end. The line that closes a block is looked at
    again as an ordinary line, and an open block runs to the end.
    """

    def parse(lines: Column) -> Column:
        seen = F.transform(lines, lambda x, i: F.struct(
            i.alias("i"), x.contains(SEARCH).alias("s"), x.contains(DIVIDER).alias("d"), x.contains(REPLACE).alias("r"),
            looks_like_path(F.regexp_replace(strip_py(x), ":+$", "")).alias("p")))
        zero = F.lit(0)
        cuts = "array<struct<path:string,a:int,b:int,c:int>>"
        start = F.struct(zero.alias("state"), F.lit(None).cast("string").alias("cur"), zero.alias("a"), zero.alias("b"),
                         F.array().cast(cuts).alias("out"))

        def cut(acc: Column, b: Column, c: Column) -> Column:
            one = F.array(F.struct(acc["cur"].alias("path"), acc["a"].alias("a"), b.alias("b"), c.alias("c")))
            return F.when(acc["cur"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"])

        def step(acc: Column, m: Column) -> Column:
            closes = (acc["state"] == 2) & m["r"]
            plain = (acc["state"] == 0) | closes
            splits = (acc["state"] == 1) & m["d"]
            return F.struct(
                F.when(plain & m["s"], 1).when(plain, 0).when(splits, 2).otherwise(acc["state"]).alias("state"),
                F.when(plain & ~m["s"], F.coalesce(m["p"], acc["cur"])).otherwise(acc["cur"]).alias("cur"),
                F.when(plain & m["s"], m["i"]).otherwise(acc["a"]).alias("a"),
                F.when(splits, m["i"]).otherwise(acc["b"]).alias("b"),
                F.when(closes, cut(acc, acc["b"], m["i"])).otherwise(acc["out"]).alias("out"))

        def last(acc: Column) -> Column:
            n = F.size(lines)
            return F.when(acc["state"] == 1, cut(acc, n, n)).when(acc["state"] == 2, cut(acc, acc["b"], n)).otherwise(acc["out"])

        return F.transform(F.aggregate(seen, start, step, last), lambda x: _block(
            x["path"], _between(lines, x["a"], x["b"]), _between(lines, x["b"], x["c"])))

    return let(lines_keepends(response), parse)


def whole_blocks(response: Column) -> Column:
    """E-2: fenced whole-file blocks that a comment in their first ``NAME_REACH``
    characters, or the end of as many before the fence, names."""
    fences = F.regexp_extract_all(response, F.lit(WHOLE_FENCE), 0)
    bodies = F.regexp_extract_all(response, F.lit(WHOLE_FENCE), 1)
    place = F.aggregate(
        fences, F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at")),
        lambda acc, f: let(F.call_function("locate", f, response, acc["next"]), lambda p: F.struct(
            (p + F.length(f)).alias("next"), F.concat(acc["at"], F.array(p)).alias("at"))),
        lambda acc: acc["at"])

    def named(x: Column) -> Column:
        body, at = x["body"], x["at"]
        head = F.substring(body, 1, NAME_REACH)
        inside = strip_py(F.regexp_extract(head, NAME_COMMENT, 1))
        # the comment goes when it is the very first line
        lead = F.regexp_extract(body, "^#[" + SPACE_BODY + "]*", 0)
        behind = F.substring(body, F.length(lead) + F.length(inside) + 1, F.length(body))
        gap = F.regexp_extract(behind, "^[" + SPACE_BODY + "]*\\n", 0)
        first = (lead != "") & (F.substring(body, F.length(lead) + 1, F.length(inside)) == inside) & (gap != "")
        begin = F.greatest(F.lit(1), at - NAME_REACH)
        before = strip_py(F.substring(response, begin, at - begin))
        return F.when(head.rlike(NAME_COMMENT), _block(
            inside, F.lit(""), F.when(first, F.substring(behind, F.length(gap) + 1, F.length(body))).otherwise(body))
        ).when(before.rlike(NAME_BEFORE), _block(strip_py(F.regexp_extract(before, NAME_BEFORE, 1)), F.lit(""), body))

    found = F.zip_with(bodies, place, lambda b, p: F.struct(b.alias("body"), p.alias("at")))
    return F.filter(F.transform(found, named), lambda b: b.isNotNull())


def udiff_blocks(response: Column) -> Column:
    """E-3: diff fences with a file header; the '+++' line names the file, the diff is ``original``."""
    diffs = F.filter(F.regexp_extract_all(response, F.lit(DIFF_FENCE), 1), lambda d: d.rlike(DIFF_HEADER))
    return F.transform(diffs, lambda d: _block(strip_py(F.regexp_extract(d, DIFF_HEADER, 2)), d, F.lit("")))


def fuzzy_replace(content: Column, original: Column, updated: Column) -> Column:
    """E-5: whitespace-tolerant replacement; NULL when nothing matches.

    Where the texts match up to runs of blanks, the stripped search text is
    replaced literally (if it occurs at all); else the first run of lines
    that are equal after stripping is replaced as lines.
    """
    squeeze = lambda s: F.regexp_replace(strip_py(s), "[ \t]+", " ")
    literal = F.coalesce(replace_first(content, strip_py(original), updated), content)

    def by_lines(t: Column) -> Column:
        span = F.size(t["want"])
        # a run is compared only where its first line is the one wanted
        starts = F.filter(F.sequence(F.lit(0), F.size(t["have"]) - span), lambda s: (
            (span == 0) | (F.get(t["bare"], s) == F.get(t["want"], F.lit(0)))) & (F.slice(t["bare"], s + 1, span) == t["want"]))
        merged = let(F.get(starts, F.lit(0)), lambda s: F.when(s.isNotNull(), F.concat(
            F.array_join(F.concat(F.slice(t["have"], 1, s), split_lines(updated),
                                  F.slice(t["have"], s + span + 1, F.size(t["have"]))), "\n"),
            F.when(content.endswith("\n"), "\n").otherwise(""))))
        return F.when(F.size(t["have"]) >= span, merged)

    texts = let(split_lines(content), lambda have: F.struct(
        have.alias("have"), F.transform(have, strip_py).alias("bare"),
        F.transform(split_lines(original), strip_py).alias("want")))
    return F.when(squeeze(content).contains(squeeze(original)), literal).otherwise(let(texts, by_lines))


def hunks(diff: Column) -> Column:
    """(start, minus, plus) of each hunk: 0-based first line, lines it takes, lines it puts."""

    def of(lines: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: F.get(lines, i).startswith("@@"))
        each = F.transform(heads, lambda i, k: F.struct(
            F.regexp_extract(F.get(lines, i), HUNK, 1).alias("start"),
            F.slice(lines, i + 2, F.coalesce(F.get(heads, k + 1), F.size(lines)) - i - 1).alias("body")))
        side = lambda body, mark: F.transform(
            F.filter(body, lambda x: F.substring(x, 1, 1).isin(mark, " ")), lambda x: F.substring(x, 2, 2147483647))
        return F.transform(F.filter(each, lambda h: h["start"] != ""), lambda h: F.struct(
            (h["start"].try_cast("bigint") - 1).alias("start"), side(h["body"], "-").alias("minus"),
            side(h["body"], "+").alias("plus")))

    return let(split_lines(diff), of)


def _cut(n: Column, h: Column, moved: Column) -> Column:
    """struct(first, after, stop) of a hunk on ``n`` lines: the lines kept before it, the first kept behind it,
    and the end of its lines before clipping; a position before the first line counts from the end."""
    at = h["start"] + moved
    stop = at + F.size(h["minus"])
    clip = lambda p: F.when(p < 0, F.greatest(p + n, F.lit(0))).otherwise(p)
    return F.struct(F.least(clip(at), n).cast("int").alias("first"), F.greatest(clip(stop), clip(at)).cast("int").alias("after"),
                    stop.alias("stop"))


def apply_udiff(content: Column, diff: Column) -> Column:
    """E-6: hunks by position only: each start moves with the lines gained so
    far, and a hunk that reaches past the end is left out."""

    def step(acc: Column, h: Column) -> Column:
        n = F.size(acc["rows"])

        def put(c: Column) -> Column:
            rows = F.concat(F.slice(acc["rows"], F.lit(1), c["first"]), F.transform(h["plus"], lambda p: F.concat(p, F.lit("\n"))),
                            F.slice(acc["rows"], c["after"] + 1, n))
            return F.when(c["stop"] <= n, F.struct(
                rows.alias("rows"), (acc["moved"] + F.size(h["plus"]) - F.size(h["minus"])).alias("moved"))).otherwise(acc)
        return let(_cut(n, h, acc["moved"]), put)

    start = F.struct(lines_keepends(content).alias("rows"), F.lit(0).cast("bigint").alias("moved"))
    return F.aggregate(hunks(diff), start, step, lambda acc: F.array_join(acc["rows"], ""))


def hunk_moves(n: Column, diff: Column) -> Column:
    """(start, takes, puts, moved, applied) of each hunk of a diff on a file of ``n`` lines."""
    kind = "array<struct<start:bigint,takes:int,puts:int,moved:bigint,applied:boolean>>"
    start = F.struct(n.cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("moved"), F.array().cast(kind).alias("out"))

    def step(acc: Column, h: Column) -> Column:
        takes, puts = F.size(h["minus"]), F.size(h["plus"])

        def row(c: Column) -> Column:
            fits = c["stop"] <= acc["n"]
            # lines that an applied hunk leaves: those before and behind what it takes, and its own
            left = c["first"] + puts + F.greatest(acc["n"] - c["after"], F.lit(0))
            return F.struct(
                F.when(fits, left).otherwise(acc["n"]).cast("bigint").alias("n"),
                F.when(fits, acc["moved"] + puts - takes).otherwise(acc["moved"]).alias("moved"),
                F.concat(acc["out"], F.array(F.struct(h["start"].alias("start"), takes.alias("takes"), puts.alias("puts"),
                                                      acc["moved"].alias("moved"), fits.alias("applied")))).alias("out"))
        return let(_cut(acc["n"], h, acc["moved"]), row)

    return F.aggregate(hunks(diff), start, step, lambda acc: acc["out"])


def apply_edit(content: Column, exists: Column, edit: Column) -> Column:
    """One edit on a file's state: struct(status, content, exists).

    A whole file, or an edit without search text, creates; a diff edits;
    a search text must be found exactly or up to white space.
    """

    def state(status: str, text: Column, there: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), text.alias("content"), there.alias("exists"))

    yes = F.lit(True)
    exact = replace_first(content, edit["original"], edit["updated"])
    blank = F.coalesce(strip_py(edit["original"]), F.lit("")) == ""
    found = let(F.coalesce(exact, fuzzy_replace(content, edit["original"], edit["updated"])), lambda new: F.when(
        new.isNull(), state("no_match", content, yes)).otherwise(state("edited", new, yes)))
    return (F.when(edit["format"] == "udiff", state("edited", apply_udiff(content, edit["original"]), yes))
            .when((edit["format"] == "whole") | blank, state("created", edit["updated"], yes))
            .when(~exists, state("missing", content, exists))
            .otherwise(found))
