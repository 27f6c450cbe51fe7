"""Text kernel parity with Python semantics (lines, tokens, paths, regex dialects)."""
import fnmatch
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codecorpus.functions import patterns
from codecorpus.functions.text import (count_tokens, lines_keepends, looks_like_path, normalise_ws,
                                       replace_first, split_lines, stem, suffix_lower)

ODD = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "a", "é", " ", "\t"]


def test_splitlines_parity(spark):
    samples = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb", "a\rb\r", "x\x0by\x0cz", "p q ", "\x1c\x1d\x1e",
               "é\x85ü\n", "last line no end", "\r\n\r\n", "a\n\rb"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: (list(r.l), list(r.k)) for r in
           df.select("i", split_lines("s").alias("l"), lines_keepends("s").alias("k")).collect()}
    for i, s in enumerate(samples):
        assert got[i][0] == s.splitlines(), repr(s)
        assert got[i][1] == s.splitlines(keepends=True), repr(s)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=12).map("".join), min_size=60, max_size=60))
def test_splitlines_property(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    rows = df.select("i", split_lines("s").alias("l"), lines_keepends("s").alias("k")).collect()
    for r in rows:
        assert list(r.l) == texts[r.i].splitlines()
        assert list(r.k) == texts[r.i].splitlines(keepends=True)


def test_tokens_and_paths(spark):
    df = spark.createDataFrame([("Hello, world!", "src/main.PY"), ("", ".bashrc"), ("x" * 41, "a.b.c")],
                               "t string, p string")
    r = df.select(count_tokens("t").alias("n"), suffix_lower("p").alias("s"), stem("p").alias("st")).collect()
    assert [x.n for x in r] == [3, 1, 10]
    assert [x.s for x in r] == [".py", "", ".c"]
    assert [x.st for x in r] == ["main", ".bashrc", "a.b"]


def test_looks_like_path_goldens(spark):
    cases = [("main.py", "main.py"), ("src/utils.py", "src/utils.py"), ("`main.py`", "main.py"),
             ("Makefile", None), ("This is a sentence.", None), ("", None), ("3.14", "3.14")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    got = [r.p for r in df.select(looks_like_path("t").alias("p")).collect()]
    assert got == [b for _, b in cases]


def test_replace_first_and_ws(spark):
    df = spark.createDataFrame([("a b a", "a", "X"), ("abc", "zz", "Y"), ("x\n", "x", "")], "c string, o string, u string")
    got = [r.r for r in df.select(replace_first("c", "o", "u").alias("r")).collect()]
    assert got == ["X b a", None, "\n"]
    df2 = spark.createDataFrame([("  a \t\t b  ",)], "t string")
    assert df2.select(normalise_ws("t")).first()[0] == "a b"


def test_unicode_word_class(spark):
    rx = patterns.py_regex(r"^class\s+(\w+)")
    df = spark.createDataFrame([("class Été:",), ("class _x",), ("klass y",)], "l string")
    got = [r.n for r in df.select(F.regexp_extract("l", rx, 1).alias("n")).collect()]
    assert got == [re.match(r"^class\s+(\w+)", "class Été:").group(1), "_x", ""]


def test_fnmatch_translation():
    for pat, names in [("*.py", ["a.py", "b/c.py", "a.pyc"]), ("doc_?.md", ["doc_1.md", "doc_10.md"]),
                       ("[!a]*", ["abc", "xbc"]), ("*/doc_1*", ["en/doc_12.go", "doc_1.go"])]:
        rx = re.compile(patterns.fnmatch_regex(pat))
        for n in names:
            assert bool(rx.match(n)) == fnmatch.fnmatchcase(n, pat), (pat, n)


def test_gitwildmatch_translation():
    cases = {
        "node_modules/**": [("node_modules/a.js", True), ("src/node_modules/a.js", False)],
        "*.pyc": [("a.pyc", True), ("x/y/a.pyc", True), ("a.py", False)],
        "de/": [("de/a.md", True), ("x/de/a.md", True), ("de", False)],
        "fr/**/doc_2*": [("fr/doc_2.py", True), ("fr/x/y/doc_20.md", True), ("en/fr/doc_2.py", False)],
        "*.egg-info/**": [("pkg.egg-info/PKG-INFO", True), ("a/pkg.egg-info/PKG-INFO", False)],
    }
    for pat, exp in cases.items():
        rx, neg = patterns.gitwildmatch_regex(pat)
        assert not neg
        for path, want in exp:
            assert bool(re.match(rx, path)) == want, (pat, path)
    assert patterns.gitwildmatch_regex("# c") is None
    assert patterns.gitwildmatch_regex("!a.md")[1] is True


def test_glob_translation():
    rx = re.compile(patterns.glob_regex("**/doc_3?.rs"))
    assert rx.match("en/doc_31.rs") and rx.match("doc_35.rs") and rx.match("a/b/doc_30.rs")
    assert not rx.match("en/doc_3.rs")
    assert not re.match(patterns.glob_regex("*.py"), "a/b.py")
    assert not re.match(patterns.glob_regex("*.py"), ".hidden.py")
