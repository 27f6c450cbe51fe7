"""Hand-derived goldens for the page helpers and the edit expressions."""
import difflib

import pytest
from pyspark.sql import functions as F

from codecorpus.functions import editexpr
from codecorpus.operators import corpus, edits, pages


@pytest.fixture(scope="module")
def page(spark):
    """The extracted row of one page."""
    def run(url, html):
        df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
        return pages.extract_pages(df).first()
    return run


def test_unclosed_p_nests_and_text_glues(page):
    html = ("<html><head><title>T &amp; x</title><meta name='description' content='D'></head><body>"
            "<nav><a href='/n'>nav link</a></nav><article><h1>Head one</h1>"
            "<p>first paragraph a <b>b</b><p>second paragraph here</article>"
            "<footer>foot</footer></body></html>")
    r = page("https://x.test/a", html)
    md = r.content
    # the outer p contains the inner one, so its text is emitted with the inner text glued on
    assert "first paragraph absecond paragraph here" in md
    assert "second paragraph here" in md.split("\n")[-1]
    assert md.startswith("# Head one")
    assert "nav link" not in md and "foot" not in md
    assert (r.title, r.description, [tuple(h) for h in r.headings]) == ("T & x", "D", [(1, "Head one")])
    assert [tuple(x) for x in r.links] == [("nav link", "/n")]


def test_scheme_check_and_plain_passthrough(page):
    assert page("ftp://x/y", "<p>z</p>").content == "[Disallowed URL scheme 'ftp'. Only http/https are permitted.]"
    assert page("HTTPS://x/readme.md", "# raw *md*").content == "# raw *md*"


def test_main_area_noise_and_blocks(page):
    # the main element goes before an article and a class; what noise holds is neither an area nor text
    html = ("<div class='content'><p>in a class, long enough</p></div><aside><main><p>not this main, in noise</p></main></aside>"
            "<main><p>kept text <script>var x</script>goes on</p><ul><li>short</li><li>a longer item</li></ul>"
            "<pre>  code\n  more\n</pre><a href='/k'> link </a><a>no target</a><a href=''>empty</a><h2> </h2><br><h3>Three</h3></main>")
    r = page("http://x/", html)
    assert r.content == ("kept textgoes on\na longer item\n\n```\ncode\n  more\n```\n\n[link](/k)\n\n### Three")
    assert [tuple(x) for x in r.links] == [("link", "/k")] and [tuple(x) for x in r.headings] == [(3, "Three")]
    assert page("http://x/", "<p id='Main-1'><b>bold</b> and more words</p>tail").content == ""
    assert page("http://x/", "<body>x<p>all of the body &lt;tag&gt;</p></i></body>").content == "all of the body <tag>"
    assert page("http://x/", "").content == "" and page("http://x/", None).links == []


@pytest.fixture(scope="module")
def value(spark):
    """Evaluate an expression over string arguments."""
    def run(fn, *args):
        df = spark.createDataFrame([tuple(args)], ", ".join(f"a{i} string" for i in range(len(args))))
        return df.select(fn(*[F.col(f"a{i}") for i in range(len(args))]).alias("r")).first()["r"]
    return run


def test_editblock_edge_cases(value):
    # no end marker: block runs to the end; blocks before any filename are dropped
    t = "<<<<<<< SEARCH\na\n=======\nb\n>>>>>>> REPLACE\nf.py\n<<<<<<< SEARCH\nx\n=======\ny\n"
    assert [tuple(b) for b in value(editexpr.editblocks, t)] == [("f.py", "x\n", "y\n")]
    # neither divider nor end; a name inside a block is no file name; the end line may open the next block
    t = "a.py\n<<<<<<< SEARCH\nb.py\n"
    assert [tuple(b) for b in value(editexpr.editblocks, t)] == [("a.py", "b.py\n", "")]
    t = "`a.py`:\n<<<<<<< SEARCH\n=======\n1\n>>>>>>> REPLACE <<<<<<< SEARCH\nz\n=======\n>>>>>>> REPLACE"
    assert [tuple(b) for b in value(editexpr.editblocks, t)] == [("a.py", "", "1\n"), ("a.py", "z\n", "")]
    assert value(editexpr.editblocks, "") == [] and value(editexpr.editblocks, None) is None


def test_whole_blocks(value):
    one = "```python\n# src/a.py\nx = 1\n```\nthen `b.js`\n```js\nlet y\n```\n```\nno name\n```"
    assert [tuple(b) for b in value(editexpr.whole_blocks, one)] == [("src/a.py", "", "x = 1\n"), ("b.js", "", "let y\n")]
    # a name comment further down names the file but stays; equal fences keep their own names
    two = "f.txt\n```\nq\n```\ng.txt\n```\nq\n```\n```\ntop\n# h.c \nz\n```"
    assert [tuple(b) for b in value(editexpr.whole_blocks, two)] == [
        ("f.txt", "", "q\n"), ("g.txt", "", "q\n"), ("h.c", "", "top\n# h.c \nz\n")]


def test_fuzzy_noop_and_window(value):
    # normalised containment, but the stripped search text does not occur literally
    assert value(editexpr.fuzzy_replace, "a  b\n", "a b", "c") == "a  b\n"
    assert value(editexpr.fuzzy_replace, "p\n  q  \nr\n", "q\nr", "Z") == "p\nZ\n"
    assert value(editexpr.fuzzy_replace, "abc", "zzz", "y") is None
    assert value(editexpr.fuzzy_replace, "abc", "z\nz\nz", "y") is None


def test_udiff_round_trip_and_skip(value):
    old = "a\nb\nc\nd\n"
    new = "a\nB\nc\nD\n"
    diff = "\n".join(x.rstrip("\n") for x in difflib.unified_diff(old.splitlines(True), new.splitlines(True), n=1))
    assert value(editexpr.apply_udiff, old, diff) == new
    # several hunks, each moved by the lines gained before it
    long = "".join(f"l{i}\n" for i in range(40))
    far = long.replace("l3\n", "l3\nx\ny\n").replace("l20\n", "").replace("l35\n", "Q\n")
    diff = "\n".join(x.rstrip("\n") for x in difflib.unified_diff(long.splitlines(True), far.splitlines(True), n=2))
    assert diff.count("@@ -") == 3 and value(editexpr.apply_udiff, long, diff) == far
    # positional quirk kept on purpose: a zero-context insertion "@@ -4,0" lands before line 4
    ins = "\n".join(x.rstrip("\n") for x in difflib.unified_diff(old.splitlines(True), (old + "e\n").splitlines(True), n=0))
    assert value(editexpr.apply_udiff, old, ins) == "a\nb\nc\ne\nd\n"
    # a hunk past the end is skipped silently
    assert value(editexpr.apply_udiff, "a\n", "@@ -5,1 +5,1 @@\n-x\n+y") == "a\n"
    # @@ -0,0 inserts before the last line of a non-empty file
    assert value(editexpr.apply_udiff, "a\nb\n", "@@ -0,0 +1,1 @@\n+z") == "a\nz\nb\n"


def test_edits_stay_in_their_repo(spark):
    files = spark.createDataFrame([("r1", "a.py", "x = 1\n"), ("r2", "a.py", "y = 1\n")], "repo_id string, path string, content string")
    ed = spark.createDataFrame([
        ("r1", 1, 0, "editblock", "a.py", "x = 1\n", "x = 2\n"), ("r2", 2, 0, "editblock", "a.py", "x = 1\n", "x = 9\n"),
        ("r1", 3, 0, "editblock", "a.py", "x = 2\n", "x = 3\n"), ("r2", 4, 0, "whole", "b.py", "", "new\n")],
        "repo_id string, response_id long, block_no int, format string, path string, original string, updated string")
    out = {(r["repo_id"], r["response_id"]): r for r in edits.apply_edits(files, ed).collect()}
    assert {k: r["status"] for k, r in out.items()} == {("r1", 1): "edited", ("r2", 2): "no_match", ("r1", 3): "edited", ("r2", 4): "created"}
    assert out["r1", 3]["content"] == "x = 3\n" and out["r1", 1]["content"] is None and out["r2", 2]["content"] == "y = 1\n"
    whole = {(r["repo_id"], r["path"]): r["status"] for r in edits.apply_whole(files, ed.where("format = 'whole'")).collect()}
    assert whole == {("r1", "a.py"): "kept", ("r2", "a.py"): "kept", ("r2", "b.py"): "created"}


def test_symbols_of_a_very_long_line(spark):
    """Thousands of words on a line neither overflow the matcher's stack nor hide the symbol."""
    words = "word " * 20_000
    files = spark.createDataFrame([("r", "a.c", words + "\nint main(int x) {"), ("r", "b.java", "    public " + words + "run ("),
                                   ("r", "c.cpp", words + "area(int x) {")], "repo_id string, path string, content string")
    got = {(r["path"], r["line"], r["type"], r["name"]) for r in corpus.extract_symbols(files).collect()}
    assert got == {("a.c", 2, "function", "main"), ("b.java", 1, "method", "run"), ("c.cpp", 1, "function", "area")}


def test_pages_are_parsed_a_few_at_a_time(monkeypatch):
    """A batch of many pages gives pieces of few, with the rows of the whole batch in order."""
    import pyarrow as pa

    from codecorpus.functions import htmlnodes
    html = [None, "", "<p>a</p>", "<p>" + "b" * 90 + "</p>", *["<h1>c</h1>"] * 30]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(html))), "html": html})
    whole = pa.Table.from_batches(htmlnodes.parsed([batch]))
    monkeypatch.setattr(htmlnodes, "PARSED_BYTES", 60)
    monkeypatch.setattr(htmlnodes, "PARSED_PAGES", 4)
    held = []
    pieces = []
    for piece in htmlnodes.parsed([batch, batch.slice(0, 0)]):
        held.append(piece.num_rows)
        pieces.append(piece)
    assert max(held) == 4 and len(held) > 8
    assert pa.Table.from_batches(pieces).to_pylist() == whole.to_pylist()
