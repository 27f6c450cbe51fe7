"""Edit chains in runs, budget cuts in salts, globs and ignore rules against plain Python."""
import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from codecorpus.operators import corpus, edits, repomap

EDIT = "repo_id string, path string, response_id long, block_no int, format string, original string, updated string"
FILE = "repo_id string, path string, content string"


def fold(files, rows):
    """{(path, response_id): (status, content after)} of exact edits, one after the other."""
    state, out = dict(files), {}
    for _, path, rid, _, fmt, old, new in sorted(rows, key=lambda r: r[2]):
        if fmt == "whole" or not old.strip():
            state[path], status = new, "created"
        elif path not in state:
            status = "missing"
        elif old in state[path]:
            state[path], status = state[path].replace(old, new, 1), "edited"
        else:
            status = "no_match"
        out[path, rid] = (status, state.get(path))
    return out


@pytest.mark.parametrize("run", [1, 3, 4096])
def test_chains_in_runs_match_one_by_one(spark, run, monkeypatch):
    monkeypatch.setattr(edits, "RUN", run)
    rng = random.Random(run)
    files = {"a": "<0>", "b": "<5>x"}
    rows = []
    for rid in range(60):
        path, n = rng.choice("abcd"), rng.randrange(8)
        kind = rng.random()
        if kind < 0.12:
            rows.append(("r", path, rid, 0, "whole", "", f"<{n}>"))
        else:
            rows.append(("r", path, rid, 0, "editblock", f"<{n}>", f"<{(n + 1) % 8}>"))
    out = edits.apply_edits(spark.createDataFrame([("r", *f) for f in files.items()], FILE), spark.createDataFrame(rows, EDIT)).collect()
    want = fold(files, rows)
    assert {(r.path, r.response_id): r.status for r in out} == {k: v[0] for k, v in want.items()}
    last = {p: max(i for q, i in want if q == p) for p, _ in want}
    assert {r.path: (r.response_id, r.content) for r in out if r.final} == {p: (i, want[p, i][1]) for p, i in last.items()}


def test_diffs_create_missing_files(spark):
    rows = [("r", "n", 1, 0, "editblock", "a", "b"), ("r", "n", 2, 0, "udiff", "@@ -0,0 +1,1 @@\n+one", ""),
            ("r", "n", 3, 0, "editblock", "one", "two"), ("r", "n", 4, 0, "udiff", "@@ -1,1 +1,1 @@\n-two\n+three", "")]
    out = {r.response_id: r for r in edits.apply_edits(spark.createDataFrame([], FILE), spark.createDataFrame(rows, EDIT)).collect()}
    assert [out[i].status for i in (1, 2, 3, 4)] == ["missing", "edited", "edited", "edited"]
    assert out[4].final and out[4].content == "three\n" and not out[3].final


def test_hot_paths(spark):
    """100,000 edits of a missing path and a chain of 20,000 on one file: one row each, all statuses right."""
    missing = spark.range(100_000).select(F.lit("r").alias("repo_id"), F.lit("gone").alias("path"), F.col("id").alias("response_id"),
                                          F.lit(0).alias("block_no"), F.lit("editblock").alias("format"),
                                          F.lit("a").alias("original"), F.lit("b").alias("updated"))
    chain = spark.range(20_000).select(F.lit("r"), F.lit("here"), F.col("id"), F.lit(0), F.lit("editblock"),
                                       F.concat(F.lit("<"), F.col("id"), F.lit(">")), F.concat(F.lit("<"), F.col("id") + 1, F.lit(">")))
    out = edits.apply_edits(spark.createDataFrame([("r", "here", "<0>")], FILE), missing.union(chain))
    assert {(r.path, r.status, r.changed): r.n for r in out.groupBy("path", "status", "changed").agg(F.count("*").alias("n")).collect()} == {
        ("gone", "missing", False): 100_000, ("here", "edited", True): 20_000}
    assert [(r.path, r.content) for r in out.where("final").orderBy("path").collect()] == [("gone", None), ("here", "<20000>")]


@pytest.mark.parametrize(("tokens", "salts"), [(10, "8"), (700, "8"), (700, "200"), (100_000, "200")])
def test_budget_cut_matches_a_running_sum(spark, tokens, salts):
    rng = random.Random(tokens)
    rows = [(f"r{rng.randrange(2)}", f"p{i:05d}", rng.randrange(4), rng.randrange(8, 200)) for i in range(4000)]
    blocks = (spark.createDataFrame(rows, "repo_id string, path string, k int, chars int")
              .select("repo_id", "path", "chars", F.struct(F.lit(True).alias("k1"), F.col("k").alias("k2")).alias("fkey")))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", salts)
    try:
        got = {(r.repo_id, r.path): (r.pos, r.cum_chars) for r in repomap.map_budget(blocks, tokens).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for repo in ("r0", "r1"):
        total = 0
        for pos, (_, path, _, chars) in enumerate(sorted((r for r in rows if r[0] == repo), key=lambda r: (r[2], r[1])), start=1):
            if total > tokens * 3:
                break
            total += chars
            want[repo, path] = (pos, total)
    assert got == want


def test_globs_find_what_matching_every_path_finds(spark):
    paths = ["a.py", "src/a.py", "src/b/c.py", "src/b/d.go", "lib/x[1].py", "lib/x1.py", "README", "src/.hid.py", "deep/a/b/c/e.py"]
    patterns = ["*.py", "src/*.py", "**/*.py", "src/**/*.py", "src/b/c.py", "lib/x[1].py", "lib/x[ab].py", "README", "nope", "*/b/*", "**/c.*", "?.py", "src/**"]
    files = spark.createDataFrame([("r", p) for p in paths] + [("other", "a.py")], "repo_id string, path string")
    asked = spark.createDataFrame([(i, "r", p) for i, p in enumerate(patterns)], "conv_id int, repo_id string, pattern string")
    got = {}
    for r in corpus.glob_add(asked, files).collect():
        got.setdefault(r.pattern, set()).add(r.path)
    assert got["*.py"] == {"a.py"} and got["src/*.py"] == {"src/a.py"} and got["**/*.py"] == {p for p in paths if fnmatch.fnmatch(p, "*.py")} - {"src/.hid.py"}
    assert got["src/**/*.py"] == {"src/a.py", "src/b/c.py"} and got["src/b/c.py"] == {"src/b/c.py"} and got["*/b/*"] == {"src/b/c.py", "src/b/d.go"}
    # brackets are a class; a path that is written like the pattern is taken only where the class finds nothing
    assert got["lib/x[1].py"] == {"lib/x1.py"} and got["lib/x[ab].py"] == {None} and got["nope"] == {None} and got["README"] == {"README"}
    assert got["**/c.*"] == {"src/b/c.py"} and got["?.py"] == {"a.py"} and got["src/**"] == {"src/a.py", "src/b/c.py", "src/b/d.go"} | (got["src/**"] & {"src"})
    literal = corpus.glob_add(spark.createDataFrame([(1, "r", "x[9].c")], "conv_id int, repo_id string, pattern string"),
                              spark.createDataFrame([("r", "x[9].c")], "repo_id string, path string")).collect()
    assert [(r.path, r.status) for r in literal] == [("x[9].c", "added")]


def test_requests_times_hits_are_only_rows_of_the_output(spark, monkeypatch, capsys):
    """Blocks of few paths, requests and files that come twice, nulls: the rows of meeting every file; no join holds them."""
    monkeypatch.setattr(corpus, "GLOB_BLOCK", 4)
    paths = [f"src/f{i}.py" for i in range(50)] + ["src/f0.py", "lib/[x].py", None]
    asked = [(i % 30, "r", "src/*.py") for i in range(40)] + [(1, "r", "lib/[x].py"), (2, "r", None), (3, None, "src/*.py"), (4, "r", "no/*.py")]
    found = corpus.glob_add(spark.createDataFrame(asked, "conv_id int, repo_id string, pattern string"),
                            spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string"))
    want = [(c, g, p, "added") for c, r, g in asked if r and g == "src/*.py" for p in paths[:51]]
    want += [(1, "lib/[x].py", "lib/[x].py", "added"), (2, None, None, "not_found"), (3, "src/*.py", None, "not_found"), (4, "no/*.py", None, "not_found")]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    found.explain()
    plan = capsys.readouterr().out
    assert plan.index("Generate explode") < plan.index("Join")


def test_last_ignore_rule_wins(spark):
    rules = ["*.log", "!keep.log", "/top.txt", "tmp/", "a/**/z", "# no rule", "", "!tmp/stay"]
    cases = {"x.log": False, "d/x.log": False, "d/keep.log": True, "top.txt": False, "d/top.txt": True, "tmp/f": False, "d/tmp/f": False,
             "tmp/stay": True, "a/z": False, "a/b/c/z": False, "b/a/z": True, "plain": True}
    files = spark.createDataFrame([("r", p) for p in cases] + [("free", "x.log")], "repo_id string, path string")
    given = spark.createDataFrame([("r", i, x) for i, x in enumerate(rules)], "repo_id string, rule_no int, rule string")
    kept = {(r.repo_id, r.path) for r in corpus.filter_repo_ignore(files, given).collect()}
    assert kept == {("r", p) for p, stays in cases.items() if stays} | {("free", "x.log")}


def test_maps_of_sessions_are_their_own(spark):
    files = spark.createDataFrame([("r", "a.py", "def alpha():\n"), ("r", "b.py", "class Beta:\n"), ("r", "c.py", "def a():\ndef beta():\n"),
                                   ("r", "gone.py", "def gone():\n")], FILE)
    chats = spark.createDataFrame([(1, "r", "a.py"), (2, "r", "b.py"), (2, "r", "c.py"), (3, "r", "nowhere.py")], "conv_id int, repo_id string, path string")
    rules = spark.createDataFrame([("r", 1, "gone.*")], "repo_id string, rule_no int, rule string")
    got = {r.conv_id: r.repo_map for r in repomap.session_maps(files, chats, rules=rules).collect()}
    body = lambda m: m.removeprefix("```\nRepo map:\n").removesuffix("\n```").split("\n")
    # c.py names a, the stem of the session's file: it comes before the class
    assert body(got[1]) == ["c.py", "  def a:", "  def beta:", "b.py", "  class Beta:"]
    assert body(got[2]) == ["a.py", "  def alpha:"]
    assert body(got[3]) == ["b.py", "  class Beta:", "a.py", "  def alpha:", "c.py", "  def a:", "  def beta:"]
    left = {(r.conv_id, r.path) for r in corpus.exclude_chat_files(files, chats).collect()}
    assert left == {(1, "b.py"), (1, "c.py"), (1, "gone.py"), (2, "a.py"), (2, "gone.py"), *((3, p) for p in ("a.py", "b.py", "c.py", "gone.py"))}
