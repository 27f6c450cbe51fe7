"""The reference tests' intent, re-stated as one-row DataFrames (FIXTURES.md section 2)."""
from pyspark.sql import functions as F

from codecorpus.operators import agents, chat, corpus, edits, repomap
from codecorpus.operators.changes import unified_diff


def _files(spark, rows):
    return spark.createDataFrame([("r",) + r for r in rows], "repo_id string, path string, content string")


def test_symbols_goldens(spark):
    f = _files(spark, [("a.py", "class MyClass:\n    pass\ndef compute(x):\n    return x\n"),
                       ("b.ts", "export interface UserProfile {\n}\n"),
                       ("c.go", "func HandleRequest(w http.ResponseWriter) {\n}\n"),
                       ("d.md", "# Title\nclass Nope\n"),
                       ("e.py", "def _private_func():\n    pass\ndef public_func():\n    pass\n")])
    tags = {(r.path, r.name) for r in corpus.extract_symbols(f).collect()}
    assert ("a.py", "MyClass") in tags and ("a.py", "compute") in tags
    assert ("b.ts", "UserProfile") in tags and ("c.go", "HandleRequest") in tags
    assert not any(p == "d.md" for p, _ in tags)
    assert ("e.py", "public_func") in tags and ("e.py", "_private_func") not in tags


def test_scan_excludes_pycache(spark):
    t = _files(spark, [("a.py", "x"), ("b.py", "y"), ("notes.txt", "z"), ("__pycache__/module.pyc", "b")])
    got = {r.path for r in corpus.scan_repo_files(t).collect()}
    assert {"a.py", "b.py"} <= got and "__pycache__/module.pyc" not in got


def test_repo_map_chat_exclusion_and_empty(spark):
    f = _files(spark, [("main.py", "def run():\n    pass\n")])
    chat_files = spark.createDataFrame([("r", "main.py")], "repo_id string, path string")
    m = repomap.repo_map(f, chat_files=chat_files).first()
    assert m.repo_map == ""          # the only file is in the chat
    m2 = repomap.repo_map(f).first()
    assert m2.repo_map.startswith("```\nRepo map:\nmain.py\n  def run:") and m2.repo_map.endswith("```")


def test_repo_map_budget_keeps_overflowing_file(spark):
    body = "\n".join(f"def f{i}():" for i in range(50))
    f = _files(spark, [(f"m{j}.py", body) for j in range(3)])
    m = repomap.repo_map(f, max_map_tokens=10).first()   # 30 chars: first file overflows
    assert m.n_files == 1 and m.repo_map.endswith("  ... (truncated)\n```")


def test_is_text_and_language(spark):
    df = spark.createDataFrame([("a.py", bytearray(b"print(1)")), ("i.png", bytearray(b"x")),
                                ("d.bin", bytearray(b"ab\x00c"))], "path string, b binary")
    assert [r[0] for r in df.select(corpus.is_text(F.col("path"), F.col("b"))).collect()] == [True, False, False]
    names = ["main.py", "app.js", "component.tsx", "server.go", "lib.rs", "Main.java", "unknown.xyz", "Dockerfile"]
    df2 = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r[0] for r in df2.select(corpus.detect_language(F.col("path"))).collect()]
    assert got == ["python", "javascript", "typescript", "go", "rust", "java", "", "dockerfile"]


def test_create_only_rejects_existing(spark):
    f = _files(spark, [("a.py", "x")])
    req = spark.createDataFrame([(1, "a.py"), (2, "b.py")], "response_id long, path string")
    got = {r.path: r.status for r in edits.create_only(f, req).collect()}
    assert got == {"a.py": "exists", "b.py": "created"}


def test_unified_diff_goldens(spark):
    a = _files(spark, [("f.txt", "line1\nline2\nline3\n"), ("same.txt", "x\n"), ("new.txt", "")])
    b = _files(spark, [("f.txt", "line1\nLINE2\nline3\n"), ("same.txt", "x\n"), ("new.txt", "hello\nworld\n")])
    d = {r.path: r.diff for r in unified_diff(a, b).collect()}
    assert "-line2" in d["f.txt"] and "+LINE2" in d["f.txt"]
    assert "same.txt" not in d
    assert "+hello" in d["new.txt"] and "+world" in d["new.txt"]


def test_resolve_model_and_list(spark):
    s = spark.createDataFrame([(1, "gpt-4o"), (2, "nonexistent-model"), (3, "claude"), (4, "4o"), (5, "deepseek")],
                              "conv_id long, model string")
    r = {x.conv_id: x for x in chat.resolve_model(s).collect()}
    assert (r[1].context_window, r[1].supports_vision, r[1].provider) == (128000, True, "openai")
    assert (r[2].context_window, r[2].supports_vision) == (128000, False)
    assert r[3].resolved == "claude-3-7-sonnet-20250219" and r[4].resolved == "gpt-4o"
    assert r[5].resolved == "deepseek/deepseek-chat"
    names = [x.model for x in chat.list_models(spark, "openai").collect()]
    assert "gpt-4o" in names and names == sorted(names)


def test_tokens_and_truncation(spark):
    df = spark.createDataFrame([("Hello, world!", "\n".join(f"line {i} with some words" for i in range(200)))],
                               "a string, b string")
    from codecorpus.functions.text import count_tokens
    r = df.select(count_tokens("a").alias("n"), chat.truncate_to_tokens(F.col("b"), 50).alias("t"),
                  chat.truncate_to_tokens(F.col("a"), 1000).alias("u"), count_tokens("b").alias("nb")).first()
    assert r.n > 0 and r.u == "Hello, world!"
    assert len(r.t) < len(df.first().b) and df.first().b.startswith(r.t)
    tt = spark.createDataFrame([(r.t,)], "t string").select(count_tokens("t")).first()[0]
    assert tt <= 60


def test_editblock_parse_goldens(spark):
    one = "main.py\n<<<<<<< SEARCH\nold\n=======\nnew\n>>>>>>> REPLACE\n"
    two = ("utils.py\n<<<<<<< SEARCH\na\n=======\nb\n>>>>>>> REPLACE\n\nutils.py\n<<<<<<< SEARCH\nc\n=======\nd\n"
           ">>>>>>> REPLACE\n")
    new = "new.py\n<<<<<<< SEARCH\n=======\nprint(1)\n>>>>>>> REPLACE\n"
    prose = "Just some prose, no edits here."
    r = spark.createDataFrame([(1, "editblock", one), (2, "editblock", two), (3, "editblock", new),
                               (4, "editblock", prose)], "response_id long, format string, response string")
    got = edits.parse_editblocks(r).collect()
    by = {}
    for e in got:
        by.setdefault(e.response_id, []).append(e)
    assert [e.path for e in by[1]] == ["main.py"]
    assert [e.path for e in by[2]] == ["utils.py", "utils.py"]
    assert by[3][0].is_new_file
    assert 4 not in by


def test_apply_goldens(spark):
    files = _files(spark, [("e.py", "def f():\n    return 0\n"), ("g.py", "x = 1")])
    ed = spark.createDataFrame([
        (1, 0, "editblock", "e.py", "    return 0\n", "    return 1\n"),
        (1, 1, "editblock", "n.py", "", "print('hi')\n"),
        (1, 2, "editblock", "missing.py", "a", "b"),
        (1, 3, "editblock", "g.py", "x = 1\n", "x = 2\n"),       # fuzzy: no final newline in file
        (1, 4, "editblock", "e.py", "absent", "zzz")],
        "response_id long, block_no int, format string, path string, original string, updated string")
    ed = ed.withColumn("repo_id", F.lit("r"))
    out = {(r.path, r.block_no): r for r in edits.apply_edits(files, ed).collect()}
    assert out[("e.py", 0)].status == "edited"
    assert out[("n.py", 1)].status == "created"
    assert out[("missing.py", 2)].status == "missing"
    assert out[("g.py", 3)].status == "edited" and "x = 2" in out[("g.py", 3)].content
    assert out[("e.py", 4)].status == "no_match" and "return 1" in out[("e.py", 4)].content


def test_plans_and_routing(spark):
    plans = spark.createDataFrame([
        (1, "T1", '[{"agent": "coder", "task": "Write code"}]'),
        (2, "T2", 'Here is the plan:\n[{"agent": "tester", "task": "Test it"}]\nDone'),
        (3, "T3", "not json at all"),
        (4, "T4", '[{"agent":"a","task":"1"},{"agent":"b","task":"2"},{"agent":"c","task":"3"}]')],
        "run_id long, task string, plan_output string")
    steps = agents.plan_steps(plans).collect()
    by = {}
    for s in steps:
        by.setdefault(s.run_id, []).append(s)
    assert [(s.agent, s.task) for s in by[1]] == [("coder", "Write code")]
    assert [s.agent for s in by[2]] == ["tester"]
    assert [(s.agent, s.task) for s in by[3]] == [("coder", "T3")]       # fallback step
    one = agents.plan_steps(plans.filter("run_id = 4"), max_agents=1).collect()
    assert len(one) == 1
    req = spark.createDataFrame([("nonexistent_agent",), ("coder",), ("planner",)], "agent string")
    assert [r.accepted for r in agents.route_single(req).collect()] == [False, True, False]


def test_run_report_goldens(spark):
    res = spark.createDataFrame([(1, 1, "coder", True, "Code done", ""), (1, 2, "reviewer", True, "Looks good", ""),
                                 (2, 1, "coder", False, "", "timeout")],
                                "run_id long, step int, agent_name string, success boolean, output string, error string")
    plans = spark.createDataFrame([(1, "Build it"), (2, "Fail it")], "run_id long, task string")
    rep = {r.run_id: r.report for r in agents.run_report(res, plans).collect()}
    assert "CODER" in rep[1] and "REVIEWER" in rep[1] and "Build it" in rep[1]
    assert "❌" in rep[2] and "timeout" in rep[2]
