"""Streams that stop and go on, and drops of files with one name."""
from pyspark.sql import functions as F

from codecorpus.operators import chat
from codecorpus.sources.files import read_version, write_files
from codecorpus.streaming import streams

CHUNK = "response_id long, seq long, delta string, is_last boolean"


def _run(spark, folder, chunks, schema=CHUNK, timeout=None):
    spark.createDataFrame(chunks, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    s = spark.readStream.schema(schema).parquet(f"{folder}/in")
    if timeout is not None:
        s = s.withWatermark("ts", "0 seconds")
    streams.run_available_now(streams.assemble_replies(s, timeout), f"{folder}/out", f"{folder}/ckpt")
    return {tuple(r) for r in spark.read.schema(streams.CHUNK_OUT).parquet(f"{folder}/out").collect()}


def test_restart_with_chunks_delivered_again(spark, tmp_path):
    f = str(tmp_path)
    assert _run(spark, f, [(1, 0, "a", False), (1, 1, "b", False), (2, 0, None, True)]) == {(2, "", 0, True)}
    got = _run(spark, f, [(1, 1, "b", False), (1, 2, "c", True), (3, 1, "y", True)])
    assert got == {(2, "", 0, True), (1, "abc", 3, True)}
    assert _run(spark, f, [(3, 0, "x", False)]) == got | {(3, "xy", 2, True)}


def test_abandoned_reply_is_emitted(spark, tmp_path):
    from datetime import datetime, timedelta
    t, schema = datetime(2024, 1, 1), CHUNK + ", ts timestamp"
    f = str(tmp_path)
    assert _run(spark, f, [(1, 0, "a", False, t)], schema, 60_000) == set()
    _run(spark, f, [(2, 0, "b", False, t + timedelta(hours=1))], schema, 60_000)
    assert (1, "a", 1, False) in _run(spark, f, [(3, 0, "c", True, t + timedelta(hours=1))], schema, 60_000)


def test_drops_of_one_name(spark):
    files = spark.createDataFrame([(1, "r", "x/a.py", 0), (1, "r", "y/a.py", 1), (1, "r", "z/a.py", 2), (1, "r", "b.py", 3),
                                   (2, "r", "x/a.py", 0)], "conv_id int, repo_id string, path string, seq int")
    drops = spark.createDataFrame([(1, 1, "a.py"), (1, 2, "a.py"), (1, 3, "none.py"), (3, 1, "a.py")],
                                  "conv_id int, drop_id int, drop_path string")
    left = chat.drop_files(files, drops)
    assert left.columns == files.columns
    assert {(r.conv_id, r.path) for r in left.collect()} == {(1, "z/a.py"), (1, "b.py"), (2, "x/a.py")}


def test_versions_keep_column_types(spark, tmp_path):
    df = spark.createDataFrame([("007", "a.py", "x"), ("7", "b.py", None)], "repo_id string, path string, content string")
    write_files(df, str(tmp_path), 1)
    back = read_version(spark, str(tmp_path), 1)
    assert back.schema == df.schema and back.exceptAll(df).count() == 0 and back.count() == 2
    assert back.filter(F.col("repo_id") == "007").count() == 1


def test_index_of_many_batches_equals_the_batch_query(spark, tmp_path):
    """50 batches of changed files: the same tags as those of each path's last version, from few runs."""
    import random

    from codecorpus.operators.corpus import extract_symbols
    rng, last = random.Random(2), {}
    schema = "repo_id string, path string, content string"
    src, out = str(tmp_path / "in"), str(tmp_path / "index")
    for b in range(50):
        rows = {f"f{rng.randrange(12)}.{rng.choice(['py', 'md'])}": rng.choice(["", f"def f{b}():\nclass C{b}:\n"]) for _ in range(3)}
        last |= rows
        spark.createDataFrame([("r", p, c) for p, c in rows.items()], schema).coalesce(1).write.mode("append").parquet(src)
        # two starts in the midst of the batches
        if b in (20, 49):
            s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            streams.index_symbols(s, out, str(tmp_path / "ckpt"))
    want = extract_symbols(spark.createDataFrame([("r", p, c) for p, c in last.items()], schema))
    assert sorted(map(tuple, streams.current_index(spark, out).collect())) == sorted(map(tuple, want.collect()))
    covered = [b for level, i in streams.live_runs(50) for b in range(i * 4 ** level, (i + 1) * 4 ** level)]
    assert sorted(covered) == list(range(50)) and len(streams.live_runs(50)) <= 3 * 3


def test_tables_in_folders_are_streamed_whole(spark, tmp_path):
    """A table of several files gives the rows of the same table in one file."""
    import __spark_entry__ as entry
    rows = {"conversations": ([(c, t, "assistant" if t % 2 else "user", f"w{c} x{t} y") for c in range(1, 9) for t in range(4)],
                              "conv_id long, turn int, role string, text string"),
            "documents": ([(d, f"src{d % 2}", "en", "some text") for d in range(40)],
                          "doc_id long, source string, lang string, text string")}
    for name, (data, schema) in rows.items():
        df = spark.createDataFrame(data, schema)
        df.repartition(3).write.parquet(f"{tmp_path}/many/{name}.parquet")
        (tmp_path / "one").mkdir(exist_ok=True)
        df.toPandas().to_parquet(f"{tmp_path}/one/{name}.parquet", index=False)
    for key, n in (("stream_assemble_reply", 16), ("stream_symbol_index", None)):
        run = entry.queries()[key]
        many, one = (sorted(map(tuple, run(spark, f"{tmp_path}/{d}").collect())) for d in ("many", "one"))
        assert many == one and len(many) == (n or len(many)) and many
