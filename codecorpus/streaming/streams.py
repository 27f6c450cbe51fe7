"""Structured Streaming jobs (T1 file events, T2 reply assembly, T3 symbol index).

* T1 is stateless: filter watcher events (modified/created, code globs on
  the basename) and hand each micro-batch to a callback (``foreachBatch``);
  the default callback appends to a Parquet event log (idempotent per
  batch id, so a restarted query does not duplicate rows).
* T2 is stateful per ``response_id`` with ``transformWithStateInPandas``: chunks
  are rows of a list state, so a batch writes what it brings and not the reply
  anew; the reply is emitted (and its state dropped) when all its chunks have
  come, so state is bounded by the replies still open.
  With an event-time column and a timeout, abandoned replies are flushed by
  the watermark; a processing-time timeout is not used because it makes
  every trigger schedule another batch (``availableNow`` would never end).
* T3 runs the symbol extractor on a stream of changed files, a run of rows a
  batch; runs are merged level by level, so the current index ("latest batch
  per path") is read from a number of runs that grows with the logarithm of
  the batches.

Checkpoint and sink live in the folder ``run``, which a later call with the
same folder resumes; by default a fresh one under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codecorpus import dims
from codecorpus.functions.patterns import fnmatch_regex
from codecorpus.operators.corpus import SYMBOLS, file_symbols
from codecorpus.session import checkpoint_path, spread
from codecorpus.sources import tables


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table read as a file stream (new files = new micro-batches).

    A table is one file or a folder of files. A stream reads folders only, so the
    one file is picked from the folder it lies in."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1000)
    if [f.rsplit("/", 1)[-1] for f in table.inputFiles()] == [f"{name}.parquet"]:
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(path)


def _view_on(spark: SparkSession, stream: DataFrame, view: str, base: str) -> DataFrame:
    """Apply a derived view's SQL to a streaming source table."""
    name = f"{base}_stream_{uuid.uuid4().hex[:8]}"
    stream.createOrReplaceTempView(name)
    return spark.sql(tables.VIEWS[view].replace(f"FROM {base}", f"FROM {name}"))


def watch_filter(events: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """modified/created events on paths whose basename matches a code glob."""
    name = F.element_at(F.split("path", "/"), -1)
    hit = F.lit(False)
    for g in globs or dims.WATCH_GLOBS:
        hit = hit | name.rlike(fnmatch_regex(g))
    return events.filter(F.col("event_type").isin("modified", "created") & hit)


def run_available_now(df: DataFrame, out_dir: str, ckpt: str, fmt: str = "parquet",
                      mode: str = "append") -> None:
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start(out_dir))
    q.awaitTermination()


def stream_file_events(spark: SparkSession, sf_dir: str, callback=None, run: str | None = None) -> str:
    """T1 end to end; returns the event-log folder the callback appended to."""
    run = run or checkpoint_path(spark, f"t1-{uuid.uuid4().hex}")
    ev = watch_filter(_view_on(spark, table_stream(spark, sf_dir, "events"), "v_file_events", "events"))
    out = run + "/events"

    def sink(batch: DataFrame, batch_id: int) -> None:
        if callback is not None:
            callback(batch, batch_id)
        # one folder per batch id: a replayed batch overwrites, never duplicates
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (ev.writeStream.foreachBatch(sink).option("checkpointLocation", run + "/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


# ---------------------------------------------------------------------------
# T2
# ---------------------------------------------------------------------------
CHUNK_OUT = T.StructType([T.StructField("response_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("n_chunks", T.LongType()), T.StructField("complete", T.BooleanType())])
#: Keeps state as keyed rows, of which a batch writes only those that it changes.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply chunks (v_chunks) from the conversations stream, with an end
    marker on each reply's last chunk (a whole reply arrives in one row, so
    the marker is known when it is exploded)."""
    conv = table_stream(spark, sf_dir, "conversations")
    words = conv.filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("response_id"),
        F.size(F.split("text", " ")).alias("_n"), F.posexplode(F.split("text", " ")).alias("seq", "delta"))
    return words.select("response_id", F.col("seq").cast("long").alias("seq"),
                        F.when(F.col("seq") % 11 == 10, F.lit(None)).otherwise(F.col("delta")).alias("delta"),
                        (F.col("seq") == F.col("_n") - 1).alias("is_last"))


def _reply(response_id: int, parts: dict, complete: bool):
    import pandas as pd
    return pd.DataFrame([(response_id, "".join(parts[q] or "" for q in sorted(parts)),
                          sum(d is not None for d in parts.values()), complete)],
                        columns=["response_id", "text", "n_chunks", "complete"])


class _Assembler(StatefulProcessor):
    """An open reply's chunks as rows of its state: a batch adds those that it brings, and only when there
    are enough of them are they read. One delta a seq counts, so a chunk delivered again changes nothing."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "seq long, delta string")
        self.meta = handle.getValueState("meta", "n long, last long, timer long")

    def _stored(self) -> dict:
        parts: dict = {}
        for seq, delta in self.parts.get():
            parts.setdefault(seq, delta)
        return parts

    def _forget(self, timer: int | None) -> None:
        self.parts.clear()
        self.meta.clear()
        if timer is not None:
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues):
        new, last, newest = {}, None, 0
        for pdf in rows:
            for q, d in zip(pdf["seq"], pdf["delta"], strict=True):
                new.setdefault(int(q), d if isinstance(d, str) else None)
            ends = pdf.loc[pdf["is_last"], "seq"]
            if len(ends):
                last = int(ends.max())
            if self.timeout_ms is not None:
                newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
        held = self.meta.get() if self.meta.exists() else None
        n, ended, timer = held if held is not None else (0, None, None)
        last = ended if last is None else last
        if last is not None and n + len(new) > last:
            parts = self._stored() if n else {}
            for q, d in new.items():
                parts.setdefault(q, d)
            if len(parts) > last:
                if held is not None:
                    self._forget(timer)
                yield _reply(key[0], parts, True)
                return
        self.parts.appendList(list(new.items()))
        if self.timeout_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = max(newest + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
        self.meta.update((n + len(new), last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        parts = self._stored()
        self._forget(None)
        yield _reply(key[0], parts, False)

    def close(self) -> None:
        pass


def assemble_replies(chunks: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """(response_id, text, n_chunks, complete) of a stream of (response_id,
    seq, delta, is_last), seq from 0.

    A reply is emitted when all of its chunks have come. With ``timeout_ms``
    the stream also has an event time ``ts`` with a watermark, and a reply
    without a new chunk for that long is emitted as it is (``complete`` false)
    and its state freed. Without it, an abandoned reply stays in the state.
    The session's state store is set to ``STATE_STORE``.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return chunks.groupBy("response_id").transformWithStateInPandas(
        _Assembler(timeout_ms), CHUNK_OUT, "Append", "None" if timeout_ms is None else "EventTime")


def stream_assemble_reply(spark: SparkSession, sf_dir: str, run: str | None = None) -> str:
    """T2 end to end; returns the folder of assembled replies."""
    run = run or checkpoint_path(spark, f"t2-{uuid.uuid4().hex}")
    run_available_now(assemble_replies(chunk_stream(spark, sf_dir)), run + "/out", run + "/ckpt")
    return run + "/out"


# ---------------------------------------------------------------------------
# T3
# ---------------------------------------------------------------------------
#: So many runs of one level are merged into one of the next.
FAN = 4
RUN_SCHEMA = f"repo_id string, path string, batch long, symbols {SYMBOLS}"


def live_runs(batches: int) -> list[tuple[int, int]]:
    """(level, number) of the runs that hold ``batches`` batches: the digits of a counter to the base ``FAN``."""
    out, level, size = [], 0, 1
    while size <= batches:
        first = batches // (size * FAN) * FAN
        out += [(level, i) for i in range(first, batches // size)]
        level, size = level + 1, size * FAN
    return out


def _run_path(out: str, level: int, number: int) -> str:
    return f"{out}/level={level}/run={number}"


def _latest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The newest row of every path in some runs."""
    rows = spark.read.schema(RUN_SCHEMA).parquet(*paths)
    return rows.groupBy("repo_id", "path").agg(F.max_by(F.struct("batch", "symbols"), "batch").alias("_v")).select(
        "repo_id", "path", "_v.batch", "_v.symbols")


def stream_symbol_index(spark: SparkSession, sf_dir: str, run: str | None = None) -> str:
    """S1 on a stream of changed files; returns the index folder."""
    run = run or checkpoint_path(spark, f"t3-{uuid.uuid4().hex}")
    files = _view_on(spark, table_stream(spark, sf_dir, "documents"), "v_files", "documents")
    index_symbols(files, run + "/tags", run + "/ckpt")
    return run + "/tags"


def index_symbols(files: DataFrame, out: str, ckpt: str) -> None:
    """Keeps the index of a stream of (repo_id, path, content) until its input ends.

    A batch is computed once and written as a run of one row a file (files without
    symbols too: they replace older ones). ``FAN`` runs are merged into one, and so on, so an
    index of n batches is read from a few runs a level, of which there are log n. A batch that is
    repeated writes the same folders again; the two heads take turns to name the batches done.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # of several rows of a path within a batch any one is taken: their order is not known
        symbols = file_symbols(spread(batch), all_files=True)
        (symbols.select("repo_id", "path", F.lit(batch_id).cast("long").alias("batch"), "symbols")
         .write.mode("overwrite").parquet(_run_path(out, 0, batch_id)))
        level, done = 1, batch_id + 1
        while done % FAN ** level == 0:
            number = done // FAN ** level - 1
            parts = [_run_path(out, level - 1, number * FAN + i) for i in range(FAN)]
            _latest(spark, parts).write.mode("overwrite").parquet(_run_path(out, level, number))
            level += 1
        spark.range(1).select(F.lit(done).cast("long").alias("done")).write.mode("overwrite").parquet(f"{out}/head/slot={done % 2}")

    q = files.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def current_index(spark: SparkSession, index_dir: str) -> DataFrame:
    """Latest-wins view of the index: the tags of each path's newest batch."""
    done = spark.read.schema("done long").parquet(index_dir + "/head").agg(F.max("done")).first()[0]
    rows = _latest(spark, [_run_path(index_dir, *r) for r in live_runs(done)])
    return rows.select("repo_id", "path", F.explode("symbols").alias("_s")).select("repo_id", "path", "_s.*")
