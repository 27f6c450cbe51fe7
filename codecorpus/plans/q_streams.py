"""Streaming queries (T1-T3): each runs its Structured Streaming job to the end of
the available input (``availableNow``) and reads back what the sink wrote, so the
result can be compared with the batch form of the same operator."""

from __future__ import annotations

from codecorpus import dims
from codecorpus.plans.q_corpus import tags_sql
from codecorpus.plans.registry import query
from codecorpus.streaming import streams

_SF: dict[int, str] = {}


def _sf_query(key, views, sql):
    """Like ``query`` but the builder needs ``sf_dir`` (streams read files)."""
    def deco(fn):
        from codecorpus.plans.registry import QUERIES, Query
        from codecorpus.sources.tables import register

        def build(spark, sf_dir):
            register(spark, sf_dir, views)
            return fn(spark, sf_dir)
        QUERIES[key] = Query(key, build, list(views), sql, (fn.__doc__ or "").strip())
        return fn
    return deco


# every glob is '*' and an ending
_GLOB_SQL = " OR ".join(f"suffix(path, '{g.removeprefix('*')}')" for g in dims.WATCH_GLOBS)


@_sf_query("stream_file_events", ["v_file_events"], sql=f"""
SELECT event_id, ts, path, event_type FROM v_file_events
WHERE event_type IN ('modified', 'created') AND ({_GLOB_SQL})""")
def q_stream_file_events(spark, sf_dir):
    """Watcher events streamed through the code-glob filter into an event log."""
    out = streams.stream_file_events(spark, sf_dir)
    return spark.read.parquet(out).select("event_id", "ts", "path", "event_type")


@_sf_query("stream_assemble_reply", ["v_chunks"], sql="""
SELECT response_id, coalesce(string_agg(delta, '' ORDER BY seq), '') AS text, CAST(count(delta) AS BIGINT) AS n_chunks
FROM v_chunks GROUP BY response_id""")
def q_stream_assemble(spark, sf_dir):
    """Reply chunks assembled per reply by a stateful stream (emitted at the end marker)."""
    out = streams.stream_assemble_reply(spark, sf_dir)
    return spark.read.parquet(out).filter("complete").select("response_id", "text", "n_chunks")


@_sf_query("stream_symbol_index", ["v_files"], sql=f"SELECT * FROM {tags_sql('v_files')} t")
def q_stream_symbols(spark, sf_dir):
    """Symbol index maintained from a stream of changed files (latest batch per path)."""
    out = streams.stream_symbol_index(spark, sf_dir)
    return streams.current_index(spark, out).select("repo_id", "path", "line", "type", "name")
