"""Snapshot diff, commit and status queries (J-9, S8, A8, F8, S14, read_commit_log, K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions.patterns import SPACE_BODY
from codecorpus.operators import changes
from codecorpus.plans.registry import query

_STATUS_SQL = """(SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.path, b.path) AS path,
   CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted'
        WHEN md5(a.content) <> md5(b.content) THEN 'changed' ELSE 'unchanged' END AS status
 FROM v_files a FULL OUTER JOIN v_snapshot_b b ON a.repo_id = b.repo_id AND a.path = b.path)"""


@query("snapshot_changes", ["v_files", "v_snapshot_b"], sql=f"SELECT * FROM {_STATUS_SQL} s")
def q_snapshot_changes(spark):
    """J-9: added / deleted / changed / unchanged paths between two snapshots."""
    return changes.snapshot_changes(spark.table("v_files"), spark.table("v_snapshot_b"))


@query("unified_diff", ["v_files", "v_snapshot_b"])
def q_unified_diff(spark):
    """Unified diffs of every path that differs between the snapshots (difflib per row)."""
    d = changes.unified_diff(spark.table("v_files"), spark.table("v_snapshot_b"))
    return d.select("repo_id", "path", F.length("diff").alias("diff_chars"), F.md5("diff").alias("diff_md5"))


@query("commit_summary", ["v_files", "v_snapshot_b"], sql=f"""
SELECT repo_id, count(*) AS n_changed,
  '{changes.COMMIT_ATTRIBUTION}: Edit ' || string_agg(CASE WHEN rn <= 3 THEN string_split(path, '/')[-1] END, ', ' ORDER BY rn)
  || CASE WHEN count(*) > 3 THEN ' (+' || CAST(count(*) - 3 AS VARCHAR) || ' more)' ELSE '' END AS message
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rn FROM {_STATUS_SQL} s
      WHERE status <> 'unchanged') c GROUP BY repo_id""")
def q_commit_summary(spark):
    """Auto-commit message per repo from its changed paths."""
    st = changes.snapshot_changes(spark.table("v_files"), spark.table("v_snapshot_b"))
    return changes.commit_summary(st.filter(F.col("status") != "unchanged"))


@query("dirty_paths", ["v_status_lines"], sql=f"""
SELECT line, string_split(regexp_replace(substring(line, 4), '^[{SPACE_BODY}]+|[{SPACE_BODY}]+$', '', 'g'), ' -> ')[-1] AS path
FROM v_status_lines WHERE length(line) >= 3""")
def q_dirty_paths(spark):
    """F8: paths named by porcelain status lines (renames -> new path)."""
    return changes.dirty_paths(spark.table("v_status_lines"))


_LOG_RX = r"^([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"


@query("read_commit_log", ["v_commit_lines"], sql=f"""
SELECT regexp_extract(line, '(?s){_LOG_RX}', 1) AS hash, regexp_extract(line, '(?s){_LOG_RX}', 2) AS short_hash,
  regexp_extract(line, '(?s){_LOG_RX}', 3) AS subject, regexp_extract(line, '(?s){_LOG_RX}', 4) AS author,
  regexp_extract(line, '(?s){_LOG_RX}', 5) AS date
FROM v_commit_lines WHERE regexp_matches(line, '(?s){_LOG_RX}')""")
def q_read_commit_log(spark):
    """read_commit_log: every log line parsed (at most 4 splits, exactly 5 parts)."""
    return changes.read_commit_log(spark.table("v_commit_lines"))


@query("recent_commits", ["v_commit_lines"], sql=f"""
SELECT hash, author, date, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY author ORDER BY date DESC, hash DESC) AS rank FROM (
    SELECT regexp_extract(line, '(?s){_LOG_RX}', 1) AS hash, regexp_extract(line, '(?s){_LOG_RX}', 4) AS author,
           regexp_extract(line, '(?s){_LOG_RX}', 5) AS date FROM v_commit_lines WHERE regexp_matches(line, '(?s){_LOG_RX}')) c) r
WHERE rank <= 10""")
def q_recent_commits(spark):
    """K5: the last 10 commits of every author (the log's -n limit, per author)."""
    c = changes.recent_commits(changes.read_commit_log(spark.table("v_commit_lines")), 10)
    return c.select("hash", "author", "date", "rank")


@query("recent_repo_commits", ["v_repo_commits"], sql=f"""
SELECT repo_id, hash, date, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY date DESC, hash DESC) AS rank FROM (
    SELECT repo_id, regexp_extract(line, '(?s){_LOG_RX}', 1) AS hash, regexp_extract(line, '(?s){_LOG_RX}', 5) AS date
    FROM v_repo_commits WHERE regexp_matches(line, '(?s){_LOG_RX}')) c) r
WHERE rank <= 10""")
def q_recent_repo_commits(spark):
    """K5: the last 10 commits of every repo (the log's -n limit)."""
    c = changes.recent_commits(changes.read_commit_log(spark.table("v_repo_commits")), 10, "repo_id")
    return c.select("repo_id", "hash", "date", "rank")


_OUT = """'On branch main' || chr(10) || CASE WHEN o_orderkey % 9 = 0 THEN 'nothing to commit'
  ELSE '[' || CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE 'feat/x' END || ' c' || CAST(o_orderkey AS STRING) || '] fix '
  || CAST(o_custkey AS STRING) || chr(10) || ' 1 file changed' END"""


@query("commit_hash_from_output", ["orders"], sql=f"""
SELECT o_orderkey, CASE WHEN regexp_matches(out, '(?m)^\\[') THEN
  regexp_replace(string_split(regexp_replace(regexp_extract(out, '(?m)^(\\[.*)$', 1), '^\\s+', ''), ' ')[2], '\\]+$', '')
  END AS commit_hash
FROM (SELECT o_orderkey, {_OUT.replace('STRING', 'VARCHAR')} AS out FROM orders) o""")
def q_commit_hash(spark):
    """Commit hash read from commit command output, one output per order row."""
    o = spark.table("orders").select("o_orderkey", F.expr(_OUT).alias("output"))
    return changes.commit_hash_from_output(o).select("o_orderkey", "commit_hash")
