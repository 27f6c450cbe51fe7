"""Snapshot diffs, commit log and status lines (J-9, S8, A8, F8, S14, read_commit_log).

Two snapshots of a file table are compared with one full outer join on
(repo_id, path) over content hashes -- the join shuffles 16-byte digests,
not contents. Only changed rows are re-joined to both contents and diffed
(difflib in ``mapInPandas``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecorpus.functions.text import basename, strip_py
from codecorpus.session import staged

COMMIT_ATTRIBUTION = "codecorpus"


def snapshot_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """J-9: status per (repo_id, path): added / deleted / changed / unchanged."""
    ha = a.select("repo_id", "path", F.md5("content").alias("ha"))
    hb = b.select("repo_id", "path", F.md5("content").alias("hb"))
    j = ha.join(hb, ["repo_id", "path"], "full_outer")
    return j.select("repo_id", "path",
                    F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "deleted")
                     .when(F.col("ha") != F.col("hb"), "changed").otherwise("unchanged").alias("status"))


DIFF_SCHEMA = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("path", T.StringType()),
                            T.StructField("diff", T.StringType())])


def _diff_batches(it):
    import difflib

    import pandas as pd
    for pdf in it:
        out = []
        for rid, path, old, new in zip(pdf["repo_id"], pdf["path"], pdf["old"], pdf["new"]):
            a = (old or "").splitlines(keepends=True)
            b = (new or "").splitlines(keepends=True)
            # lineterm="" with kept line ends: header lines are glued, as the
            # assistant's own diff helper produces them
            text = "".join(difflib.unified_diff(a, b, fromfile=f"a/{path}", tofile=f"b/{path}", lineterm=""))
            out.append((rid, path, text))
        yield pd.DataFrame(out, columns=["repo_id", "path", "diff"])


def unified_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Unified diff (3 context lines) of every changed, added or deleted path."""
    ch = snapshot_changes(a, b).filter(F.col("status") != "unchanged").select("repo_id", "path")
    both = (ch.join(a.select("repo_id", "path", F.col("content").alias("old")), ["repo_id", "path"], "left")
              .join(b.select("repo_id", "path", F.col("content").alias("new")), ["repo_id", "path"], "left"))
    return both.mapInPandas(_diff_batches, DIFF_SCHEMA)


def commit_summary(changed: DataFrame, attribution: str = COMMIT_ATTRIBUTION) -> DataFrame:
    """Per repo ``<attribution>: Edit a, b, c (+N more)`` from the first
    three changed basenames (path order); no row when nothing changed.
    Only the first three names are kept per repo (group limit), plus a count; the
    changed paths are computed once for both."""
    changed = staged(changed.select("repo_id", "path"), "changed")
    w = Window.partitionBy("repo_id").orderBy("path")
    first3 = (changed.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 3")
              .groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                  F.struct("_rn", basename(F.col("path")).alias("n")))), lambda x: x["n"]), ", ").alias("_names")))
    n = changed.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_changed"))
    msg = F.concat(F.lit(attribution + ": Edit "), F.col("_names"),
                   F.when(F.col("n_changed") > 3, F.format_string(" (+%d more)", F.col("n_changed") - 3))
                    .otherwise(F.lit("")))
    return first3.join(n, "repo_id").select("repo_id", "n_changed", msg.alias("message"))


def dirty_paths(status_lines: DataFrame) -> DataFrame:
    """F8: porcelain line -> path (lines shorter than 3 skipped; 3-char
    prefix dropped; text after the last ' -> ' for renames)."""
    p = strip_py(F.substring(F.col("line"), 4, 1 << 30))
    return (status_lines.filter(F.length("line") >= 3)
            .select("line", F.element_at(F.split(p, " -> "), -1).alias("path")))


def read_commit_log(lines: DataFrame) -> DataFrame:
    """``hash|short|subject|author|date`` split at most 4 times; only rows
    with exactly five parts. A '|' in the subject shifts author and date.
    Other columns (the log's repo) are kept."""
    parts = F.split(F.col("line"), r"\|", 5)
    others = [c for c in lines.columns if c != "line"]
    return (lines.withColumn("_p", parts).filter(F.size("_p") == 5)
            .select(*others, F.col("_p")[0].alias("hash"), F.col("_p")[1].alias("short_hash"),
                    F.col("_p")[2].alias("subject"), F.col("_p")[3].alias("author"), F.col("_p")[4].alias("date")))


def recent_commits(commits: DataFrame, n: int = 10, by: str = "author") -> DataFrame:
    """K5: last ``n`` commits per author, or per repo (newest date first, hash as tie-break)."""
    w = Window.partitionBy(by).orderBy(F.col("date").desc(), F.col("hash").desc())
    return commits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def commit_hash_from_output(text: DataFrame) -> DataFrame:
    """Second token of the first output line starting '[', ']' stripped."""
    first = F.regexp_extract(F.col("output"), r"(?m)^(\[.*)$", 1)
    tok = F.element_at(F.split(F.regexp_replace(first, r"^\s+", ""), r"\s+"), 2)
    return text.withColumn("commit_hash", F.when(first != "", F.regexp_replace(tok, r"\]+$", "")))
