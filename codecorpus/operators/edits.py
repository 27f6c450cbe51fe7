"""Edit extraction from replies and application to versioned file tables (E-1..E-9).

* Parsing is per reply, in one pass over the replies and without a shuffle:
  each format's blocks are an array expression (``functions/editexpr.py``).
* Edits and files meet on (repo_id, path). A chain of edits that depend on each
  other is a sorted array of bounded length, folded over the content in
  (response_id, block_no) order by an expression; chains begin at whole-file
  writes, and edits of files that are not there are answered by windows. Files
  that no edit touches are not joined.
* Whole-file writes need no fold: the last write per file wins (``max_by``).

Frames without a ``repo_id`` column are taken as one unnamed repo.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.functions import editexpr
from codecorpus.functions.text import split_lines, strip_py
from codecorpus.session import staged

KEY = ["repo_id", "path"]


def _with_repo(df: DataFrame) -> DataFrame:
    return df if "repo_id" in df.columns else df.withColumn("repo_id", F.lit(""))


def _edits(responses: DataFrame, blocks: Column) -> DataFrame:
    """One row a block; numbered within its reply."""
    return (_with_repo(responses)
            .select("response_id", "repo_id", "format", F.posexplode(blocks).alias("block_no", "_b"))
            .select(F.col("response_id").cast("long").alias("response_id"), F.col("block_no").cast("int").alias("block_no"),
                    "format", "repo_id", "_b.path", "_b.original", "_b.updated",
                    ((strip_py(F.col("_b.original")) == "") & (F.col("format") != "udiff")).alias("is_new_file")))


def parse_editblocks(responses: DataFrame) -> DataFrame:
    """E-1: SEARCH/REPLACE blocks of each reply."""
    return _edits(responses, editexpr.editblocks(F.col("response")))


def parse_whole(responses: DataFrame) -> DataFrame:
    """E-2: whole-file fenced blocks of each reply."""
    return _edits(responses, editexpr.whole_blocks(F.col("response")))


def parse_udiffs(responses: DataFrame) -> DataFrame:
    """E-3: each ```diff fence with a file header; the raw diff is kept as ``original``."""
    return _edits(responses, editexpr.udiff_blocks(F.col("response")))


def dispatch_format(responses: DataFrame) -> DataFrame:
    """E-8: each reply goes to its format's parser; 'architect' replies are parsed as
    editblock (the editor pass). Unknown formats produce no edits."""
    fmt, text = F.col("format"), F.col("response")
    return _edits(responses, F.when(fmt.isin("editblock", "architect"), editexpr.editblocks(text))
                  .when(fmt == "whole", editexpr.whole_blocks(text))
                  .when(fmt == "udiff", editexpr.udiff_blocks(text)))


# ---------------------------------------------------------------------------
# application
# ---------------------------------------------------------------------------
#: Edits that one fold takes; a longer chain goes on from a written table.
RUN = 4096
#: Statuses by their code in a fold; upper case where the content changed.
STATUS = {"e": "edited", "n": "no_match", "c": "created", "m": "missing"}
_SEGMENT = [*KEY, "_segment"]


def _ordered(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with their place: ``_there`` (the file exists), ``_last`` of its file, ``_missing`` (nothing to
    edit yet), ``_segment`` (a new one wherever the earlier content does not matter) and ``_run`` in it."""
    there = _with_repo(files).select(*KEY, F.lit(True).alias("_there"))
    e = _with_repo(edits).join(there, KEY, "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    w = Window.partitionBy(*KEY).orderBy("response_id", "block_no")
    writes = (F.col("format") == "whole") | ((F.col("format") != "udiff") & (F.coalesce(strip_py(F.col("original")), F.lit("")) == ""))
    creates = writes | (F.col("format") == "udiff")
    e = e.withColumns({"_writes": writes, "_creates": creates, "_last": F.lead("block_no").over(w).isNull(),
                       "_before": F.coalesce(F.sum(creates.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    nothing = ~F.col("_there") & (F.col("_before") == 0)
    e = e.withColumn("_missing", nothing & ~F.col("_creates"))
    starts = (F.col("_writes") | (nothing & F.col("_creates"))).cast("int")
    e = e.withColumn("_segment", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*_SEGMENT).orderBy("response_id", "block_no"))
    return (e.withColumn("_run", F.floor((place - 1) / F.lit(RUN)).cast("int"))
            .drop("_writes", "_creates", "_before"))


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """E-4/E-5/E-6 (+E-9 statuses): every file's edits in (response_id, block_no)
    order over its current content.

    Output: one row per edit with its status; the last row of each file
    carries the final content (NULL where no file came to be).

    A file's edits are cut into segments that begin where the earlier content
    does not matter (a whole write); segments are independent of each other.
    Edits of a file that does not exist yet need no content at all. Within a
    segment at most ``RUN`` edits are folded at once; longer ones go on from
    the written state of the run before.
    """
    placed = staged(_ordered(files, edits), "edits")
    longest = placed.filter("NOT _missing").agg(F.max("_run")).first()[0]
    one = F.struct("response_id", "block_no", "format", "original", "updated", "_last")
    missing = placed.filter("_missing").select(
        *KEY, "response_id", "block_no", "format", F.lit("missing").alias("status"), F.lit(False).alias("changed"),
        F.col("_last").alias("final"), F.lit(None).cast("string").alias("content"))
    out = [missing]
    current = _with_repo(files).select(*KEY, F.col("content").alias("_content"), F.lit(True).alias("_exists"), F.lit(0).alias("_segment"))
    for run in range((longest if longest is not None else -1) + 1):
        chains = (placed.filter((F.col("_run") == run) & ~F.col("_missing")).groupBy(*_SEGMENT)
                  .agg(F.sort_array(F.collect_list(one)).alias("_edits")))
        folded = chains.join(current, _SEGMENT, "left").select(*_SEGMENT, "_edits", _fold().alias("_end"))
        if run < longest:
            folded = staged(folded, f"edits-{run}")
        out.append(_statuses(folded))
        current = folded.select(*KEY, F.col("_end.content").alias("_content"), F.col("_end.exists").alias("_exists"), "_segment")
    return functools.reduce(DataFrame.unionByName, out)


def _fold() -> Column:
    """struct(content, exists, codes) after the edits of a run: a letter an edit."""
    start = F.struct(F.coalesce("_content", F.lit("")).alias("content"), F.coalesce("_exists", F.lit(False)).alias("exists"),
                     F.lit("").alias("codes"))

    def step(acc: Column, e: Column) -> Column:
        def after(new: Column) -> Column:
            letter = F.substring(new["status"], 1, 1)
            changed = (new["content"] != acc["content"]) | (new["status"] == "created")
            return F.struct(new["content"].alias("content"), new["exists"].alias("exists"),
                            F.concat(acc["codes"], F.when(changed, F.upper(letter)).otherwise(letter)).alias("codes"))
        return editexpr.let(editexpr.apply_edit(acc["content"], acc["exists"], e), after)

    return F.aggregate("_edits", start, step)


def _statuses(folded: DataFrame) -> DataFrame:
    code = F.substring(F.col("_end.codes"), F.col("_i") + 1, F.lit(1))
    names = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    rows = folded.select(*KEY, "_end", F.posexplode("_edits").alias("_i", "_e"))
    return rows.select(*KEY, "_e.response_id", "_e.block_no", "_e.format", F.element_at(names, F.lower(code)).alias("status"),
                       (code != F.lower(code)).alias("changed"), F.col("_e._last").alias("final"),
                       F.when(F.col("_e._last") & F.col("_end.exists"), F.col("_end.content")).alias("content"))


def fuzzy_replace(files: DataFrame, edits: DataFrame) -> DataFrame:
    """E-5: (repo_id, path, ..., replaced): each edit alone on its file's content, white space
    tolerated; NULL where nothing matches."""
    return (_with_repo(edits).join(_with_repo(files).select(*KEY, "content"), KEY)
            .withColumn("replaced", editexpr.fuzzy_replace(F.col("content"), F.col("original"), F.col("updated"))).drop("content"))


def apply_udiffs(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """E-6: ``files`` that have a diff (repo_id, path, diff), with the content after it; a missing file starts empty."""
    return (_with_repo(diffs).join(_with_repo(files).select(*KEY, "content"), KEY, "left")
            .withColumn("content", editexpr.apply_udiff(F.coalesce("content", F.lit("")), F.col("diff"))))


def hunk_offsets(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """One row a hunk: its 0-based start, the lines it takes and puts, how far the hunks applied
    before it have moved it, and whether it applies."""
    n = F.coalesce(F.size(split_lines(F.col("content"))), F.lit(0))
    met = _with_repo(diffs).join(_with_repo(files).select(*KEY, "content"), KEY, "left").withColumn("_n", n)
    return met.select(*KEY, F.posexplode(editexpr.hunk_moves(F.col("_n"), F.col("diff"))).alias("hunk_no", "_h")).select(
        *KEY, "hunk_no", "_h.*")


def apply_whole(files: DataFrame, edits: DataFrame) -> DataFrame:
    """E-7: whole-file writes; the last write per file wins, always overwriting.

    Returns the new file table. Only the keys of existing files are shuffled
    to meet the writes; the contents of untouched files stay where they are
    unless the writes are too many to broadcast."""
    f = _with_repo(files).select(*KEY, "content")
    last = (_with_repo(edits).groupBy(*KEY)
            .agg(F.max_by("updated", F.struct("response_id", "block_no")).alias("content")))
    kept = f.join(last.select(*KEY), KEY, "left_anti").withColumn("status", F.lit("kept"))
    there = f.select(*KEY, F.lit("updated").alias("_there"))
    written = (last.join(there, KEY, "left")
               .select(*KEY, "content", F.coalesce("_there", F.lit("created")).alias("status")))
    return kept.unionByName(written)


def edit_outcomes(outcomes: DataFrame) -> DataFrame:
    """E-9: counts per status and format, and the number of distinct paths edited."""
    return (outcomes.groupBy("format", "status")
            .agg(F.count(F.lit(1)).alias("n_edits"), F.countDistinct("repo_id", "path").alias("n_paths")))


def create_only(files: DataFrame, requests: DataFrame) -> DataFrame:
    """``create_only``: a create fails for a path that its repo already has
    (that any repo has, where the request names none)."""
    key = KEY if "repo_id" in requests.columns else ["path"]
    there = _with_repo(files).select(*key).distinct().withColumn("_there", F.lit(True))
    return (requests.join(there, key, "left")
            .withColumn("status", F.when(F.col("_there"), "exists").otherwise("created")).drop("_there"))


def edits_to_files(files: DataFrame, edits: DataFrame) -> DataFrame:
    """J-5: route each edit by its target: new file -> create, no file ->
    missing (rejected), otherwise apply."""
    f = _with_repo(files).select(*KEY).distinct().withColumn("_exists", F.lit(True))
    return (_with_repo(edits).join(f, KEY, "left")
            .withColumn("route", F.when(F.col("is_new_file"), "create")
                        .when(F.col("_exists").isNull(), "missing").otherwise("apply"))
            .drop("_exists"))


def carry_filename(responses: DataFrame) -> DataFrame:
    """For every reply line, the last filename line seen before it
    (native form of the editblock parser's filename tracking)."""
    from codecorpus.functions.text import lines_keepends, looks_like_path
    lines = responses.select("response_id", F.posexplode(lines_keepends(F.col("response"))).alias("_p", "line"))
    fname = F.when(~F.col("line").contains("<<<<<<< SEARCH"),
                   looks_like_path(F.regexp_replace(strip_py(F.col("line")), ":+$", "")))
    w = Window.partitionBy("response_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return (lines.select("response_id", (F.col("_p") + 1).cast("long").alias("ln"), fname.alias("fname"))
            .withColumn("current_file", F.last("fname", ignorenulls=True).over(w)))
