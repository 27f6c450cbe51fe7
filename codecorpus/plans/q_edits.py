"""Edit extraction and application queries (E-1..E-9, S5-S7, create_only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions.patterns import LINE_BREAK, LINE_TERM_CLASS, SPACE_BODY, py_regex
from codecorpus.functions.text import lines_keepends, looks_like_path, normalise_ws, replace_first
from codecorpus.operators import edits
from codecorpus.plans.registry import query
from codecorpus.session import spread

_LT = LINE_TERM_CLASS[1:-1]
_KEEP = "[^" + _LT + "]*" + LINE_BREAK + "|[^" + _LT + "]+"
_PATH_RX = py_regex(r"^[\w./\\-]+\.\w{1,10}$")


def d_path_candidate(line: str) -> str:
    """DuckDB spelling of the editblock filename test on one line."""
    t = (f"regexp_replace(rtrim(regexp_replace({line}, '^[{SPACE_BODY}]+|[{SPACE_BODY}]+$', '', 'g'), ':'), "
         f"'^[`''\"]+|[`''\"]+$', '', 'g')")
    return (f"(CASE WHEN {t} <> '' AND NOT contains({t}, ' ') AND contains({t}, '.') "
            f"AND regexp_matches({t}, '{_PATH_RX}') THEN {t} END)")


# well-formed SEARCH/REPLACE parse in SQL: explode lines, carry the last
# filename line forward, and cut each block at the next divider / end marker
_EB_SQL = f"""
WITH r AS (SELECT response_id, repo_id, format, response FROM v_responses WHERE format = 'editblock'),
l AS (SELECT response_id, repo_id, format, unnest(regexp_extract_all(response, '{_KEEP}')) AS line,
             unnest(generate_series(1, len(regexp_extract_all(response, '{_KEEP}')))) AS ln FROM r),
k AS (SELECT *, contains(line, '<<<<<<< SEARCH') AS is_s, contains(line, '=======') AS is_d,
             contains(line, '>>>>>>> REPLACE') AS is_r, {d_path_candidate('line')} AS fname FROM l),
s AS (SELECT k.response_id, k.repo_id, k.format, k.ln AS s_ln,
        (SELECT max_by(x.fname, x.ln) FROM k x WHERE x.response_id = k.response_id AND x.ln < k.ln
           AND x.fname IS NOT NULL AND NOT x.is_s) AS path,
        coalesce((SELECT min(x.ln) FROM k x WHERE x.response_id = k.response_id AND x.ln > k.ln AND x.is_d), 1000000000) AS d_ln
      FROM k WHERE k.is_s),
b AS (SELECT s.*, coalesce((SELECT min(x.ln) FROM k x WHERE x.response_id = s.response_id AND x.ln > s.d_ln AND x.is_r),
        1000000000) AS r_ln FROM s)
SELECT b.response_id, CAST(row_number() OVER (PARTITION BY b.response_id ORDER BY b.s_ln) - 1 AS INTEGER) AS block_no,
  b.format, b.repo_id, b.path,
  coalesce((SELECT string_agg(x.line, '' ORDER BY x.ln) FROM k x WHERE x.response_id = b.response_id
            AND x.ln > b.s_ln AND x.ln < b.d_ln), '') AS original,
  coalesce((SELECT string_agg(x.line, '' ORDER BY x.ln) FROM k x WHERE x.response_id = b.response_id
            AND x.ln > b.d_ln AND x.ln < b.r_ln), '') AS updated
FROM b WHERE b.path IS NOT NULL"""


@query("parse_editblocks", ["v_responses"], sql=f"""
SELECT response_id, block_no, format, path, original, updated,
  regexp_replace(original, '^[{SPACE_BODY}]+|[{SPACE_BODY}]+$', '', 'g') = '' AS is_new_file
FROM ({_EB_SQL}) e""")
def q_parse_editblocks(spark):
    """E-1: SEARCH/REPLACE blocks of every editblock reply."""
    r = spark.table("v_responses").filter(F.col("format") == "editblock")
    return edits.parse_editblocks(r).drop("repo_id")


_WHOLE_SQL = f"""(SELECT response_id, repo_id, format, 0 AS block_no,
   regexp_extract(response, '^```[\\p{{L}}\\p{{N}}_]*[{SPACE_BODY}]*\\n#[{SPACE_BODY}]*([^\\n]+?\\.[\\p{{L}}\\p{{N}}_]+)[{SPACE_BODY}]*\\n', 1) AS path,
   regexp_extract(response, '(?s)^```[^\\n]*\\n#[^\\n]*\\n(.*?)```', 1) AS updated
 FROM v_responses WHERE format = 'whole')"""


@query("parse_whole", ["v_responses"], sql=f"""
SELECT response_id, block_no, format, path, '' AS original, updated, true AS is_new_file FROM {_WHOLE_SQL} w""")
def q_parse_whole(spark):
    """E-2: whole-file blocks of every 'whole' reply."""
    return edits.parse_whole(spark.table("v_responses").filter(F.col("format") == "whole")).drop("repo_id")


_DUCK_DIFF_HEADER = "(?m)" + py_regex(r"^--- (?:a/)?(.+?)\s*\n\+\+\+ (?:b/)?(.+?)\s*$")


_UDIFF_SQL = f"""
WITH d AS (SELECT response_id, format, unnest(regexp_extract_all(response, '(?s)```diff\\n(.*?)```', 1)) AS diff,
                  unnest(generate_series(1, len(regexp_extract_all(response, '(?s)```diff\\n(.*?)```', 1)))) AS n
           FROM v_responses WHERE format = 'udiff')
SELECT response_id, CAST(row_number() OVER (PARTITION BY response_id ORDER BY n) - 1 AS INTEGER) AS block_no, format,
  regexp_replace(regexp_extract(diff, '{_DUCK_DIFF_HEADER}', 2), '^[{SPACE_BODY}]+|[{SPACE_BODY}]+$', '', 'g') AS path,
  diff AS original, '' AS updated, false AS is_new_file
FROM d WHERE regexp_matches(diff, '{_DUCK_DIFF_HEADER}')"""


@query("parse_udiffs", ["v_responses"], sql=_UDIFF_SQL)
def q_parse_udiffs(spark):
    """E-3: diff fences of every udiff reply; the '+++' header names the file."""
    return edits.parse_udiffs(spark.table("v_responses").filter(F.col("format") == "udiff")).drop("repo_id")


@query("dispatch_format", ["v_responses"], sql=f"""
SELECT response_id, block_no, format, path, original, updated,
  regexp_replace(original, '^[{SPACE_BODY}]+|[{SPACE_BODY}]+$', '', 'g') = '' AS is_new_file FROM ({_EB_SQL}) e
UNION ALL SELECT response_id, block_no, format, path, '', updated, true FROM {_WHOLE_SQL} w
UNION ALL SELECT response_id, block_no, format, path, original, updated, is_new_file FROM ({_UDIFF_SQL}) u""")
def q_dispatch(spark):
    """E-8: every reply routed to its format's parser (architect -> editblock), in one pass."""
    return edits.dispatch_format(spark.table("v_responses")).drop("repo_id")


# ---------------------------------------------------------------- application, spelled out for the oracle
def d_lines(x: str, keep: bool = False) -> str:
    """splitlines() of a text as a DuckDB list."""
    if keep:
        return f"regexp_extract_all({x}, '{_KEEP}')"
    sp = f"string_split_regex({x}, '{LINE_BREAK}')"
    return f"{sp}[1:len({sp}) - CASE WHEN {sp}[-1] = '' THEN 1 ELSE 0 END]"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE_BODY}]+|[{SPACE_BODY}]+$', '', 'g')"


def d_squeeze(x: str) -> str:
    return f"regexp_replace({d_strip(x)}, '[ \\t]+', ' ', 'g')"


def d_replace_first(c: str, o: str, u: str) -> str:
    return (f"(CASE WHEN position({o} IN {c}) > 0 THEN substring({c}, 1, position({o} IN {c}) - 1) || {u} "
            f"|| substring({c}, position({o} IN {c}) + length({o})) END)")


def d_fuzzy(c: str, o: str, u: str) -> str:
    """Up to blanks, else the first run of lines that are equal stripped; line lists are built once by a lateral list."""
    have, bare, want = d_lines(c), *(f"list_transform({d_lines(x)}, lambda y: {d_strip('y')})" for x in (c, o))
    at = f"list_filter(range(1, len({have}) - len({want}) + 2), lambda i: ({bare})[i:i + len({want}) - 1] = {want})[1]"
    by_lines = (f"(SELECT array_to_string(h[1:p - 1] || {d_lines(u)} || h[p + w:], chr(10)) || CASE WHEN suffix({c}, chr(10)) THEN chr(10) ELSE '' END "
                f"FROM (SELECT {have} AS h, {at} AS p, len({want}) AS w) WHERE p IS NOT NULL)")
    return (f"(CASE WHEN contains({d_squeeze(c)}, {d_squeeze(o)}) THEN coalesce({d_replace_first(c, d_strip(o), u)}, {c}) "
            f"ELSE {by_lines} END)")


@query("fuzzy_replace", ["v_files", "v_fuzzy"], sql=f"""
SELECT doc_id, md5(replaced) AS replaced_md5, replaced <> content AS changed
FROM (SELECT z.doc_id, f.content, {d_fuzzy('f.content', 'z.original', 'z.updated')} AS replaced
      FROM v_fuzzy z JOIN v_files f ON f.repo_id = z.repo_id AND f.path = z.path) r""")
def q_fuzzy_replace(spark):
    """E-5: white-space tolerant replacement over every file: by lines, literally, without effect, without a match."""
    files = spread(spark.table("v_files").select("repo_id", "path", "content"))
    r = edits.fuzzy_replace(files, spark.table("v_fuzzy")).alias("r")
    return (r.join(files.alias("f"), edits.KEY)
            .select("doc_id", F.md5("replaced").alias("replaced_md5"), (F.col("replaced") != F.col("f.content")).alias("changed")))


# hunks in order, each on the lines that the one before has left; a list slice clips as a position before the first line does
_HUNKS_SQL = f"""
d AS (SELECT d.doc_id, {d_lines('f.content', keep=True)} AS rows, {d_lines('d.diff')} AS dl
      FROM v_diffs d JOIN v_files f ON f.repo_id = d.repo_id AND f.path = d.path),
x AS (SELECT doc_id, unnest(range(1, len(dl) + 1)) AS ln, unnest(dl) AS line FROM d),
k AS (SELECT *, max(CASE WHEN starts_with(line, '@@') THEN ln END) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS head FROM x),
h AS (SELECT doc_id, head, max(CASE WHEN ln = head THEN CAST(regexp_extract(line, '^@@ -(\\d+)', 1) AS BIGINT) - 1 END) AS start,
        coalesce(list(substring(line, 2) ORDER BY ln) FILTER (ln > head AND line[1] IN ('-', ' ')), []) AS minus,
        coalesce(list(substring(line, 2) ORDER BY ln) FILTER (ln > head AND line[1] IN ('+', ' ')), []) AS plus
      FROM k WHERE head IS NOT NULL GROUP BY doc_id, head),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY head) AS no FROM h),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS no, rows, CAST(0 AS BIGINT) AS moved, CAST(NULL AS BIGINT) AS at, false AS applied FROM d
  UNION ALL
  SELECT r.doc_id, n.no,
    CASE WHEN n.start + r.moved + len(n.minus) > len(r.rows) THEN r.rows ELSE
      r.rows[1:(CASE WHEN n.start + r.moved < 0 THEN greatest(n.start + r.moved + len(r.rows), 0) ELSE n.start + r.moved END)]
      || list_transform(n.plus, lambda p: p || chr(10))
      || r.rows[greatest(CASE WHEN n.start + r.moved + len(n.minus) < 0 THEN greatest(n.start + r.moved + len(n.minus) + len(r.rows), 0)
                              ELSE n.start + r.moved + len(n.minus) END,
                         CASE WHEN n.start + r.moved < 0 THEN greatest(n.start + r.moved + len(r.rows), 0) ELSE n.start + r.moved END) + 1:] END,
    CASE WHEN n.start + r.moved + len(n.minus) > len(r.rows) THEN r.moved ELSE r.moved + len(n.plus) - len(n.minus) END,
    r.moved, n.start + r.moved + len(n.minus) <= len(r.rows)
  FROM r JOIN n ON n.doc_id = r.doc_id AND n.no = r.no + 1)"""


@query("apply_udiffs", ["v_files", "v_diffs"], sql=f"""
WITH RECURSIVE {_HUNKS_SQL}
SELECT doc_id, md5(array_to_string(rows, '')) AS content_md5 FROM r
WHERE no = (SELECT count(*) FROM n WHERE n.doc_id = r.doc_id)""")
def q_apply_udiffs(spark):
    """E-6: a diff of several hunks applied to every file, by position."""
    out = edits.apply_udiffs(spread(spark.table("v_files").select("repo_id", "path", "content")), spark.table("v_diffs"))
    return out.select("doc_id", F.md5("content").alias("content_md5"))


@query("hunk_offsets", ["v_files", "v_diffs"], sql=f"""
WITH RECURSIVE {_HUNKS_SQL}
SELECT d.repo_id, d.path, CAST(r.no - 1 AS INTEGER) AS hunk_no, n.start, CAST(len(n.minus) AS INTEGER) AS takes,
  CAST(len(n.plus) AS INTEGER) AS puts, r.at AS moved, r.applied
FROM r JOIN n ON n.doc_id = r.doc_id AND n.no = r.no JOIN v_diffs d ON d.doc_id = r.doc_id""")
def q_hunk_offsets(spark):
    """Every hunk's start, how far earlier hunks have moved it, and whether it applies."""
    return edits.hunk_offsets(spread(spark.table("v_files").select("repo_id", "path", "content")), spark.table("v_diffs"))


def _outcomes(spark):
    parsed = edits.dispatch_format(spark.table("v_responses"))
    return edits.apply_edits(spark.table("v_files").select("repo_id", "path", "content"), parsed)


# one edit after the other on the content that the one before has left; the fixture's diffs replace the first line
_APPLY_SQL = f"""
p AS (SELECT repo_id, path, response_id, block_no, format, original, updated FROM ({_EB_SQL}) a
  UNION ALL SELECT repo_id, path, response_id, block_no, format, '', updated FROM {_WHOLE_SQL} b
  UNION ALL SELECT v.repo_id, u.path, u.response_id, u.block_no, u.format, u.original, u.updated
    FROM ({_UDIFF_SQL}) u JOIN v_responses v ON v.response_id = u.response_id),
o AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY response_id, block_no) AS no,
        count(*) OVER (PARTITION BY repo_id, path) AS total FROM p),
t AS (SELECT DISTINCT o.repo_id, o.path, f.content AS body FROM o LEFT JOIN v_files f ON f.repo_id = o.repo_id AND f.path = o.path),
r AS (SELECT repo_id, path, CAST(0 AS BIGINT) AS no, body, CAST('' AS VARCHAR) AS status, false AS changed FROM t
  UNION ALL
  SELECT repo_id, path, no, CASE WHEN status IN ('no_match', 'missing') THEN body ELSE next END, status,
    status = 'created' OR (status = 'edited' AND next <> coalesce(body, ''))
  FROM (SELECT repo_id, path, no, body, next, CASE WHEN kind <> 'edit' THEN kind WHEN body IS NULL THEN 'missing'
               WHEN next IS NULL THEN 'no_match' ELSE 'edited' END AS status
        FROM (SELECT o.repo_id, o.path, o.no, r.body,
                CASE WHEN o.format = 'udiff' THEN 'edited' WHEN o.format = 'whole' OR {d_strip('o.original')} = '' THEN 'created' ELSE 'edit' END AS kind,
                CASE WHEN o.format = 'udiff' THEN CASE WHEN coalesce(r.body, '') = '' THEN coalesce(r.body, '')
                       ELSE 'edited' || chr(10) || array_to_string(({d_lines('r.body', keep=True)})[2:], '') END
                     WHEN o.format = 'whole' OR {d_strip('o.original')} = '' THEN o.updated
                     ELSE coalesce({d_replace_first('r.body', 'o.original', 'o.updated')}, {d_fuzzy('r.body', 'o.original', 'o.updated')}) END AS next
              FROM r JOIN o ON o.repo_id = r.repo_id AND o.path = r.path AND o.no = r.no + 1) s1) s2)"""


@query("apply_edits", ["v_responses", "v_files"], sql=f"""
WITH RECURSIVE {_APPLY_SQL}
SELECT o.repo_id, o.path, o.response_id, o.block_no, o.format, r.status, r.changed,
  CASE WHEN o.no = o.total THEN md5(r.body) END AS final_md5
FROM o JOIN r ON r.repo_id = o.repo_id AND r.path = o.path AND r.no = o.no""")
def q_apply_edits(spark):
    """E-4/E-5/E-6: ordered per-file fold of all parsed edits (status per edit, final content hash)."""
    o = _outcomes(spark)
    return o.select("repo_id", "path", "response_id", "block_no", "format", "status", "changed",
                    F.when(F.col("final"), F.md5("content")).alias("final_md5"))


@query("edit_outcomes", ["v_responses", "v_files"], sql=f"""
WITH RECURSIVE {_APPLY_SQL}
SELECT o.format, r.status, count(*) AS n_edits, count(DISTINCT o.repo_id || '/' || o.path) AS n_paths
FROM o JOIN r ON r.repo_id = o.repo_id AND r.path = o.path AND r.no = o.no GROUP BY o.format, r.status""")
def q_edit_outcomes(spark):
    """E-9: edit counts per format and status, distinct paths touched."""
    return edits.edit_outcomes(_outcomes(spark))


@query("apply_whole", ["v_responses", "v_files"], sql=f"""
WITH w AS {_WHOLE_SQL},
last AS (SELECT repo_id, path, arg_max(updated, response_id * 1000 + block_no) AS new_content FROM w GROUP BY repo_id, path)
SELECT coalesce(f.repo_id, last.repo_id) AS repo_id, coalesce(f.path, last.path) AS path,
  md5(coalesce(last.new_content, f.content)) AS content_md5,
  CASE WHEN last.new_content IS NULL THEN 'kept' WHEN f.content IS NULL THEN 'created' ELSE 'updated' END AS status
FROM v_files f FULL OUTER JOIN last ON last.repo_id = f.repo_id AND last.path = f.path""")
def q_apply_whole(spark):
    """E-7: the file table after whole-file writes (last write per file wins)."""
    w = edits.parse_whole(spark.table("v_responses").filter(F.col("format") == "whole"))
    out = edits.apply_whole(spark.table("v_files"), w)
    return out.select("repo_id", "path", F.md5("content").alias("content_md5"), "status")


@query("create_only", ["v_responses", "v_files"], sql=f"""
WITH w AS {_WHOLE_SQL}
SELECT response_id, path, CASE WHEN EXISTS (SELECT 1 FROM v_files f WHERE f.repo_id = w.repo_id AND f.path = w.path)
  THEN 'exists' ELSE 'created' END AS status FROM w""")
def q_create_only(spark):
    """create_only: whole-file writes treated as creates; existing paths are rejected."""
    w = edits.parse_whole(spark.table("v_responses").filter(F.col("format") == "whole"))
    return edits.create_only(spark.table("v_files"), w.select("response_id", "repo_id", "path")).select(
        "response_id", "path", "status")


@query("replace_first", ["documents"], sql="""
SELECT doc_id, CASE WHEN position(' the ' IN text) > 0 THEN
  substring(text, 1, position(' the ' IN text) - 1) || ' THE ' || substring(text, position(' the ' IN text) + 5)
  END AS replaced FROM documents""")
def q_replace_first(spark):
    """Literal first-occurrence replace over every document (NULL when absent)."""
    d = spark.table("documents")
    return d.select("doc_id", replace_first(F.col("text"), F.lit(" the "), F.lit(" THE ")).alias("replaced"))


@query("normalise_ws", ["documents"], sql=f"""
SELECT doc_id, regexp_replace(regexp_replace(text, '^[{SPACE_BODY}]+|[{SPACE_BODY}]+$', '', 'g'), '[ \\t]+', ' ', 'g')
  AS normalised FROM documents""")
def q_normalise_ws(spark):
    """Python strip + collapse of space/tab runs, over every document."""
    d = spread(spark.table("documents").select("doc_id", "text"))
    return d.select("doc_id", normalise_ws(F.col("text")).alias("normalised"))


@query("looks_like_path", ["v_responses"], sql=f"""
SELECT response_id, ln, fname FROM (
  SELECT response_id, unnest(regexp_extract_all(response, '{_KEEP}')) AS line,
         unnest(generate_series(1, len(regexp_extract_all(response, '{_KEEP}')))) AS ln FROM v_responses) l,
  LATERAL (SELECT {d_path_candidate('l.line')} AS fname) c
WHERE fname IS NOT NULL""")
def q_looks_like_path(spark):
    """Reply lines that name a file (cleaned path), over every reply line."""
    r = spark.table("v_responses")
    lines = r.select("response_id", F.posexplode(lines_keepends(F.col("response"))).alias("_p", "line"))
    from codecorpus.functions.text import strip_py
    cand = looks_like_path(F.regexp_replace(strip_py(F.col("line")), ":+$", ""))
    return (lines.select("response_id", (F.col("_p") + 1).cast("long").alias("ln"), cand.alias("fname"))
            .filter(F.col("fname").isNotNull()))


@query("edits_to_files", ["v_responses", "v_files"], sql=f"""
SELECT e.response_id, e.block_no, e.path,
  CASE WHEN regexp_replace(e.original, '^[{SPACE_BODY}]+|[{SPACE_BODY}]+$', '', 'g') = '' THEN 'create'
       WHEN NOT EXISTS (SELECT 1 FROM v_files f WHERE f.repo_id = e.repo_id AND f.path = e.path) THEN 'missing' ELSE 'apply' END AS route
FROM ({_EB_SQL}) e""")
def q_edits_to_files(spark):
    """J-5: each parsed edit routed to create / missing / apply by its target file."""
    e = edits.parse_editblocks(spark.table("v_responses").filter(F.col("format") == "editblock"))
    return edits.edits_to_files(spark.table("v_files"), e).select("response_id", "block_no", "path", "route")


@query("carry_filename", ["v_responses"], sql=f"""
SELECT response_id, ln, fname, last_value(fname IGNORE NULLS) OVER (PARTITION BY response_id ORDER BY ln
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current_file
FROM (SELECT response_id, ln, CASE WHEN contains(line, '<<<<<<< SEARCH') THEN NULL ELSE {d_path_candidate('line')} END AS fname
      FROM (SELECT response_id, unnest(regexp_extract_all(response, '{_KEEP}')) AS line,
                   unnest(generate_series(1, len(regexp_extract_all(response, '{_KEEP}')))) AS ln FROM v_responses) l) x""")
def q_carry_filename(spark):
    """The filename in force at every reply line (last filename line before it)."""
    return edits.carry_filename(spark.table("v_responses")).select("response_id", "ln", "fname", "current_file")


@query("write_files", ["v_snapshot_b"], sql="SELECT repo_id, path, md5(content) AS content_md5 FROM v_snapshot_b")
def q_write_files(spark):
    """write_files: a snapshot written as a versioned table (partitioned by repo) and read back."""
    import uuid

    from codecorpus.session import checkpoint_path
    from codecorpus.sources.files import read_version, write_files
    base = checkpoint_path(spark, f"files-{uuid.uuid4().hex}")
    write_files(spark.table("v_snapshot_b"), base, 2)
    return read_version(spark, base, 2).select("repo_id", "path", F.md5("content").alias("content_md5"))
