"""Corpus scan, filters, symbols and the repo map (2.1, 2.2, S1, F7, J-1, J-3, K1, K2, A4, W3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus import dims
from codecorpus.functions.patterns import LINE_BREAK, py_regex
from codecorpus.functions.text import basename, split_lines, stem, suffix_lower
from codecorpus.operators import corpus, repomap
from codecorpus.plans.registry import query
from codecorpus.session import spread

# ---------------------------------------------------------------- DuckDB helpers
def d_name(p: str) -> str:
    return f"string_split({p}, '/')[-1]"


def d_sfx(p: str) -> str:
    return f"lower(regexp_extract({d_name(p)}, '^.+(\\.[^.]+)$', 1))"


def d_stem(p: str) -> str:
    n = d_name(p)
    return (f"(CASE WHEN regexp_extract({n}, '^.+(\\.[^.]+)$', 1) = '' THEN {n} "
            f"ELSE substring({n}, 1, length({n}) - length(regexp_extract({n}, '^.+(\\.[^.]+)$', 1))) END)")


def d_list(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def d_lines(c: str) -> str:
    """splitlines() as a DuckDB list (drop the trailing empty element)."""
    sp = f"string_split_regex({c}, '{LINE_BREAK}')"
    return f"{sp}[1:len({sp}) - CASE WHEN {sp}[-1] = '' THEN 1 ELSE 0 END]"


def d_symbol_case(ext: str, line: str, what: str) -> str:
    parts = []
    for e, rules in dims.SYMBOL_RULES.items():
        exts = [e] + [a for a, b in dims.RULE_ALIASES.items() if b == e]
        for typ, rx in rules:
            r = py_regex(rx)
            val = f"'{typ}'" if what == "type" else f"regexp_extract({line}, '{r}', 1)"
            parts.append(f"WHEN {ext} IN {d_list(exts)} AND regexp_matches({line}, '{r}') THEN {val}")
    return "(CASE " + " ".join(parts) + " END)"


def d_weight(t: str) -> str:
    return "(CASE " + " ".join(f"WHEN {t} = '{n}' THEN {w}" for n, w in dims.TYPE_WEIGHTS) + " ELSE 0 END)"


# what the ignore patterns mean, written out for the oracle: folders of the root with something in
# them, then names and endings of any part of a path
IGN = ("(regexp_matches({p}, '^(\\.git|node_modules|__pycache__|\\.venv|venv|dist|build|\\.pytest_cache|[^/]*\\.egg-info)/.') "
       "OR regexp_matches({p}, '(^|/)[^/]*\\.(pyc|pyo|class|o|so|dll|exe|map|lock|min\\.js|min\\.css)(/|$)') "
       "OR regexp_matches({p}, '(^|/)(package-lock\\.json|yarn\\.lock|Cargo\\.lock|go\\.sum)(/|$)'))")
# the same of the fixture's .gitignore, from its last rule to its first
REPO_IGN = ("(CASE WHEN regexp_matches({p}, '(^|/)[^/]*\\.min\\.js(/|$)') THEN true "
            "WHEN regexp_matches({p}, '^fr/(.*/)?doc_2[^/]*(/|$)') THEN true "
            "WHEN regexp_matches({p}, '^de/doc_1[^/]*\\.py(/|$)') THEN false "
            "WHEN {p} LIKE 'de/%' OR {p} LIKE '%/de/%' THEN true "
            "WHEN regexp_matches({p}, '^en/[^/]*\\.md(/|$)') THEN false "
            "ELSE regexp_matches({p}, '(^|/)[^/]*\\.md(/|$)') END)")
TEXT_EXT = d_list(dims.text_extensions())


def scanned_sql(src: str) -> str:
    return (f"(SELECT * FROM {src} WHERE NOT {IGN.format(p='path')} AND NOT {REPO_IGN.format(p='path')} "
            f"AND {d_sfx('path')} IN {TEXT_EXT})")


SCANNED = scanned_sql("v_tree")


def tags_sql(src: str, public_only: bool = True) -> str:
    return f"""(SELECT repo_id, path, CAST(ln AS INTEGER) AS line, type, name FROM (
  SELECT repo_id, path, ln, {d_symbol_case('ext', 'line', 'type')} AS type, {d_symbol_case('ext', 'line', 'name')} AS name
  FROM (SELECT repo_id, path, ext, unnest(lst) AS line, unnest(generate_series(1, len(lst))) AS ln
        FROM (SELECT repo_id, path, {d_sfx('path')} AS ext, {d_lines('content')} AS lst FROM {src} s0
              WHERE {d_sfx('path')} IN {d_list(dims.symbol_extensions())}) s1) s2) s3
  WHERE type IS NOT NULL {"AND NOT starts_with(name, '_')" if public_only else ''})"""


def ranked_sql(src: str, chat: str | None) -> str:
    if chat is None:
        return f"(SELECT *, false AS name_match, {d_weight('type')} AS weight FROM {tags_sql(src)} t)"
    st = f"(SELECT DISTINCT repo_id, lower({d_stem('path')}) AS s FROM {chat} c)"
    return f"""(SELECT t.*, (EXISTS (SELECT 1 FROM {st} x WHERE x.repo_id = t.repo_id AND x.s = lower(t.name))
     OR EXISTS (SELECT 1 FROM {st} y WHERE y.repo_id = t.repo_id AND y.s = lower({d_stem('t.path')}))) AS name_match,
   {d_weight('t.type')} AS weight FROM {tags_sql(src)} t)"""


def blocks_sql(src: str, chat: str | None) -> str:
    return f"""(SELECT repo_id, path, min(CASE WHEN name_match THEN 0 ELSE 1 END) AS k1,
   min(CASE WHEN name_match THEN 0 ELSE 1 END * 100 - weight) AS k12,
   length(path) + sum(length(type) + length(name) + 4) AS chars,
   path || chr(10) || string_agg('  ' || type || ' ' || name || ':', chr(10)
       ORDER BY CASE WHEN name_match THEN 0 ELSE 1 END, -weight, line) AS block
 FROM {ranked_sql(src, chat)} r GROUP BY repo_id, path)"""


def budget_sql(src: str, chat: str | None, tokens: int = dims.REPO_MAP_TOKENS) -> str:
    b = tokens * dims.CHARS_PER_MAP_TOKEN
    return f"""(SELECT * FROM (SELECT *, sum(chars) OVER (PARTITION BY repo_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum_chars,
     coalesce(sum(chars) OVER (PARTITION BY repo_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY k12, path) AS pos FROM {blocks_sql(src, chat)} b) r) x
 WHERE before <= {b})"""


def map_sql(src: str, tokens: int = dims.REPO_MAP_TOKENS) -> str:
    b = tokens * dims.CHARS_PER_MAP_TOKEN
    return f"""SELECT r.repo_id, CAST(coalesce(m.n_files, 0) AS BIGINT) AS n_files, coalesce(m.repo_map, '') AS repo_map
FROM (SELECT DISTINCT repo_id FROM {src} s) r LEFT JOIN (
  SELECT repo_id, count(*) AS n_files, '```' || chr(10) || 'Repo map:' || chr(10) || string_agg(block, chr(10) ORDER BY pos)
    || CASE WHEN max(cum_chars) > {b} THEN chr(10) || '  ... (truncated)' ELSE '' END || chr(10) || '```' AS repo_map
  FROM {budget_sql(src, None, tokens)} k GROUP BY repo_id) m ON m.repo_id = r.repo_id"""


def session_map_ctes(src: str, tokens: int = dims.REPO_MAP_TOKENS) -> str:
    """DuckDB CTEs ending in sm (conv_id, repo_id, n_files, repo_map): every session's own map, tag by tag."""
    b = tokens * dims.CHARS_PER_MAP_TOKEN
    return f"""sm_tags AS MATERIALIZED (SELECT *, {d_weight('type')} AS weight FROM {tags_sql(src)} t),
sm_own AS (SELECT DISTINCT conv_id, repo_id, path, lower({d_stem('path')}) AS s FROM v_chat_files),
sm_all AS (SELECT o.conv_id, t.*, (EXISTS (SELECT 1 FROM sm_own x WHERE x.conv_id = o.conv_id AND x.repo_id = t.repo_id
       AND x.s = lower(t.name)) OR EXISTS (SELECT 1 FROM sm_own y WHERE y.conv_id = o.conv_id AND y.repo_id = t.repo_id
       AND y.s = lower({d_stem('t.path')}))) AS hit
  FROM (SELECT DISTINCT conv_id, repo_id FROM sm_own) o JOIN sm_tags t ON t.repo_id = o.repo_id
  WHERE NOT EXISTS (SELECT 1 FROM sm_own z WHERE z.conv_id = o.conv_id AND z.repo_id = t.repo_id AND z.path = t.path)),
sm_blocks AS (SELECT conv_id, repo_id, path, min(CASE WHEN hit THEN 0 ELSE 100 END - weight) AS k,
    length(path) + sum(length(type) + length(name) + 4) AS chars,
    path || chr(10) || string_agg('  ' || type || ' ' || name || ':', chr(10) ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, -weight, line) AS block
  FROM sm_all GROUP BY conv_id, repo_id, path),
sm_cut AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id, repo_id ORDER BY k, path ROWS UNBOUNDED PRECEDING) AS upto FROM sm_blocks),
sm AS (SELECT o.conv_id, o.repo_id, CAST(count(c.path) AS BIGINT) AS n_files, CASE WHEN count(c.path) = 0 THEN '' ELSE
    '```' || chr(10) || 'Repo map:' || chr(10) || string_agg(c.block, chr(10) ORDER BY c.upto)
    || CASE WHEN max(c.upto) > {b} THEN chr(10) || '  ... (truncated)' ELSE '' END || chr(10) || '```' END AS repo_map
  FROM (SELECT DISTINCT conv_id, repo_id FROM sm_own) o
  LEFT JOIN sm_cut c ON c.conv_id = o.conv_id AND c.repo_id = o.repo_id AND c.upto - c.chars <= {b}
  GROUP BY o.conv_id, o.repo_id)"""


# ---------------------------------------------------------------- scans and filters
@query("scan_repo_files", ["v_tree", "v_gitignore"], sql=f"SELECT repo_id, path FROM {SCANNED} s")
def q_scan(spark):
    """scan_repo_files: tree minus built-in ignores and the repo's .gitignore, text extensions only."""
    return corpus.scan_repo_files(spark.table("v_tree").select("repo_id", "path"), spark.table("v_gitignore"))


@query("filter_builtin_ignore", ["v_tree"], sql=f"""
SELECT repo_id, path, {IGN.format(p='path')} AS ignored FROM v_tree""")
def q_builtin_ignore(spark):
    """which tree paths the 24 built-in ignore patterns drop."""
    t = spark.table("v_tree")
    return t.select("repo_id", "path", corpus.builtin_ignored(F.col("path")).alias("ignored"))


@query("filter_text_ext", ["v_tree"], sql=f"""
SELECT repo_id, path, {d_sfx('path')} AS ext, {d_sfx('path')} IN {TEXT_EXT} AS is_text_ext FROM v_tree""")
def q_text_ext(spark):
    """F3 + S4: lower-cased suffix and the text-extension test."""
    t = spark.table("v_tree")
    return t.select("repo_id", "path", suffix_lower(F.col("path")).alias("ext"),
                    corpus.is_text_ext(F.col("path")).alias("is_text_ext"))


def _lang_sql(p: str, special: bool) -> str:
    whens = " ".join(f"WHEN {d_sfx(p)} = '{e}' THEN '{lang}'" for e, lang in dims.EXT_TO_LANG)
    sp = " ".join(f"WHEN lower({d_name(p)}) = '{n}' THEN '{lang}'" for n, lang in dims.SPECIAL_NAMES) if special else ""
    return f"(CASE {sp} {whens} ELSE '' END)"


@query("detect_language", ["v_tree"], sql=f"""
SELECT repo_id, path, {_lang_sql('path', True)} AS language, {_lang_sql('path', False)} AS ext_language FROM v_tree""")
def q_detect_language(spark):
    """J-3: language by special basename then extension; and the extension-only helper."""
    t = spark.table("v_tree")
    return t.select("repo_id", "path", corpus.detect_language(F.col("path")).alias("language"),
                    corpus.file_language(F.col("path")).alias("ext_language"))


@query("path_parts", ["v_tree"], sql=f"""
SELECT repo_id, path, {d_name('path')} AS name, {d_stem('path')} AS stem, {d_sfx('path')} AS suffix FROM v_tree""")
def q_path_parts(spark):
    """Basename, stem and lower-cased suffix of every tree path."""
    t = spark.table("v_tree")
    return t.select("repo_id", "path", basename(F.col("path")).alias("name"), stem(F.col("path")).alias("stem"),
                    suffix_lower(F.col("path")).alias("suffix"))


def _raw(spark):
    """Tree rows as raw bytes: some files carry a NUL (binary marker) at the end."""
    t = spark.table("v_tree")
    b = F.encode("content", "UTF-8")
    return t.select("repo_id", "path", "doc_id",
                    F.when(F.col("doc_id") % 5 == 0, F.concat(b, F.lit(bytearray(b"\x00")))).otherwise(b)
                    .alias("bytes"))


_RAW_SQL = """(SELECT repo_id, path, doc_id, CASE WHEN doc_id % 5 = 0 THEN encode(content) || '\\x00'::BLOB
  ELSE encode(content) END AS bytes FROM v_tree)"""


@query("is_text", ["v_tree"], sql=f"""
SELECT repo_id, path, {d_sfx('path')} NOT IN {d_list(dims.BINARY_EXTENSIONS)}
  AND NOT list_contains(regexp_extract_all(substring(hex(bytes), 1, 16384), '..'), '00') AS is_text FROM {_RAW_SQL} r""")
def q_is_text(spark):
    """binary extension or a NUL in the first 8192 bytes means not text."""
    r = _raw(spark)
    return r.select("repo_id", "path", corpus.is_text(F.col("path"), F.col("bytes")).alias("is_text"))


_FIND_INC = ["*.py", "*.go", "*.PY"]
_FIND_IGN = ["*/doc_1*", "node_modules"]


# '*/doc_1*' is found anywhere behind a slash; 'node_modules' is the whole path or the name
@query("find_files", ["v_tree"], sql=f"""
SELECT repo_id, path FROM (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rn
  FROM v_tree WHERE NOT contains(path, '/doc_1') AND path <> 'node_modules' AND {d_name('path')} <> 'node_modules'
    AND (suffix(path, '.py') OR suffix(path, '.go') OR suffix(path, '.PY'))) x WHERE rn <= 1000""")
def q_find_files(spark):
    """find_files: include globs on the basename, ignore globs on path or basename, 1000 per repo."""
    return corpus.find_files(spark.table("v_tree"), _FIND_INC, _FIND_IGN).select("repo_id", "path")


@query("find_text_files_top10", ["v_tree"], sql=f"""
SELECT repo_id, path FROM (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rn
  FROM {_RAW_SQL} r WHERE NOT suffix(path, '.min.js')
    AND {d_sfx('path')} NOT IN {d_list(dims.BINARY_EXTENSIONS)} AND NOT list_contains(regexp_extract_all(substring(hex(bytes), 1, 16384), '..'), '00')) x
WHERE rn <= 10""")
def q_find_text_files(spark):
    """find_files without include globs: text files only, first 10 per repo by path."""
    r = _raw(spark).withColumnRenamed("bytes", "content")
    return corpus.find_files(r, None, ["*.min.js"], max_files=10).select("repo_id", "path")


@query("filter_repo_ignore", ["v_files", "v_gitignore"], sql=f"""
SELECT repo_id, path FROM v_files WHERE NOT {REPO_IGN.format(p='path')}""")
def q_repo_ignore(spark):
    """each repo's root .gitignore, last matching rule wins ('!' re-includes)."""
    return corpus.filter_repo_ignore(spark.table("v_files").select("repo_id", "path"),
                                     spark.table("v_gitignore")).select("repo_id", "path")


def _glob_rx_sql(p: str) -> str:
    """DuckDB spelling of glob -> regex for the fixture's patterns (no brackets,
    no dot-files in the fixture, so no hidden-file guard is needed)."""
    e = f"replace(replace({p}, '.', '\\.'), '?', '[^/]')"
    e = f"replace(replace({e}, '**/', chr(1)), '*', '[^/]*')"
    return f"'^' || replace({e}, chr(1), '(?:[^/]+/)*') || '$'"


@query("glob_add", ["v_add_requests", "v_files"], sql=f"""
WITH q AS (SELECT conv_id, repo_id, pattern, {_glob_rx_sql('pattern')} AS rx FROM v_add_requests),
hits AS (SELECT q.conv_id, q.pattern, f.path FROM q JOIN v_files f ON f.repo_id = q.repo_id AND regexp_matches(f.path, q.rx)),
missed AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.conv_id = q.conv_id AND h.pattern = q.pattern))
SELECT conv_id, pattern, path, 'added' AS status FROM hits
UNION ALL
SELECT m.conv_id, m.pattern, f.path, CASE WHEN f.path IS NULL THEN 'not_found' ELSE 'added' END
FROM missed m LEFT JOIN v_files f ON f.repo_id = m.repo_id AND f.path = m.pattern""")
def q_glob_add(spark):
    """/add globs per session (recursive '**'), literal fallback, misses reported."""
    return corpus.glob_add(spark.table("v_add_requests"), spark.table("v_files")).select(
        "conv_id", "pattern", "path", "status")


# ---------------------------------------------------------------- symbols
@query("extract_symbols", ["v_files"], sql=f"SELECT * FROM {tags_sql('v_files', public_only=False)} t")
def q_extract_symbols(spark):
    """Every first-match symbol line of every code file (private ones included)."""
    return corpus.extract_symbols(spread(spark.table("v_files")), public_only=False)


@query("public_symbols", ["v_files"], sql=f"SELECT * FROM {tags_sql('v_files')} t")
def q_public_symbols(spark):
    """symbols after dropping names that start with '_' (a private hit still consumes its line)."""
    return corpus.extract_symbols(spread(spark.table("v_files")))


@query("split_lines", ["v_files"], sql=f"""
SELECT path, CAST(len({d_lines('content')}) AS INTEGER) AS n_lines, {d_lines('content')}[1] AS first_line FROM v_files""")
def q_split_lines(spark):
    """Line kernel: Python splitlines() parity (count and first line)."""
    f = spread(spark.table("v_files")).select("path", split_lines(F.col("content")).alias("_l"))
    return f.select("path", F.size("_l").alias("n_lines"), F.element_at("_l", 1).alias("first_line"))


@query("exclude_chat_files", ["v_files", "v_chat_files"], sql="""
SELECT o.conv_id, o.repo_id, (SELECT count(*) FROM v_files f WHERE f.repo_id = o.repo_id) AS n_files,
  (SELECT count(*) FROM v_files f WHERE f.repo_id = o.repo_id AND EXISTS (SELECT 1 FROM v_chat_files c
     WHERE c.conv_id = o.conv_id AND c.repo_id = f.repo_id AND c.path = f.path)) AS n_attached,
  (SELECT count(*) FROM v_files f WHERE f.repo_id = o.repo_id AND NOT EXISTS (SELECT 1 FROM v_chat_files c
     WHERE c.conv_id = o.conv_id AND c.repo_id = f.repo_id AND c.path = f.path)) AS n_left
FROM (SELECT DISTINCT conv_id, repo_id FROM v_chat_files) o""")
def q_exclude_chat(spark):
    """J-1: per session and repo, the repo's files, those the session holds and those left."""
    return corpus.chat_coverage(spark.table("v_files"), spark.table("v_chat_files"))


@query("rank_tags", ["v_files", "v_chat_files"], sql=f"""
SELECT repo_id, path, line, type, name, weight, name_match FROM {ranked_sql('v_files', 'v_chat_files')} r""")
def q_rank_tags(spark):
    """K1: tag sort key against the chat-file stems of the same repo."""
    tags = corpus.extract_symbols(spread(spark.table("v_files")))
    cf = spark.table("v_chat_files")
    stems = cf.select("repo_id", stem(F.col("path")).alias("stem"))
    return repomap.rank_tags(tags, stems).select("repo_id", "path", "line", "type", "name", "weight", "name_match")


@query("tags_by_file", ["v_files"], sql=f"SELECT repo_id, path, chars, block FROM {blocks_sql('v_files', None)} b")
def q_tags_by_file(spark):
    """A4: per-file rendered tag block and its character count."""
    tags = corpus.extract_symbols(spread(spark.table("v_files")))
    return repomap.file_blocks(repomap.rank_tags(tags)).select("repo_id", "path", "chars", "block")


@query("map_budget", ["v_files"], sql=f"""
SELECT repo_id, path, CAST(pos AS INTEGER) AS pos, cum_chars FROM {budget_sql('v_files', None)} k""")
def q_map_budget(spark):
    """Files kept by the 2048-token (x3 chars) budget, overflowing file included."""
    tags = corpus.extract_symbols(spread(spark.table("v_files")))
    kept = repomap.map_budget(repomap.file_blocks(repomap.rank_tags(tags)))
    return kept.select("repo_id", "path", "pos", "cum_chars")


@query("repo_map", ["v_tree", "v_gitignore"], sql=map_sql(SCANNED))
def q_repo_map(spark):
    """K2 (flagship): ranked, budgeted repo map of every repo in the tree."""
    return repomap.repo_map(spark.table("v_tree"), rules=spark.table("v_gitignore"))


@query("repo_map_small_budget", ["v_tree", "v_gitignore"], sql=map_sql(SCANNED, 64))
def q_repo_map_small(spark):
    """K2 with a 64-token budget, so truncation is exercised on every repo."""
    return repomap.repo_map(spark.table("v_tree"), 64, rules=spark.table("v_gitignore"))


@query("repo_map_with_chat", ["v_files", "v_chat_files", "v_gitignore"],
       sql=f"WITH {session_map_ctes(scanned_sql('v_files'))} SELECT conv_id, repo_id, n_files, repo_map FROM sm")
def q_repo_map_chat(spark):
    """K2 of sessions: per session and repo, its own files left out, names matching their stems first."""
    return repomap.session_maps(spark.table("v_files"), spark.table("v_chat_files"), rules=spark.table("v_gitignore"))


@query("repo_map_with_chat_small", ["v_files", "v_chat_files", "v_gitignore"],
       sql=f"WITH {session_map_ctes(scanned_sql('v_files'), 64)} SELECT conv_id, repo_id, n_files, repo_map FROM sm")
def q_repo_map_chat_small(spark):
    """K2 of sessions with a 64-token budget: most maps are cut behind the matched files."""
    return repomap.session_maps(spark.table("v_files"), spark.table("v_chat_files"), 64, spark.table("v_gitignore"))
