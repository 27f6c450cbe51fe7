"""Driver tables and the derived views the operators run on.

The driver tables hold prose, not code, plans or diffs, so deterministic
views re-shape them into code files, sessions, replies, plans and events.
Every view reads whole tables; its size grows with them. The SQL text is
portable: the same string runs in Spark SQL and in DuckDB (the oracle puts
it in a WITH clause). Views with engine-specific syntax carry two spellings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations"]

# Session/file references spread over *all* documents (count-based modulo).
_DOC_REF = "(SELECT count(*) FROM documents)"

VIEWS: dict[str, str] = {}
VIEWS_DUCK: dict[str, str] = {}     # DuckDB spelling where it differs
DEPS: dict[str, list[str]] = {}


def _view(name: str, sql: str, deps: list[str], duck: str | None = None) -> None:
    VIEWS[name] = sql
    DEPS[name] = deps
    if duck is not None:
        VIEWS_DUCK[name] = duck


# v_files: repo = document source, 16 extensions, a code header + prose body
_view("v_files", """
SELECT source AS repo_id, lang || '/doc_' || CAST(doc_id AS STRING) || ext AS path, ext, doc_id,
       header || chr(10) || text AS content
FROM (SELECT doc_id, source, lang, text,
        split_part('.py,.js,.ts,.go,.rs,.java,.rb,.md,.cpp,.c,.php,.swift,.kt,.cs,.tsx,.jsx', ',', CAST(doc_id % 16 AS INT) + 1) AS ext,
        CASE doc_id % 16
          WHEN 0 THEN 'class Doc' || CAST(doc_id AS STRING) || ':' || chr(10) || '    def run_a(self):' || chr(10)
                      || 'def _hidden():' || chr(10) || 'async def poll_b():'
          WHEN 1 THEN 'export function load' || CAST(doc_id AS STRING) || '(x) {' || chr(10) || 'const pick = (x) => x;'
          WHEN 2 THEN 'export interface Shape' || CAST(doc_id AS STRING) || ' {' || chr(10) || 'enum Kind {'
          WHEN 3 THEN 'func (s *Srv) Handle' || CAST(doc_id AS STRING) || '(w int) {' || chr(10) || 'type Conf struct {'
          WHEN 4 THEN 'pub async fn step' || CAST(doc_id AS STRING) || '() {' || chr(10) || 'impl<T> Node {'
          WHEN 5 THEN 'public class Box' || CAST(doc_id AS STRING) || ' {' || chr(10) || '    public static int size(int x) {'
          WHEN 6 THEN 'module Mod' || CAST(doc_id AS STRING) || chr(10) || '  def call_it'
          WHEN 8 THEN 'struct Node' || CAST(doc_id AS STRING) || ' {' || chr(10) || 'static inline int area(int x) {'
          WHEN 9 THEN 'typedef struct Pair' || CAST(doc_id AS STRING) || chr(10) || 'int main(int argc) {'
          WHEN 10 THEN 'class Page' || CAST(doc_id AS STRING) || ' {' || chr(10) || 'public function render($x) {'
          WHEN 11 THEN 'protocol Shape' || CAST(doc_id AS STRING) || ' {' || chr(10) || '    public func draw(x: Int) {'
          WHEN 12 THEN 'data class Row' || CAST(doc_id AS STRING) || chr(10) || 'fun load(x: Int) {' || chr(10) || 'object Reg {'
          WHEN 13 THEN 'public interface IBox' || CAST(doc_id AS STRING) || chr(10) || '    private static long Sum(int x) {'
          WHEN 14 THEN 'export class View' || CAST(doc_id AS STRING) || ' {' || chr(10) || 'export type Props = {'
          WHEN 15 THEN 'export async function fetch' || CAST(doc_id AS STRING) || '() {' || chr(10) || 'let go = async (x) => x;'
          ELSE '# Title ' || CAST(doc_id AS STRING) END AS header
      FROM documents) d
""", ["documents"])

# v_sessions: canonical names, aliases and one unknown model
_view("v_sessions", """
SELECT DISTINCT conv_id, CASE conv_id % 8 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude' WHEN 2 THEN 'deepseek-r1'
  WHEN 3 THEN 'gemini-flash' WHEN 4 THEN 'llama3' WHEN 5 THEN 'o3' WHEN 6 THEN 'mistral/codestral-latest'
  ELSE 'unlisted-model' END AS model
FROM conversations
""", ["conversations"])

# v_chat_files: files attached to each session, one per turn
_view("v_chat_files", f"""
SELECT c.conv_id, f.repo_id, f.path, c.turn AS seq, c.turn % 3 = 0 AS read_only
FROM (SELECT conv_id, turn, (conv_id * 7 + turn) % {_DOC_REF} AS doc_ref FROM conversations) c
JOIN v_files f ON f.doc_id = c.doc_ref
""", ["conversations", "documents", "v_files"])

# v_responses: all three edit formats, plus no-match and missing-file cases
_view("v_responses", f"""
SELECT response_id, conv_id, turn, repo_id, fmt AS format, CASE fmt
    WHEN 'editblock' THEN 'Change:' || chr(10) || path || chr(10) || '<<<<<<< SEARCH' || chr(10) || needle || chr(10)
       || '=======' || chr(10) || '# edited' || chr(10) || '>>>>>>> REPLACE' || chr(10)
    WHEN 'whole' THEN '```text' || chr(10) || '# ' || path || chr(10) || 'x = 1' || chr(10) || '```' || chr(10)
    ELSE '```diff' || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,1 +1,1 @@' || chr(10)
       || '-' || needle || chr(10) || '+edited' || chr(10) || '```' || chr(10) END AS response
FROM (SELECT c.conv_id * 100 + c.turn AS response_id, c.conv_id, c.turn, f.repo_id,
        CASE (c.conv_id + c.turn) % 3 WHEN 0 THEN 'editblock' WHEN 1 THEN 'whole' ELSE 'udiff' END AS fmt,
        CASE WHEN c.conv_id % 7 = 0 THEN 'missing/x.py' ELSE f.path END AS path,
        CASE WHEN c.conv_id % 5 = 0 THEN 'absent text' ELSE split_part(f.content, chr(10), 1) END AS needle
      FROM (SELECT conv_id, turn, role, (conv_id * 7 + turn) % {_DOC_REF} AS doc_ref FROM conversations) c
      JOIN v_files f ON f.doc_id = c.doc_ref
      WHERE c.role = 'assistant') r
""", ["conversations", "documents", "v_files"])

# v_plans: valid, inside prose, not JSON, unknown agent, tasks that are a session's own text, cut off
_PLANS = """
SELECT conv_id AS run_id, 'task ' || CAST(conv_id AS STRING) AS task, CASE mod(conv_id, 6)
    WHEN 0 THEN '[{"agent":"coder","task":"a"},{"agent":"tester","task":"b"},{"agent":"reviewer","task":"c"}]'
    WHEN 1 THEN 'Plan:' || chr(10) || '[{"agent":"security","task":"audit"}]' || chr(10) || 'Done.'
    WHEN 2 THEN 'no plan here'
    WHEN 3 THEN '[{"agent":"wizard","task":"magic"},{"task":"no agent"}]'
    WHEN 4 THEN 'Steps: [{"agent":"tester","task":' || quoted || '},{"agent":"coder","task":' || quoted || ',"files":[1,2]},{}] end'
    ELSE 'see [1]' || chr(10) || '[{"agent":"tester","task":' || quoted || '}' END AS plan_output
FROM (SELECT conv_id, %s AS quoted FROM (SELECT conv_id, min(text) AS text FROM conversations GROUP BY conv_id) c) q
"""
_view("v_plans", _PLANS % "substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)", ["conversations"],
      duck=_PLANS % "CAST(to_json(text) AS VARCHAR)")

# v_agent_results: one step per turn of a run, some failing
_view("v_agent_results", """
SELECT conv_id AS run_id, CAST(turn + 1 AS INT) AS step,
  CASE turn % 3 WHEN 0 THEN 'coder' WHEN 1 THEN 'tester' ELSE 'reviewer' END AS agent_name,
  (conv_id + turn) % 5 <> 0 AS success,
  CASE WHEN (conv_id + turn) % 5 <> 0 THEN text ELSE '' END AS output,
  CASE WHEN (conv_id + turn) % 5 <> 0 THEN '' ELSE 'timeout' END AS error
FROM conversations
""", ["conversations"])

# v_file_events: watcher-like events, including deletes and non-code files
_view("v_file_events", """
SELECT event_id, ts, 'src/f' || CAST(user_id AS STRING) || CASE event_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.go'
    WHEN 2 THEN '.md' ELSE '.rs' END AS path,
  CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'modified' WHEN 'signup' THEN 'created'
    ELSE 'deleted' END AS event_type
FROM events
""", ["events"])

# v_commit_lines: every 10th subject contains the delimiter
_view("v_commit_lines", """
SELECT 'h' || CAST(o_orderkey AS STRING) || '|s' || CAST(o_orderkey AS STRING) || '|'
  || CASE WHEN o_orderkey % 10 = 0 THEN 'fix a|b' ELSE 'fix' END || '|cust' || CAST(o_custkey AS STRING) || '|'
  || substring(CAST(o_orderdate AS STRING), 1, 10) AS line
FROM orders
""", ["orders"])

# v_repo_commits: the same lines as the logs of seven repos
_view("v_repo_commits", """
SELECT 'repo' || CAST(o_custkey % 7 AS STRING) AS repo_id, line
FROM (SELECT o_custkey, 'h' || CAST(o_orderkey AS STRING) || '|s' || CAST(o_orderkey AS STRING) || '|'
  || CASE WHEN o_orderkey % 10 = 0 THEN 'fix a|b' ELSE 'fix' END || '|cust' || CAST(o_custkey AS STRING) || '|'
  || substring(CAST(o_orderdate AS STRING), 1, 10) AS line FROM orders) o
""", ["orders"])

# v_status_lines: porcelain-like, with renames
_view("v_status_lines", """
SELECT CASE doc_id % 3 WHEN 0 THEN ' M ' || path WHEN 1 THEN '?? ' || path
  ELSE 'R  old_' || CAST(doc_id AS STRING) || '.py -> ' || path END AS line
FROM v_files
""", ["v_files"])

# v_snapshot_b: v_files after edits, deletions and additions (v_files is snapshot a)
_view("v_snapshot_b", """
SELECT repo_id, path, CASE WHEN doc_id % 5 = 0 THEN content || chr(10) || 'changed' ELSE content END AS content
FROM v_files WHERE doc_id % 7 <> 0
UNION ALL
SELECT repo_id, 'added/' || path AS path, content FROM v_files WHERE doc_id % 11 = 0
""", ["v_files"])

# v_chunks: words of assistant turns, a NULL delta every 11th position
_view("v_chunks", """
SELECT conv_id * 100 + turn AS response_id, CAST(seq AS BIGINT) AS seq,
  CASE WHEN seq % 11 = 10 THEN NULL ELSE delta END AS delta
FROM conversations LATERAL VIEW posexplode(split(text, ' ')) p AS seq, delta
WHERE role = 'assistant'
""", ["conversations"], duck="""
SELECT response_id, seq, CASE WHEN seq % 11 = 10 THEN NULL ELSE delta END AS delta
FROM (SELECT conv_id * 100 + turn AS response_id,
        unnest(string_split(text, ' ')) AS delta,
        CAST(unnest(generate_series(0, len(string_split(text, ' ')) - 1)) AS BIGINT) AS seq
      FROM conversations WHERE role = 'assistant') s
""")

# v_tree: a repository tree with paths the scanners must drop or special-case
_view("v_tree", """
SELECT repo_id, doc_id,
  CASE doc_id % 12 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/node_modules/' WHEN 3 THEN 'build/' ELSE '' END
  || CASE doc_id % 12 WHEN 8 THEN upper(lang) ELSE lang END
  || CASE doc_id % 12 WHEN 4 THEN '/pkg' || CAST(doc_id AS STRING) || '.egg-info/PKG-INFO'
       WHEN 5 THEN '/app' || CAST(doc_id AS STRING) || '.min.js'
       WHEN 6 THEN '/d' || CAST(doc_id AS STRING) || '/Dockerfile'
       WHEN 7 THEN '/m' || CAST(doc_id AS STRING) || '/Makefile'
       WHEN 8 THEN '/DOC_' || CAST(doc_id AS STRING) || upper(ext)
       WHEN 9 THEN '/img_' || CAST(doc_id AS STRING) || '.png'
       WHEN 10 THEN '/notes_' || CAST(doc_id AS STRING) || '.txt'
       ELSE '/doc_' || CAST(doc_id AS STRING) || ext END
  || CASE doc_id % 12 WHEN 2 THEN '.pyc' ELSE '' END AS path,
  content
FROM (SELECT *, split_part(path, '/', 1) AS lang FROM v_files) f
""", ["v_files"])

# v_gitignore: each repo's root .gitignore (ordered rules; '!' re-includes)
_GITIGNORE_RULES = ["*.md", "!en/*.md", "de/", "!de/doc_1*.py", "# comment", "fr/**/doc_2*", "*.min.js"]
_view("v_gitignore", f"""
SELECT repo_id, pos + 1 AS rule_no, rule FROM (SELECT DISTINCT repo_id FROM v_files) r
LATERAL VIEW posexplode(array({", ".join(f"'{r}'" for r in _GITIGNORE_RULES)})) p AS pos, rule
""", ["v_files"], duck=f"""
SELECT repo_id, generate_subscripts(rules, 1) AS rule_no, unnest(rules) AS rule
FROM (SELECT DISTINCT repo_id, [{", ".join(f"'{r}'" for r in _GITIGNORE_RULES)}] AS rules FROM v_files) r
""")

# v_urls: page URLs with upper-case, disallowed and missing schemes
_view("v_urls", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN url
    WHEN 1 THEN 'HTTPS' || substring(url, instr(url, ':'))
    WHEN 2 THEN 'ftp' || substring(url, instr(url, ':'))
    WHEN 3 THEN 'file:///srv/page_' || CAST(page_id AS STRING) || '.html'
    ELSE 'www.example.com/p' || CAST(page_id AS STRING) END AS url
FROM pages
""", ["pages"])

# v_add_requests: /add glob requests per session, against the session's repo
_view("v_add_requests", f"""
SELECT c.conv_id, f.repo_id, CASE c.conv_id % 5 WHEN 0 THEN 'en/*.py' WHEN 1 THEN '*/doc_1*.go'
    WHEN 2 THEN f.path WHEN 3 THEN '**/doc_3?.rs' ELSE 'nowhere/*.zz' END AS pattern
FROM (SELECT DISTINCT conv_id, conv_id % {_DOC_REF} AS doc_ref FROM conversations) c
JOIN v_files f ON f.doc_id = c.doc_ref
""", ["conversations", "documents", "v_files"])

# v_messages: messages with image references (valid data:/http and invalid)
_view("v_messages", """
SELECT conv_id, turn, role, text AS content,
  CASE turn % 4 WHEN 1 THEN array('data:image/png;base64,iVBORw0KGgo=', 'ftp://img/' || CAST(conv_id AS STRING) || '.png')
                WHEN 2 THEN array('https://img.example.com/' || CAST(conv_id AS STRING) || '.jpg')
                WHEN 3 THEN array('file:///tmp/x.png')
                ELSE CAST(array() AS ARRAY<STRING>) END AS images
FROM conversations
""", ["conversations"], duck="""
SELECT conv_id, turn, role, text AS content,
  CASE turn % 4 WHEN 1 THEN ['data:image/png;base64,iVBORw0KGgo=', 'ftp://img/' || CAST(conv_id AS VARCHAR) || '.png']
                WHEN 2 THEN ['https://img.example.com/' || CAST(conv_id AS VARCHAR) || '.jpg']
                WHEN 3 THEN ['file:///tmp/x.png']
                ELSE CAST([] AS VARCHAR[]) END AS images
FROM conversations
""")


# v_parts: message contents as JSON: a string, text with an image, several texts (one without text), an image alone, null
_PARTS = """
SELECT conv_id, turn, role, CASE mod(turn, 6) WHEN 0 THEN quoted
    WHEN 1 THEN '[{"type":"text","text":' || quoted || '},{"type":"image_url","image_url":{"url":"data:x"}}]'
    WHEN 2 THEN '[{"type":"text","text":' || quoted || '},{"type":"text"},{"type":"text","text":"and more"}]'
    WHEN 3 THEN '[{"type":"image_url","image_url":{"url":"data:y"}}]'
    WHEN 4 THEN 'null' END AS content
FROM (SELECT *, %s AS quoted FROM conversations) c
"""
_view("v_parts", _PARTS % "substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)", ["conversations"],
      duck=_PARTS % "CAST(to_json(text) AS VARCHAR)")

# v_drops: a /drop request for every second file of a session and, where seq % 4 = 0, the same once more:
# by full path, by basename under another folder, or a name that matches nothing
_DROP_PATH = """CASE (conv_id + seq) % 3 WHEN 0 THEN path WHEN 1 THEN 'elsewhere/' || split_part(path, '/', 2)
    ELSE 'nope.py' END AS drop_path"""
_view("v_drops", f"""
SELECT conv_id, 2 * seq AS drop_id, {_DROP_PATH} FROM v_chat_files WHERE seq % 2 = 0
UNION ALL
SELECT conv_id, 2 * seq + 1 AS drop_id, {_DROP_PATH} FROM v_chat_files WHERE seq % 4 = 0
""", ["v_chat_files"])


# v_fuzzy: search texts that a file holds only up to white space (lines stripped, blanks doubled), or not at all
_view("v_fuzzy", """
SELECT repo_id, path, doc_id, CASE doc_id % 4
    WHEN 0 THEN '  ' || split_part(content, chr(10), 1) || '  ' || chr(10) || chr(9) || split_part(content, chr(10), 2) || chr(10)
    WHEN 1 THEN replace(split_part(content, chr(10), 1), ' ', '  ')
    WHEN 2 THEN 'absent text' || chr(10) || 'twice'
    ELSE ' ' || split_part(content, chr(10), 1) || chr(9) END AS original,
  '# one' || chr(10) || '# two' || chr(10) AS updated
FROM v_files
""", ["v_files"])

# v_diffs: diffs of one to four hunks: a longer first line, lines put in front, one behind the last, lines far below
_view("v_diffs", """
SELECT repo_id, path, doc_id,
  '--- a/' || path || chr(10) || '+++ b/' || path || chr(10)
  || '@@ -1,1 +1,3 @@' || chr(10) || '-' || split_part(content, chr(10), 1) || chr(10) || '+first' || chr(10) || '+second' || chr(10)
  || '+third' || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '@@ -0,0 +1,1 @@' || chr(10) || '+top' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 4 < 2 THEN '@@ -2,2 +4,1 @@ def' || chr(10) || ' kept' || chr(10) || '-gone' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN '@@ -9999,1 +9999,1 @@' || chr(10) || '-far' || chr(10) || '+away' || chr(10) ELSE '' END
  || '@@ -4 +' || CAST(doc_id % 9 AS STRING) || ' @@' || chr(10) || '-x' || chr(10) || '+y' || chr(10) AS diff
FROM v_files
""", ["v_files"])


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in seen:
            seen.append(n)
    for n in names:
        visit(n)
    return seen


def with_views(body: str, views: list[str]) -> str:
    """DuckDB oracle text: the needed derived views as a WITH clause."""
    need = [v for v in _order(views) if v in VIEWS]
    if not need:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS_DUCK.get(v, VIEWS[v]).strip()})" for v in need)
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.lstrip().upper().startswith(word):
            return f"{word}{ctes},\n{body.lstrip()[len(word):]}"
    return f"WITH {ctes}\n{body}"


def register(spark: SparkSession, sf_dir: str, views: list[str] | None = None) -> None:
    """Register the derived views ``views`` (all, by default) as temp views, and of the
    base tables of ``sf_dir`` only those that they read or that ``views`` names."""
    for v in _order(views if views is not None else [*BASE_TABLES, *VIEWS]):
        if v in VIEWS:
            spark.sql(VIEWS[v]).createOrReplaceTempView(v)
        else:
            spark.read.parquet(f"{sf_dir}/{v}.parquet").createOrReplaceTempView(v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or derived view of ``sf_dir`` as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    register(spark, sf_dir, [name])
    return spark.table(name)
