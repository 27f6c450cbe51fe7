"""Chat accounting queries (A1-A3, A5, A6, A9, J-2, K3, K4, S3, S9-S11, S15, W1, W2, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus import dims
from codecorpus.functions.patterns import LINE_BREAK, LINE_TERM_CLASS
from codecorpus.functions.text import count_tokens
from codecorpus.operators import chat
from codecorpus.plans.q_corpus import scanned_sql, session_map_ctes
from codecorpus.plans.registry import query
from codecorpus.session import spread

TOK = "greatest(1, length({x}) // 4)"


def tok(x: str) -> str:
    return TOK.format(x=x)


def _dbl(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def catalog_ctes() -> str:
    """DuckDB CTEs for the constant model catalog and alias list."""
    rows = ",\n".join(
        f"('{m}', {c}, {o}, {_dbl(i)}, {_dbl(u)}, {str(v).lower()}, '{p}', {n})"
        for n, (m, c, o, i, u, v, p) in enumerate(dims.MODELS))
    al = ",\n".join(f"('{a}', '{m}')" for a, m in dims.MODEL_ALIASES)
    ctx, mo, cin, cout, vis, prov = dims.UNKNOWN_MODEL
    return f"""m_models AS (SELECT * FROM (VALUES {rows}) t(model, context_window, max_output,
    cost_per_1k_input, cost_per_1k_output, supports_vision, provider, catalog_no)),
m_aliases AS (SELECT * FROM (VALUES {al}) t(alias, alias_model)),
m_resolved AS (
  SELECT s.conv_id, s.model, coalesce(a.alias_model, s.model) AS resolved,
    CAST(coalesce(m.context_window, {ctx}) AS INTEGER) AS context_window,
    CAST(coalesce(m.max_output, {mo}) AS INTEGER) AS max_output,
    coalesce(m.cost_per_1k_input, {_dbl(cin)}) AS cost_per_1k_input,
    coalesce(m.cost_per_1k_output, {_dbl(cout)}) AS cost_per_1k_output,
    coalesce(m.supports_vision, {str(vis).lower()}) AS supports_vision,
    coalesce(m.provider, '{prov}') AS provider
  FROM v_sessions s LEFT JOIN m_aliases a ON a.alias = s.model
  LEFT JOIN m_models m ON m.model = coalesce(a.alias_model, s.model))"""


def _messages(spark):
    return spark.table("conversations").withColumnRenamed("text", "content")


# ---------------------------------------------------------------- J-2 / S3
@query("resolve_model", ["v_sessions"], sql="WITH " + catalog_ctes() + """
SELECT conv_id, model, resolved, context_window, max_output, cost_per_1k_input, cost_per_1k_output,
       supports_vision, provider FROM m_resolved""")
def q_resolve_model(spark):
    """J-2: session model -> canonical model and catalog facts (defaults for unknown)."""
    return chat.resolve_model(spark.table("v_sessions")).select(
        "conv_id", "model", "resolved", "context_window", "max_output", "cost_per_1k_input",
        "cost_per_1k_output", "supports_vision", "provider")


@query("normalise_model", ["v_sessions"], sql="""
SELECT conv_id, model, CASE WHEN contains(model, 'claude') OR contains(model, 'deepseek') OR contains(model, 'gemini')
  THEN 'gpt-4o' WHEN contains(model, 'gpt-4') OR contains(model, 'o1') OR contains(model, 'o3') THEN 'gpt-4o'
  WHEN contains(model, 'gpt-3.5') THEN 'gpt-3.5-turbo' ELSE model END AS tokenizer_model
FROM v_sessions""")
def q_normalise_model(spark):
    """S3: tokenizer family of each session's model name."""
    s = spark.table("v_sessions")
    return s.select("conv_id", "model", chat.normalise_model(F.col("model")).alias("tokenizer_model"))


# ---------------------------------------------------------------- A1 / A2 / A3
@query("message_tokens", ["conversations"], sql=f"""
SELECT conv_id, sum({tok('text')} + 4) AS message_tokens, count(*) AS n_messages
FROM conversations GROUP BY conv_id""")
def q_message_tokens(spark):
    """A1: per-session message tokens + 4 per message."""
    return chat.message_tokens(_messages(spark))


@query("count_tokens", ["documents"], sql=f"""
SELECT doc_id, CAST({tok('text')} AS BIGINT) AS tokens, length(text) AS n_chars FROM documents""")
def q_count_tokens(spark):
    """Token estimate of every document."""
    d = spark.table("documents")
    return d.select("doc_id", count_tokens("text").alias("tokens"), F.length("text").alias("n_chars"))


_DEDUP_SQL = """(SELECT conv_id, repo_id, path, seq, read_only FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, repo_id, path ORDER BY seq) AS rn FROM v_chat_files) x
  WHERE rn = 1)"""


@query("dedupe_files", ["v_chat_files"], sql=f"SELECT conv_id, repo_id, path, seq, read_only FROM {_DEDUP_SQL} d")
def q_dedupe_files(spark):
    """A file is added to a session once; the first add wins."""
    return chat.dedupe_files(spark.table("v_chat_files")).select("conv_id", "repo_id", "path", "seq", "read_only")


@query("context_tokens", ["v_chat_files", "v_files"], sql=f"""
WITH ft AS (SELECT d.conv_id, sum({tok('f.content')}) AS file_tokens
            FROM {_DEDUP_SQL} d JOIN v_files f ON f.repo_id = d.repo_id AND f.path = d.path GROUP BY d.conv_id),
     mt AS (SELECT conv_id, sum({tok('text')}) AS message_tokens FROM conversations GROUP BY conv_id)
SELECT coalesce(mt.conv_id, ft.conv_id) AS conv_id, CAST(coalesce(file_tokens, 0) AS BIGINT) AS file_tokens,
  CAST(coalesce(message_tokens, 0) AS BIGINT) AS message_tokens,
  CAST(coalesce(file_tokens, 0) + coalesce(message_tokens, 0) AS BIGINT) AS total_tokens
FROM mt FULL OUTER JOIN ft ON mt.conv_id = ft.conv_id""")
def q_context_tokens(spark):
    """A2: chat-file tokens + message tokens per session (no per-message overhead)."""
    return chat.context_tokens(spark.table("v_files"), spark.table("v_chat_files"), _messages(spark))


_USAGE_SQL = f"""u AS (
  SELECT p.conv_id, r.resolved, r.provider, p.prompt_tokens, p.completion_tokens,
    p.prompt_tokens + p.completion_tokens AS total_tokens,
    CAST(p.prompt_tokens AS DECIMAL(20,0)) * CAST(r.cost_per_1k_input AS DECIMAL(12,8)) * 0.001
      + CAST(p.completion_tokens AS DECIMAL(20,0)) * CAST(r.cost_per_1k_output AS DECIMAL(12,8)) * 0.001 AS cost
  FROM (SELECT conv_id,
          sum(CASE WHEN role IN ('system', 'user') THEN {tok('text')} ELSE 0 END) AS prompt_tokens,
          sum(CASE WHEN role = 'assistant' THEN {tok('text')} ELSE 0 END) AS completion_tokens
        FROM conversations GROUP BY conv_id) p JOIN m_resolved r ON r.conv_id = p.conv_id)"""


@query("usage_cost", ["v_sessions"], sql="WITH " + catalog_ctes() + ",\n" + _USAGE_SQL + """
SELECT provider, resolved AS model, count(*) AS sessions, sum(prompt_tokens) AS prompt_tokens,
  sum(completion_tokens) AS completion_tokens, sum(total_tokens) AS total_tokens,
  CAST(round(sum(cost), 8) AS DOUBLE) AS cost_usd
FROM u GROUP BY provider, resolved""")
def q_usage_cost(spark):
    """A3: usage and cost summed per provider and canonical model."""
    return chat.usage_cost(_messages(spark), spark.table("v_sessions"))


@query("cost_string", ["v_sessions"], sql="WITH " + catalog_ctes() + ",\n" + _USAGE_SQL + """
SELECT conv_id, 'Tokens: ' || format('{:,}', total_tokens) || ' (' || format('{:,}', prompt_tokens) || ' in + '
  || format('{:,}', completion_tokens) || ' out) | Cost: $' || format('{:.4f}', CAST(round(cost, 4) AS DOUBLE)) AS cost_line
FROM u""")
def q_cost_string(spark):
    """The usage line of every session."""
    u = chat.session_usage(_messages(spark), spark.table("v_sessions"))
    return u.select("conv_id", chat.cost_string(F.col("prompt_tokens"), F.col("completion_tokens"),
                                                F.round("cost", 4).cast("double")).alias("cost_line"))


# ---------------------------------------------------------------- K3 / K4
@query("list_models", ["v_sessions"], sql="WITH " + catalog_ctes() + """
SELECT m.model, m.provider FROM m_models m WHERE m.provider IN (SELECT provider FROM m_resolved)""")
def q_list_models(spark):
    """K3: sorted catalog names of every provider the sessions use."""
    return chat.list_models(spark, used=chat.resolve_model(spark.table("v_sessions")))


@query("list_provider_models", ["v_sessions"], sql="WITH " + catalog_ctes() + """
SELECT m.model, m.provider FROM m_models m
WHERE m.provider = 'openai' AND m.provider IN (SELECT provider FROM m_resolved)""")
def q_list_provider_models(spark):
    """K3: the catalog names of one provider, if sessions use it."""
    return chat.list_models(spark, "openai", chat.resolve_model(spark.table("v_sessions")))


@query("model_table", ["v_sessions"], sql="WITH " + catalog_ctes() + """
SELECT CAST(row_number() OVER (ORDER BY provider, catalog_no) AS INTEGER) AS line_no, model,
  format('{:<45} {:<12} {:>8} {:>6} {:>8} {:>6}', model, provider, format('{:,}', context_window),
         format('{:,}', max_output), format('{:.4f}', cost_per_1k_input),
         CASE WHEN supports_vision THEN '✓' ELSE '' END) AS line
FROM m_models WHERE model IN (SELECT resolved FROM m_resolved)""")
def q_model_table(spark):
    """K4: formatted catalog lines (provider order, stable) for the models in use."""
    used = chat.resolve_model(spark.table("v_sessions")).select(F.col("resolved").alias("model"))
    return chat.model_table(spark, used)


# ---------------------------------------------------------------- W1 / W2 / W7
@query("last_20_messages", ["conversations"], sql="""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
  FROM conversations) x WHERE rn <= 20""")
def q_last_20(spark):
    """The history window (last 20 messages per session)."""
    return chat.last_n_messages(spark.table("conversations"), 20).select("conv_id", "turn", "role")


@query("last_3_messages", ["conversations"], sql="""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
  FROM conversations) x WHERE rn <= 3""")
def q_last_3(spark):
    """W1 with a small window so the cap bites on the test sessions."""
    return chat.last_n_messages(spark.table("conversations"), 3).select("conv_id", "turn", "role")


_LT = LINE_TERM_CLASS[1:-1]
_KEEP = "[^" + _LT + "]*" + LINE_BREAK + "|[^" + _LT + "]+"


@query("truncate_to_tokens", ["documents"], sql=f"""
WITH l AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_KEEP}')) AS line,
                  unnest(generate_series(1, len(regexp_extract_all(text, '{_KEEP}')))) AS ln
           FROM documents WHERE {tok('text')} > 50),
     r AS (SELECT doc_id, line, ln, sum({tok('line')}) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM l),
     cut AS (SELECT doc_id, coalesce(min(CASE WHEN run > 50 THEN ln END), 1000000000) AS first_over
             FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN {tok('d.text')} <= 50 THEN d.text
  ELSE coalesce((SELECT string_agg(r.line, '' ORDER BY r.ln) FROM r JOIN cut c ON c.doc_id = r.doc_id
                 WHERE r.doc_id = d.doc_id AND r.ln < c.first_over), '') END AS truncated
FROM documents d""")
def q_truncate(spark):
    """Every document truncated to 50 tokens at a line boundary."""
    d = spread(spark.table("documents").select("doc_id", "text"))
    return d.select("doc_id", chat.truncate_to_tokens(F.col("text"), 50).alias("truncated"))


_FILES_SECTION_SQL = f"""fs AS (
  SELECT d.conv_id, string_agg('### ' || d.path || CASE WHEN d.read_only THEN ' (read-only)' ELSE '' END
      || chr(10) || '```' || {{lang}} || chr(10) || f.content || chr(10) || '```', chr(10) || chr(10)
      ORDER BY d.seq, d.path) AS files_section, count(*) AS n_files
  FROM {_DEDUP_SQL} d JOIN v_files f ON f.repo_id = d.repo_id AND f.path = d.path GROUP BY d.conv_id)"""


def _lang_case(path: str) -> str:
    """DuckDB CASE for J-3 (extension map + special basenames)."""
    name = f"lower(string_split({path}, '/')[-1])"
    sfx = f"lower(regexp_extract(string_split({path}, '/')[-1], '^.+(\\.[^.]+)$', 1))"
    whens = " ".join(f"WHEN {sfx} = '{e}' THEN '{lang}'" for e, lang in dims.EXT_TO_LANG)
    specials = " ".join(f"WHEN {name} = '{n}' THEN '{lang}'" for n, lang in dims.SPECIAL_NAMES)
    return f"(CASE {specials} {whens} ELSE '' END)"


@query("files_section", ["v_chat_files", "v_files"],
       sql="WITH " + _FILES_SECTION_SQL.format(lang=_lang_case("d.path")) + "\nSELECT conv_id, files_section, n_files FROM fs")
def q_files_section(spark):
    """The files section of each session's system prompt."""
    return chat.files_section(spark.table("v_files"), spark.table("v_chat_files")).select(
        "conv_id", "files_section", "n_files")


@query("files_section_forms", ["v_chat_files", "v_files"],
       sql="WITH " + _FILES_SECTION_SQL.format(lang=_lang_case("d.path")).replace("CASE WHEN d.read_only THEN ' (read-only)' ELSE '' END", "''")
       + ",\n" + _FILES_SECTION_SQL.format(lang="''").replace("CASE WHEN d.read_only THEN ' (read-only)' ELSE '' END", "''").replace("fs AS", "fa AS", 1)
       + """
SELECT conv_id, 'agent' AS form, n_files, md5('Relevant files:' || chr(10) || chr(10) || files_section) AS message_md5 FROM fa
UNION ALL SELECT conv_id, 'architect', n_files, md5('Here are the relevant files:' || chr(10) || chr(10) || files_section) FROM fs""")
def q_files_section_forms(spark):
    """The files of each session as an agent and the architect are shown them."""
    f, cf = spark.table("v_files"), spark.table("v_chat_files")
    both = chat.files_message(f, cf, "agent").unionByName(chat.files_message(f, cf, "architect"))
    return both.select("conv_id", "form", "n_files", F.md5("message").alias("message_md5"))


def _q(text: str) -> str:
    """A Python text as a DuckDB literal."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_PROMPT_CTES = (session_map_ctes(scanned_sql("v_files")) + ",\n" + _FILES_SECTION_SQL.format(lang=_lang_case("d.path")) + f""",
first_repo AS (SELECT conv_id, repo_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq, repo_id, path) AS rn
               FROM v_chat_files) x WHERE rn = 1),
pr AS (SELECT c.conv_id, c.n, {_q(chat.PROMPT_HEAD)} || CASE WHEN coalesce(sm.repo_map, '') = '' THEN {_q(chat.NO_MAP)}
         ELSE chr(10) || sm.repo_map || chr(10) END || {_q(chat.PROMPT_FILES)} || coalesce(fs.files_section, {_q(chat._FILES_PLACEHOLDER)})
         || {_q(chat.PROMPT_FOOT)} AS prompt
       FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c
       LEFT JOIN first_repo r ON r.conv_id = c.conv_id LEFT JOIN sm ON sm.conv_id = c.conv_id AND sm.repo_id = r.repo_id
       LEFT JOIN fs ON fs.conv_id = c.conv_id)""")


@query("context_limit_flag", ["v_sessions", "v_chat_files", "v_files", "v_gitignore"],
       sql="WITH " + catalog_ctes() + ",\n" + _PROMPT_CTES + f""",
h AS (SELECT conv_id, turn, role, {tok('text')} AS tok,
        coalesce(sum({tok('text')}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)
          AS history_tokens FROM conversations)
SELECT h.conv_id, h.turn, CAST({tok('pr.prompt')} + h.history_tokens + h.tok AS BIGINT) AS estimated_tokens,
  coalesce(r.context_window, {dims.UNKNOWN_MODEL[0]}) AS context_window,
  {tok('pr.prompt')} + h.history_tokens + h.tok > coalesce(r.context_window, {dims.UNKNOWN_MODEL[0]}) * 0.9 AS over_limit
FROM h JOIN pr ON pr.conv_id = h.conv_id LEFT JOIN m_resolved r ON r.conv_id = h.conv_id
WHERE h.role = 'user'""")
def q_context_limit(spark):
    """Per user turn, estimated prompt tokens against 90% of the model's window."""
    return chat.context_limit_flag(_messages(spark), spark.table("v_sessions"), spark.table("v_files"),
                                   spark.table("v_chat_files"), rules=spark.table("v_gitignore"))


@query("multipart_tokens", ["v_parts"], sql=f"""
SELECT conv_id, CAST(sum(4 + CASE json_type(content) WHEN 'VARCHAR' THEN {tok("json_extract_string(content, '$')")}
    WHEN 'ARRAY' THEN coalesce(list_sum(list_transform(list_filter(CAST(json(content) AS JSON[]),
      lambda p: json_extract_string(p, '$.type') = 'text'),
      lambda p: {tok("coalesce(json_extract_string(p, '$.text'), '')")})), 0) ELSE 0 END) AS BIGINT) AS message_tokens,
  count(*) AS n_messages
FROM v_parts GROUP BY conv_id""")
def q_multipart_tokens(spark):
    """A1: message tokens of contents that are strings, lists of parts, images alone or null."""
    return chat.multipart_tokens(spark.table("v_parts"))


# ---------------------------------------------------------------- S9 / F9
@query("message_json", ["v_messages"], sql="""
SELECT conv_id, turn, CAST(len(list_filter(images, lambda x: starts_with(x, 'data:') OR starts_with(x, 'http'))) AS INTEGER) AS n_images,
  CASE WHEN len(images) > 0 THEN
    CAST(json_object('role', role, 'content', list_concat([json_object('type', 'text', 'text', content)],
      list_transform(list_filter(images, lambda x: starts_with(x, 'data:') OR starts_with(x, 'http')),
                     lambda x: json_object('type', 'image_url', 'image_url', json_object('url', x))))) AS VARCHAR)
  ELSE CAST(json_object('role', role, 'content', content) AS VARCHAR) END AS message_json
FROM v_messages""")
def q_message_json(spark):
    """S9 + F9: API message JSON; image parts only for data:/http references."""
    return chat.message_json(spark.table("v_messages"))


# ---------------------------------------------------------------- A5 / S10 / S11
@query("assemble_chunks", ["v_chunks"], sql="""
SELECT response_id, coalesce(string_agg(delta, '' ORDER BY seq), '') AS text, CAST(count(delta) AS BIGINT) AS n_chunks
FROM v_chunks GROUP BY response_id""")
def q_assemble_chunks(spark):
    """A5: reply text = its deltas concatenated in seq order (NULL deltas skipped)."""
    c = spark.table("v_chunks")
    return (c.groupBy("response_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))),
                                          lambda x: x["delta"]), "").alias("text"),
                 F.count("delta").alias("n_chunks")))


@query("drop_files", ["v_chat_files", "v_drops"], sql=f"""
WITH cf AS {_DEDUP_SQL},
nth_file AS (SELECT *, string_split(path, '/')[-1] AS name, row_number() OVER (
               PARTITION BY conv_id, string_split(path, '/')[-1] ORDER BY seq, repo_id, path) AS n FROM cf),
nth_drop AS (SELECT *, string_split(drop_path, '/')[-1] AS name, row_number() OVER (
               PARTITION BY conv_id, string_split(drop_path, '/')[-1] ORDER BY drop_id) AS n FROM v_drops)
SELECT conv_id, repo_id, path, seq FROM nth_file f
WHERE NOT EXISTS (SELECT 1 FROM nth_drop d WHERE d.conv_id = f.conv_id AND d.name = f.name AND d.n = f.n)""")
def q_drop_files(spark):
    """J-4: session files left after each /drop (first match by path or basename removed)."""
    cf = chat.dedupe_files(spark.table("v_chat_files"))
    return chat.drop_files(cf, spark.table("v_drops")).select("conv_id", "repo_id", "path", "seq")


@query("render_prompt", ["v_chat_files", "v_files", "v_gitignore"], sql="WITH " + _PROMPT_CTES + f"""
SELECT conv_id, least(n - 1, {dims.HISTORY_MESSAGES}) + 2 AS n_messages, CAST(length(prompt) AS INTEGER) AS prompt_chars,
  CAST({tok('prompt')} AS BIGINT) AS prompt_tokens, md5(prompt) AS prompt_md5 FROM pr""")
def q_render_prompt(spark):
    """Per session, system prompt (its own map of its first file's repo, files
    section, edit-format note) as length, tokens and md5, and the message count sent
    (system, up to 20 before the current one, current)."""
    m = _messages(spark)
    sent = m.groupBy("conv_id").agg((F.least(F.count(F.lit(1)) - 1, F.lit(dims.HISTORY_MESSAGES)) + 2).alias("n_messages"))
    prompts = chat.system_prompts(spark.table("v_files"), spark.table("v_chat_files"), m, spark.table("v_gitignore"))
    return (sent.join(prompts, "conv_id")
            .select("conv_id", "n_messages", F.length("prompt").alias("prompt_chars"),
                    count_tokens("prompt").alias("prompt_tokens"), F.md5("prompt").alias("prompt_md5")))
