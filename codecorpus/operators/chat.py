"""Chat and context accounting: tokens, history, limits, cost, prompts.

All operators are built-ins. The model catalog / alias tables are constant
(32 / 17 rows) and broadcast; everything else is grouped by ``conv_id`` with
partial (map-side) aggregation, so no session's rows are ever collected
into one task except for the bounded string aggregations noted below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecorpus import dims
from codecorpus.functions.text import count_tokens
from codecorpus.session import staged

# FIXED VALUES -- texts of the prompts around files and maps
_FILES_PLACEHOLDER = "(no files added yet — use /add <filename> to add files)"
NO_MAP = "(no repo map available)"
AGENT_FILES = "Relevant files:\n\n"
ARCHITECT_FILES = "Here are the relevant files:\n\n"

# The system prompt around them, our own wording.
PROMPT_HEAD = "You are an expert software engineer working in a repository.\n\n"
PROMPT_FILES = "\n\n## Files in chat\n\n"
PROMPT_FOOT = "\n\nReply with SEARCH/REPLACE blocks."


# ---------------------------------------------------------------------------
# S3 / J-2: model names
# ---------------------------------------------------------------------------
def normalise_model(model: Column) -> Column:
    """Tokenizer family of a model name (substring rules, in order)."""
    return (F.when(model.contains("claude") | model.contains("deepseek") | model.contains("gemini"), "gpt-4o")
            .when(model.contains("gpt-4") | model.contains("o1") | model.contains("o3"), "gpt-4o")
            .when(model.contains("gpt-3.5"), "gpt-3.5-turbo")
            .otherwise(model))


def resolve_model(df: DataFrame, model_col: str = "model") -> DataFrame:
    """Alias -> canonical name, then catalog lookup with defaults for unknowns.

    Both dimensions are constant-size, so they are broadcast explicitly.
    """
    spark = df.sparkSession
    aliases = F.broadcast(dims.aliases_df(spark))
    models = F.broadcast(dims.models_df(spark))
    ctx, mo, cin, cout, vis, prov = dims.UNKNOWN_MODEL
    out = (df.join(aliases, df[model_col] == aliases["alias"], "left")
             .withColumn("resolved", F.coalesce(F.col("alias_model"), F.col(model_col)))
             .drop("alias", "alias_model"))
    out = out.join(models.withColumnRenamed("model", "_cat_model"),
                   F.col("resolved") == F.col("_cat_model"), "left")
    return (out.withColumn("context_window", F.coalesce("context_window", F.lit(ctx)))
               .withColumn("max_output", F.coalesce("max_output", F.lit(mo)))
               .withColumn("cost_per_1k_input", F.coalesce("cost_per_1k_input", F.lit(cin)))
               .withColumn("cost_per_1k_output", F.coalesce("cost_per_1k_output", F.lit(cout)))
               .withColumn("supports_vision", F.coalesce("supports_vision", F.lit(vis)))
               .withColumn("provider", F.coalesce("provider", F.lit(prov)))
               .drop("_cat_model", "catalog_no"))


def _catalog(spark: SparkSession, column: str, used: DataFrame | None) -> DataFrame:
    """The catalog, or its rows whose ``column`` occurs in ``used``. Names in
    ``used`` are free text; only those of the catalog are kept before the join."""
    m = dims.models_df(spark)
    if used is None:
        return m
    known = used.join(F.broadcast(m.select(column).distinct()), column, "left_semi").select(column).distinct()
    return m.join(known, column, "left_semi")


def list_models(spark: SparkSession, provider: str | None = None, used: DataFrame | None = None) -> DataFrame:
    """K3: catalog names, optionally for one provider or the providers in ``used``, sorted."""
    m = _catalog(spark, "provider", used)
    if provider:
        m = m.filter(F.col("provider") == provider)
    return m.select("model", "provider").orderBy("model")


def model_table(spark: SparkSession, used: DataFrame | None = None) -> DataFrame:
    """K4: one formatted line per model (of those in ``used``), sorted by provider, stable on catalog order."""
    m = _catalog(spark, "model", used)
    line = F.format_string("%-45s %-12s %,8d %,6d %8.4f %6s", "model", "provider", "context_window",
                           "max_output", "cost_per_1k_input",
                           F.when(F.col("supports_vision"), "✓").otherwise(""))
    w = Window.orderBy("provider", "catalog_no")
    return m.select(F.row_number().over(w).alias("line_no"), "model", line.alias("line"))


# ---------------------------------------------------------------------------
# A1 / A2 / A3: token sums and cost
# ---------------------------------------------------------------------------
def message_tokens(messages: DataFrame, content: str = "content") -> DataFrame:
    """A1: per session, sum of message tokens + 4 per message."""
    return (messages.groupBy("conv_id")
            .agg(F.sum(count_tokens(content) + dims.MESSAGE_OVERHEAD_TOKENS).alias("message_tokens"),
                 F.count(F.lit(1)).alias("n_messages")))


def part_tokens(content: Column) -> Column:
    """A1: tokens of a message's VARIANT content: a string, or the text parts of a list; anything else has none."""
    kind = F.schema_of_variant(content)
    parts = F.try_variant_get(content, "$", "array<variant>")
    field = lambda p, name: F.coalesce(F.try_variant_get(p, f"$.{name}", "string"), F.lit(""))
    texts = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + F.when(
        field(p, "type") == "text", count_tokens(field(p, "text"))).otherwise(0))
    return (F.when(kind == "STRING", count_tokens(F.try_variant_get(content, "$", "string")))
            .when(kind.startswith("ARRAY"), texts).otherwise(0))


def multipart_tokens(messages: DataFrame, content: str = "content") -> DataFrame:
    """A1 on JSON content (a string, a list of parts, or null): as ``message_tokens``; images count nothing."""
    own = F.coalesce(part_tokens(F.parse_json(content)), F.lit(0))
    return (messages.groupBy("conv_id").agg(F.sum(own + dims.MESSAGE_OVERHEAD_TOKENS).alias("message_tokens"),
                                            F.count(F.lit(1)).alias("n_messages")))


def dedupe_files(chat_files: DataFrame) -> DataFrame:
    """A path is added to a session once; the first add wins."""
    w = Window.partitionBy("conv_id", "repo_id", "path").orderBy("seq")
    return (chat_files.withColumn("_rn", F.row_number().over(w))
            .filter("_rn = 1").drop("_rn"))


def context_tokens(files: DataFrame, chat_files: DataFrame, messages: DataFrame) -> DataFrame:
    """A2: file tokens + message tokens (no per-message overhead).

    The two sums are aggregated separately and then joined 1:1 on
    ``conv_id`` so the join never fans out.
    """
    cf = dedupe_files(chat_files).select("conv_id", "repo_id", "path")
    ftok = (cf.join(files.select("repo_id", "path", count_tokens("content").alias("tok")),
                    ["repo_id", "path"])
              .groupBy("conv_id").agg(F.sum("tok").alias("file_tokens")))
    mtok = messages.groupBy("conv_id").agg(F.sum(count_tokens("content")).alias("message_tokens"))
    return (mtok.join(ftok, "conv_id", "full_outer")
            .select("conv_id",
                    F.coalesce("file_tokens", F.lit(0)).cast("long").alias("file_tokens"),
                    F.coalesce("message_tokens", F.lit(0)).cast("long").alias("message_tokens"))
            .withColumn("total_tokens", F.col("file_tokens") + F.col("message_tokens")))


def session_usage(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session usage: prompt (system+user) and completion (assistant) tokens, cost in exact decimals."""
    tok = count_tokens("content")
    thousandth = F.lit(0.001).cast("decimal(4,3)")
    per = (messages.groupBy("conv_id")
           .agg(F.sum(F.when(F.col("role").isin("system", "user"), tok).otherwise(0)).alias("prompt_tokens"),
                F.sum(F.when(F.col("role") == "assistant", tok).otherwise(0)).alias("completion_tokens")))
    s = resolve_model(sessions).select("conv_id", "model", "resolved", "provider",
                                       "cost_per_1k_input", "cost_per_1k_output")
    return (per.join(s, "conv_id")
            .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
            .withColumn("cost", F.col("prompt_tokens").cast("decimal(20,0)")
                        * F.col("cost_per_1k_input").cast("decimal(12,8)") * thousandth
                        + F.col("completion_tokens").cast("decimal(20,0)")
                        * F.col("cost_per_1k_output").cast("decimal(12,8)") * thousandth))


def usage_cost(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """A3: component-wise usage sum per (provider, model)."""
    u = session_usage(messages, sessions)
    return (u.groupBy("provider", F.col("resolved").alias("model"))
            .agg(F.count(F.lit(1)).alias("sessions"),
                 F.sum("prompt_tokens").alias("prompt_tokens"),
                 F.sum("completion_tokens").alias("completion_tokens"),
                 F.sum("total_tokens").alias("total_tokens"),
                 F.round(F.sum("cost"), 8).cast("double").alias("cost_usd")))


def cost_string(prompt: Column, completion: Column, cost: Column) -> Column:
    """``Tokens: 1,234 (1,000 in + 234 out) | Cost: $0.0123``."""
    return F.format_string("Tokens: %,d (%,d in + %,d out) | Cost: $%.4f",
                           prompt + completion, prompt, completion, cost)


# ---------------------------------------------------------------------------
# History window, truncation, context warning
# ---------------------------------------------------------------------------
def last_n_messages(messages: DataFrame, n: int = dims.HISTORY_MESSAGES) -> DataFrame:
    """The last ``n`` messages of each session (row_number group limit)."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def truncate_to_tokens(text: Column, max_tokens: int | Column) -> Column:
    """Whole text if it fits, else the longest prefix of whole lines whose
    running token sum stays within ``max_tokens`` (stops at first overflow).

    Shuffle-free: one ``aggregate`` over the line array counts the kept lines.
    A line of n characters has at least n / 7 tokens, so what is kept lies in
    the first 7 characters a token, and only they are cut into lines (a line
    that ends beyond them, cut or not, has overflowed).
    """
    from codecorpus.functions.text import lines_keepends
    mx = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    fits = count_tokens(text) <= mx
    lines = lines_keepends(F.when(~fits, F.substring(text, F.lit(1), (mx * 7 + 1).cast("int"))))
    acc0 = F.struct(F.lit(0).cast("long").alias("tok"), F.lit(0).alias("k"), F.lit(False).alias("stop"))

    def step(acc, line):
        t = acc["tok"] + count_tokens(line)
        over = acc["stop"] | (t > mx)
        return F.struct(F.when(over, acc["tok"]).otherwise(t).alias("tok"),
                        F.when(over, acc["k"]).otherwise(acc["k"] + 1).alias("k"),
                        over.alias("stop"))
    kept = F.aggregate(lines, acc0, step)["k"]
    return F.when(fits, text).otherwise(F.array_join(F.slice(lines, F.lit(1), kept), ""))


def context_limit_flag(messages: DataFrame, sessions: DataFrame, files: DataFrame, chat_files: DataFrame,
                       history: int = dims.HISTORY_MESSAGES, rules: DataFrame | None = None) -> DataFrame:
    """Per user turn, estimated prompt tokens vs 0.9 x the context window.

    estimate = tokens(system prompt: map, files, instructions) + tokens of up to
    ``history`` earlier messages + tokens(current message). The running
    history sum is a bounded ROWS frame, no self-join.
    """
    sys_tok = system_prompt_tokens(files, chat_files, messages, rules)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-history, -1)
    m = (messages.withColumn("tok", count_tokens("content"))
         .withColumn("history_tokens", F.coalesce(F.sum("tok").over(w), F.lit(0)))
         .filter(F.col("role") == "user"))
    s = resolve_model(sessions).select("conv_id", "context_window")
    return (m.join(sys_tok, "conv_id", "left").join(s, "conv_id", "left")
            .select("conv_id", "turn",
                    (F.col("system_tokens") + F.col("history_tokens") + F.col("tok")).cast("long").alias("estimated_tokens"),
                    F.coalesce("context_window", F.lit(dims.UNKNOWN_MODEL[0])).alias("context_window"))
            .withColumn("over_limit", F.col("estimated_tokens") > F.col("context_window") * dims.CONTEXT_WARN_RATIO))


def files_section_chars(files: DataFrame, chat_files: DataFrame) -> DataFrame:
    """(conv_id, section_chars): the length of the A6 files section without building it:
    sum(len(part)) + 2 * (n - 1), each part's length computed from the
    file's content length map-side, so no content is shuffled."""
    from codecorpus.operators.corpus import detect_language
    cf = dedupe_files(chat_files).select("conv_id", "repo_id", "path", "read_only")
    f = files.select("repo_id", "path", F.length("content").alias("_clen"))
    part_len = (F.lit(len("### ")) + F.length("path")
                + F.when(F.col("read_only"), F.lit(len(" (read-only)"))).otherwise(F.lit(0))
                + F.lit(len("\n```")) + F.length(detect_language(F.col("path"))) + F.lit(1)
                + F.col("_clen") + F.lit(len("\n```")))
    return (cf.join(f, ["repo_id", "path"]).groupBy("conv_id")
            .agg((F.sum(part_len) + 2 * (F.count(F.lit(1)) - 1)).alias("section_chars")))


# ---------------------------------------------------------------------------
# Files section and prompt
# ---------------------------------------------------------------------------
def files_section(files: DataFrame, chat_files: DataFrame, form: str = "system") -> DataFrame:
    """Per session, ``### path`` + fenced content, joined by a blank line, in
    add order. The system prompt's form marks read-only files, it and the architect's
    name the language, the agent's does neither. Sessions without files get the
    placeholder (when the caller left-joins). The string aggregation is per session
    and bounded by the session's own context.

    The attached keys are staged first, so that their size is known: where they
    are few, they are broadcast and no content is shuffled to meet them.
    """
    from codecorpus.operators.corpus import detect_language
    cf = staged(dedupe_files(chat_files).select("conv_id", "repo_id", "path", "seq", "read_only"), "attached")
    mark = F.when(F.col("read_only") & F.lit(form == "system"), " (read-only)").otherwise("")
    language = F.lit("") if form == "agent" else detect_language(F.col("path"))
    parts = (files.select("repo_id", "path", "content").join(cf, ["repo_id", "path"])
             .withColumn("part", F.concat(F.lit("### "), "path", mark, F.lit("\n```"), language, F.lit("\n"), "content",
                                          F.lit("\n```"))))
    return (parts.groupBy("conv_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "path", "part"))),
                                          lambda x: x["part"]), "\n\n").alias("files_section"),
                 F.count(F.lit(1)).alias("n_files")))


def files_message(files: DataFrame, chat_files: DataFrame, form: str) -> DataFrame:
    """A6 as the message that shows a session's files to an agent or to the architect."""
    head = {"agent": AGENT_FILES, "architect": ARCHITECT_FILES}[form]
    return files_section(files, chat_files, form).select("conv_id", F.lit(form).alias("form"), "n_files",
                                                         F.concat(F.lit(head), "files_section").alias("message"))


def primary_maps(files: DataFrame, chat_files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(conv_id, repo_map): each session's map of the repo of the file that it added first."""
    from codecorpus.operators.repomap import session_maps
    first = chat_files.groupBy("conv_id").agg(F.min_by("repo_id", F.struct("seq", "repo_id", "path")).alias("repo_id"))
    return session_maps(files, chat_files, rules=rules).join(first, ["conv_id", "repo_id"]).select("conv_id", "repo_map")


def _map_part() -> Column:
    return F.when(F.coalesce("repo_map", F.lit("")) == "", F.lit(NO_MAP)).otherwise(F.concat(F.lit("\n"), "repo_map", F.lit("\n")))


def system_prompts(files: DataFrame, chat_files: DataFrame, sessions: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(conv_id, prompt) of every session: its repo map, its files and the note on the edit format."""
    prompt = F.concat(F.lit(PROMPT_HEAD), _map_part(), F.lit(PROMPT_FILES),
                      F.coalesce("files_section", F.lit(_FILES_PLACEHOLDER)), F.lit(PROMPT_FOOT))
    return (sessions.select("conv_id").distinct().join(primary_maps(files, chat_files, rules), "conv_id", "left")
            .join(files_section(files, chat_files), "conv_id", "left").select("conv_id", prompt.alias("prompt")))


def system_prompt_tokens(files: DataFrame, chat_files: DataFrame, sessions: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(conv_id, system_tokens) of ``system_prompts`` without building them: no content is shuffled."""
    fixed = len(PROMPT_HEAD) + len(PROMPT_FILES) + len(PROMPT_FOOT)
    chars = F.length(_map_part()) + F.coalesce("section_chars", F.lit(len(_FILES_PLACEHOLDER))) + fixed
    return (sessions.select("conv_id").distinct().join(primary_maps(files, chat_files, rules), "conv_id", "left")
            .join(files_section_chars(files, chat_files), "conv_id", "left")
            .select("conv_id", F.greatest(F.lit(1), F.floor(chars / 4)).cast("long").alias("system_tokens")))


def message_json(messages: DataFrame) -> DataFrame:
    """S9 + F9: API form of a message; image parts only for data:/http refs,
    and only when the message has images at all."""
    imgs = F.filter("images", lambda x: x.startswith("data:") | x.startswith("http"))
    parts = F.concat(
        F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"),
                         F.lit(None).cast("struct<url:string>").alias("image_url"))),
        F.transform(imgs, lambda u: F.struct(F.lit("image_url").alias("type"),
                                             F.lit(None).cast("string").alias("text"),
                                             F.struct(u.alias("url")).alias("image_url"))))
    with_img = F.to_json(F.struct(F.col("role"), parts.alias("content")), {"ignoreNullFields": "true"})
    plain = F.to_json(F.struct(F.col("role"), F.col("content")))
    has = F.coalesce(F.size("images"), F.lit(0)) > 0
    return messages.select("conv_id", "turn", F.size(imgs).alias("n_images"),
                           F.when(has, with_img).otherwise(plain).alias("message_json"))


def drop_files(chat_files: DataFrame, drops: DataFrame) -> DataFrame:
    """J-4: every drop request removes the first remaining file (add order) of
    its session whose path or basename it names.

    A file with the request's path has its basename too, so requests for one
    basename take that many files of it from the front, whatever their order:
    requests are counted map-side and met by one equi-join.
    """
    from codecorpus.functions.text import basename
    key = ["conv_id", "_name"]
    n = (drops.select("conv_id", basename(F.col("drop_path")).alias("_name"))
         .groupBy(*key).agg(F.count(F.lit(1)).alias("_dropped")))
    w = Window.partitionBy(*key).orderBy("seq", "repo_id", "path")
    return (chat_files.withColumn("_name", basename(F.col("path"))).withColumn("_rn", F.row_number().over(w))
            .join(n, key, "left").filter(F.col("_rn") > F.coalesce("_dropped", F.lit(0)))
            .select(*chat_files.columns))
