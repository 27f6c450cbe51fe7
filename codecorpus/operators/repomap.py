"""Ranked, token-budgeted repository map.

Plan (content never shuffled):

1. ``extract_symbols``: lines exploded map-side -> narrow tag rows.
2. ``file_blocks``: one shuffle of tag rows by (repo_id, salt of the path); per
   file its rank key ``min(struct(...))``, character count and rendered block.
3. ``map_budget``: a file is printed if the characters of the files ranked
   before it fit the budget. Those before it in its own salt are fewer, so each
   salt first keeps what fits by itself (in the stage of step 2), and only that
   is ranked per repo. No task holds a repo: at any budget the last step sees
   at most that budget's files from every salt.
4. ``render_map``: ``groupBy`` over the files kept to build the text.

A session's map leaves its own files out and ranks names that match them
first. Symbols are extracted once for all sessions; a session then needs its
matched files and the head of its repo's ranked list, as far as the budget and
the characters it takes out of the list reach (``session_maps``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus import dims
from codecorpus.functions.text import stem
from codecorpus.operators.corpus import extract_symbols, scan_repo_files
from codecorpus.session import spread, staged

#: Salts of the last but one cut, where there are more.
FEW_SALTS = 64
HEADER = "```\nRepo map:"
FOOTER = "```"
TRUNCATED = "  ... (truncated)"


def type_weight(t: Column) -> Column:
    out = F.lit(0)
    for name, wgt in reversed(dims.TYPE_WEIGHTS):
        out = F.when(t == name, F.lit(wgt)).otherwise(out)
    return out


def rank_tags(tags: DataFrame, chat_stems: DataFrame | None = None) -> DataFrame:
    """K1: add ``weight`` and ``name_match`` -- the sort key is
    (not name_match, -weight, path, line).

    ``chat_stems(repo_id, stem)``: stems of the chat files of each repo. A
    tag matches when its name, or its file's stem, equals one of them
    (lower-cased). Both tests are equi-joins on (repo_id, stem) against the
    distinct stems, so they never fan out."""
    t = tags.withColumn("weight", type_weight(F.col("type")))
    if chat_stems is None:
        return t.withColumn("name_match", F.lit(False))
    st = chat_stems.select("repo_id", F.lower("stem").alias("_s")).distinct()
    t = (t.withColumn("_n", F.lower("name")).withColumn("_fs", F.lower(stem(F.col("path"))))
         .join(st.withColumn("_m1", F.lit(True)).withColumnRenamed("_s", "_n"), ["repo_id", "_n"], "left")
         .join(st.withColumn("_m2", F.lit(True)).withColumnRenamed("_s", "_fs"), ["repo_id", "_fs"], "left"))
    return (t.withColumn("name_match", F.coalesce("_m1", F.lit(False)) | F.coalesce("_m2", F.lit(False)))
             .drop("_n", "_fs", "_m1", "_m2"))


def _salt(df: DataFrame, salts: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(salts))


def _salts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def file_blocks(ranked: DataFrame) -> DataFrame:
    """A4: group tags by file; groups ordered by first appearance in the
    ranked list, tags inside a file in ranked order."""
    tag_key = F.struct((~F.col("name_match")).alias("k1"), (-F.col("weight")).alias("k2"),
                       F.col("line").alias("k3"),
                       F.concat(F.lit("  "), "type", F.lit(" "), "name", F.lit(":")).alias("txt"))
    dealt = ranked.withColumn("_salt", _salt(ranked, _salts(ranked))).repartition("repo_id", "_salt")
    return (dealt.groupBy("repo_id", "_salt", "path")
            .agg(F.min(F.struct((~F.col("name_match")).alias("k1"), (-F.col("weight")).alias("k2")))
                  .alias("fkey"),
                 F.sum(F.length("type") + F.length("name") + 4).alias("tag_chars"),
                 F.array_sort(F.collect_list(tag_key)).alias("_tags"))
            .withColumn("chars", F.length("path") + F.col("tag_chars"))
            .withColumn("block", F.concat_ws("\n", F.col("path"),
                                             F.array_join(F.transform("_tags", lambda x: x["txt"]), "\n")))
            .drop("_tags", "tag_chars"))


def map_budget(blocks: DataFrame, max_map_tokens: int = dims.REPO_MAP_TOKENS,
               partition: list[str] | None = None, limit: str | None = None) -> DataFrame:
    """Keep file k iff the characters of files before k fit the budget
    (the overflowing file is still kept). Adds ``pos`` and ``cum_chars``.

    ``limit`` names a column with the budget in characters, equal within a
    partition. Files are cut in their salts, in fewer salts, then as a whole.
    """
    part = partition or ["repo_id"]
    budget = F.col(limit) if limit else F.lit(max_map_tokens * dims.CHARS_PER_MAP_TOKEN)
    salts = _salts(blocks)
    top = blocks if "_salt" in blocks.columns else blocks.withColumn("_salt", _salt(blocks, salts))
    order, upto = [F.col("fkey"), F.col("path")], (Window.unboundedPreceding, 0)

    def cut(df: DataFrame, keys: list) -> DataFrame:
        run = F.sum("chars").over(Window.partitionBy(*part, *keys).orderBy(*order).rowsBetween(*upto))
        return df.withColumn("cum_chars", run).filter(F.col("cum_chars") - F.col("chars") <= budget)

    top = cut(top, ["_salt"])
    if salts > FEW_SALTS:
        top = cut(top.withColumn("_salt", F.pmod("_salt", F.lit(FEW_SALTS))), ["_salt"])
    top = top.drop("_salt").withColumn("pos", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    return cut(top, [])


def render_map(kept: DataFrame, max_map_tokens: int = dims.REPO_MAP_TOKENS,
               partition: list[str] | None = None) -> DataFrame:
    """K2 text per repo: header, file blocks in rank order, truncation line
    when the last kept file overflowed, closing fence."""
    part = partition or ["repo_id"]
    budget = max_map_tokens * dims.CHARS_PER_MAP_TOKEN
    agg = (kept.groupBy(*part)
           .agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("_b"),
                F.max("cum_chars").alias("_cum"), F.count(F.lit(1)).alias("n_files")))
    body = F.array_join(F.transform("_b", lambda x: x["block"]), "\n")
    text = F.concat(F.lit(HEADER + "\n"), body,
                    F.when(F.col("_cum") > budget, F.lit("\n" + TRUNCATED)).otherwise(F.lit("")),
                    F.lit("\n" + FOOTER))
    return agg.select(*part, "n_files", text.alias("repo_map"))


def repo_map(files: DataFrame, max_map_tokens: int = dims.REPO_MAP_TOKENS,
             chat_files: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """K2 (flagship): scan -> S1 -> F7 -> A4 -> W3 -> text, per repo; ``rules`` are the
    repos' .gitignore lines, ``chat_files`` (repo_id, path) the files of one session.

    Repos whose files yield no tags get an empty string, as does a repo
    with no files at all (it simply has no row in ``files``)."""
    if chat_files is not None:
        one = chat_files.select(F.lit(0).alias("conv_id"), "repo_id", "path")
        others = files.join(chat_files.select("repo_id"), "repo_id", "left_anti")
        return (session_maps(files, one, max_map_tokens, rules).drop("conv_id")
                .unionByName(repo_map(others, max_map_tokens, rules=rules)))
    repos = scan_repo_files(files.select("repo_id", "path"), rules).select("repo_id").distinct()
    tags = extract_symbols(scan_repo_files(spread(files), rules))
    maps = render_map(map_budget(file_blocks(rank_tags(tags)), max_map_tokens), max_map_tokens)
    return (repos.join(maps, "repo_id", "left")
            .select("repo_id", F.coalesce("n_files", F.lit(0)).alias("n_files"),
                    F.coalesce("repo_map", F.lit("")).alias("repo_map")))


def session_maps(files: DataFrame, chat_files: DataFrame, max_map_tokens: int = dims.REPO_MAP_TOKENS,
                 rules: DataFrame | None = None) -> DataFrame:
    """K2 + K1 + J-1 of sessions: (conv_id, repo_id, n_files, repo_map) for every session
    and each repo of its files.

    The session's files are left out; a tag whose name, or whose file's stem, is the stem
    of one of them comes first, and so does its file. The repo's ranked list is cut once, at the
    budget and the most characters that any of its sessions takes out of the list; a session's
    own files and matched ones are taken out of its head, and the matched ones ranked before it.
    """
    own = ["conv_id", "repo_id"]
    attached = chat_files.select(*own, "path").distinct()
    stems = attached.select(*own, F.lower(stem(F.col("path"))).alias("_s")).distinct()
    tags = extract_symbols(scan_repo_files(spread(files), rules))
    tag = F.struct((-type_weight(F.col("type"))).alias("k2"), F.col("line").alias("k3"),
                   F.concat(F.lit("  "), "type", F.lit(" "), "name", F.lit(":")).alias("txt"), F.lower("name").alias("name"))
    base = staged(tags.groupBy("repo_id", "path").agg(F.array_sort(F.collect_list(tag)).alias("_tags"))
                  .withColumn("chars", F.length("path") + F.aggregate(
                      "_tags", F.lit(0), lambda n, t: n + F.length(t["txt"])))
                  .withColumn("fkey", F.struct(F.lit(True).alias("k1"), F.col("_tags")[0]["k2"].alias("k2"))), "map-files")

    # files whose name or symbols match a session's stems, in their session's order
    file_stem = F.lower(stem(F.col("path")))
    named = F.array_union(F.transform("_tags", lambda t: t["name"]), F.array(file_stem))
    index = base.select("repo_id", "path", F.explode(named).alias("_s"))
    matched = staged(index.join(stems, ["repo_id", "_s"]).groupBy(*own, "path").agg(F.collect_set("_s").alias("_stems")),
                     "map-matched")
    first = matched.join(attached, [*own, "path"], "left_anti").join(base.drop("fkey"), ["repo_id", "path"])
    by_match = F.array_sort(F.transform("_tags", lambda t: F.struct(
        (~(F.array_contains("_stems", t["name"]) | F.array_contains("_stems", file_stem))).alias("k1"), t["k2"].alias("k2"),
        t["k3"].alias("k3"), t["txt"].alias("txt"))))
    block = lambda ts: F.concat_ws("\n", F.col("path"), F.array_join(F.transform(ts, lambda t: t["txt"]), "\n"))
    first = (first.withColumn("_tags", by_match)
             .select(*own, "path", "chars", F.struct(F.col("_tags")[0]["k1"].alias("k1"), F.col("_tags")[0]["k2"].alias("k2"))
                     .alias("fkey"), block("_tags").alias("block")))

    taken = attached.unionByName(matched.select(*own, "path")).distinct()
    budget = max_map_tokens * dims.CHARS_PER_MAP_TOKEN
    reach = (attached.select(*own).distinct()
             .join(taken.join(base.select("repo_id", "path", "chars"), ["repo_id", "path"]).groupBy(*own)
                   .agg(F.sum("chars").alias("_taken")), own, "left")
             .select(*own, (F.coalesce("_taken", F.lit(0)) + budget).alias("_limit")))
    furthest = reach.groupBy("repo_id").agg(F.max("_limit").alias("_furthest"))
    head = map_budget(base.select("repo_id", "path", "chars", "fkey", block("_tags").alias("block")).join(furthest, "repo_id"),
                      limit="_furthest").drop("pos", "_furthest")
    rest = (head.join(reach, "repo_id").filter(F.col("cum_chars") - F.col("chars") <= F.col("_limit"))
            .join(taken, [*own, "path"], "left_anti").select(*own, "path", "chars", "fkey", "block"))
    kept = map_budget(first.unionByName(rest), max_map_tokens, own)
    return (attached.select(*own).distinct().join(render_map(kept, max_map_tokens, own), own, "left")
            .select(*own, F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("repo_map", F.lit("")).alias("repo_map")))
