"""Code-corpus scan and filters, symbol extraction.

The corpus is a table ``(repo_id, path, content)`` -- or Spark's
``binaryFile`` source for a directory tree. Filters are JVM-side regex
predicates placed before ``content`` is touched, so Parquet column pruning
keeps the content column out of the scan for path-only questions.
"""

from __future__ import annotations

import functools
import itertools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus import dims
from codecorpus.functions.patterns import combined_ignore_regex, fnmatch_regex, py_regex
from codecorpus.functions.text import basename, split_lines, suffix_lower
from codecorpus.session import staged

BUILTIN_IGNORE_RE = combined_ignore_regex(dims.BUILTIN_IGNORE)


def _lit_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for x in itertools.chain.from_iterable(pairs)])


def file_language(path: Column) -> Column:
    """Language by extension only ('' when unknown)."""
    return F.coalesce(F.element_at(_lit_map(dims.EXT_TO_LANG), suffix_lower(path)), F.lit(""))


def detect_language(path: Column) -> Column:
    """J-3: special basenames first (dockerfile, makefile), then extension."""
    name = F.lower(basename(path))
    out = file_language(path)
    for special, lang in reversed(dims.SPECIAL_NAMES):
        out = F.when(name == special, F.lit(lang)).otherwise(out)
    return out


def builtin_ignored(path: Column) -> Column:
    """the built-in ignore list as one regex (root-anchored when the
    pattern has an inner slash)."""
    return path.rlike(BUILTIN_IGNORE_RE)


def is_text_ext(path: Column) -> Column:
    """lower-cased suffix in the scanned-extension list."""
    return suffix_lower(path).isin(dims.text_extensions())


def scan_repo_files(tree: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``scan_repo_files``: keep files passing F1 and F3 (content untouched) and,
    with ``rules`` (repo_id, rule_no, rule) of root .gitignore files, F2."""
    kept = tree.filter(~builtin_ignored(F.col("path")) & is_text_ext(F.col("path")))
    return kept if rules is None else filter_repo_ignore(kept, rules)


def is_text(path: Column, content: Column) -> Column:
    """not a binary extension and no NUL byte in the first 8192 bytes.

    ``content`` is BINARY; a NULL (unreadable) file is not text."""
    head = F.substring(content, 1, 8192)
    return (~suffix_lower(path).isin(dims.BINARY_EXTENSIONS)
            & F.coalesce(F.position(F.lit(bytearray(b"\x00")), head) == 0, F.lit(False)))


# a valid UTF-8 sequence, one character a byte
_UTF8 = (r"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
         r"|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}")


def decode_text(raw: Column, errors: str = "replace") -> Column:
    """``read_text``: bytes as UTF-8; malformed ones become U+FFFD, or are left out with ``errors="ignore"``.

    Valid texts are taken as they are; of the others, a view with one character a
    byte is cut to its valid sequences.
    """
    text = raw.cast("string")
    if errors == "replace":
        return F.make_valid_utf8(text)
    kept = F.array_join(F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit(f"(?:{_UTF8})"), 0), "")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(F.encode(kept, "ISO-8859-1"), "UTF-8"))


def find_files(tree: DataFrame, patterns: list[str] | None = None,
               ignore_patterns: list[str] | None = None,
               max_files: int = dims.FIND_FILES_CAP) -> DataFrame:
    """``find_files``: include globs on the basename, ignore globs on the full
    path or basename (fnmatch: '*' crosses '/'); without include globs keep
    text files only; at most ``max_files`` per repo in path order.

    The cap is the operator's feature (a top-k per repo), done with a
    row_number group limit that Spark applies map-side before the shuffle.
    """
    path, name = F.col("path"), basename(F.col("path"))
    cond = F.lit(True)
    for p in ignore_patterns or []:
        rx = fnmatch_regex(p)
        cond = cond & ~path.rlike(rx) & ~name.rlike(rx)
    if patterns:
        inc = F.lit(False)
        for p in patterns:
            inc = inc | name.rlike(fnmatch_regex(p))
        cond = cond & inc
    else:
        cond = cond & is_text(path, F.col("content").cast("binary"))
    out = tree.filter(cond)
    w = Window.partitionBy("repo_id").orderBy("path")
    return (out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_files)
               .drop("_rn"))


def gitignore_rules(rules: DataFrame) -> DataFrame:
    """Translate ``(repo_id, rule_no, rule)`` gitignore lines to regexes.

    One tiny Python call per *rule* (rules, not files, grow here)."""
    from codecorpus.functions.udfs import gitignore_to_regex
    return (rules.withColumn("_t", gitignore_to_regex("rule"))
            .select("repo_id", "rule_no", "rule", F.col("_t.regex").alias("regex"),
                    F.col("_t.negate").alias("negate"))
            .filter(F.col("regex").isNotNull()))


def filter_repo_ignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    """root .gitignore per repo, last matching rule wins ('!' re-includes).

    A repo's rules are one ordered array, so a file meets one row: the join
    neither multiplies files nor needs a second pass over them. The rules' side
    is as small as the .gitignore files; AQE broadcasts it when its runtime size
    allows and splits a hot repo's files otherwise.
    """
    one = F.struct("rule_no", "regex", "negate")
    ordered = gitignore_rules(rules).groupBy("repo_id").agg(F.sort_array(F.collect_list(one)).alias("_rules"))
    hits = F.filter("_rules", lambda r: F.rlike(F.col("path"), r["regex"]))
    last = F.get(hits, F.size(hits) - 1)["negate"]
    return files.join(ordered, "repo_id", "left").filter(F.coalesce(last, F.lit(True))).select(*files.columns)


#: A glob's wild cards.
_WILD = r"[*?\[]"


def _pattern_key(pattern: Column) -> Column:
    """(kind, key) by which a glob's files are looked up: its first folder and extension as far as they are literal.

    Kind 'p' is a pattern without wild cards (key: the path), 'd' the first folder, 'e' the extension, 'de'
    both, 'a' neither.
    """
    folder = F.regexp_extract(pattern, r"^([^/*?\[]+)/", 1)
    ext = F.regexp_extract(pattern, r"\.([^./*?\[\]]+)$", 1)
    return (F.when(~pattern.rlike(_WILD), _key("p", pattern)).when((folder != "") & (ext != ""), _key("de", folder, ext))
            .when(folder != "", _key("d", folder)).when(ext != "", _key("e", ext)).otherwise(_key("a")))


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("\n", F.lit(kind), *parts)


def _path_keys(path: Column) -> Column:
    """Every key under which a pattern may look for a path."""
    folder, ext = F.regexp_extract(path, r"^([^/]+)/", 1), F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.array(_key("p", path), _key("de", folder, ext), _key("d", folder), _key("e", ext), _key("a"))


#: So many paths of a pattern, on average, meet its requests in one row.
GLOB_BLOCK = 512


def _glob_hits(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo_id, pattern, path): the files of each of the distinct globs ``asked``, or else a path written like it."""
    from codecorpus.functions.udfs import glob_to_regex
    q = asked.select("repo_id", "pattern", _pattern_key(F.col("pattern")).alias("_k"), glob_to_regex("pattern").alias("_rx"))
    keyed = paths.select("repo_id", "path", F.explode(_path_keys(F.col("path"))).alias("_k"))
    met = (keyed.join(q, ["repo_id", "_k"]).filter(F.col("_k").startswith("p") | F.rlike("path", F.col("_rx")))
           .select("repo_id", "pattern", "path"))
    # a pattern without wild cards has met its path, if there is one
    wild = asked.filter(F.col("pattern").rlike(_WILD)).select("repo_id", "pattern", F.col("pattern").alias("path"))
    literal = paths.join(wild, ["repo_id", "path"]).select("repo_id", "pattern", "path")
    return met.unionByName(literal.join(met.select("repo_id", "pattern").distinct(), ["repo_id", "pattern"], "left_anti"))


def glob_add(requests: DataFrame, files: DataFrame) -> DataFrame:
    """expand /add globs against the session's repo; a pattern with no
    hit is tried as a literal path; patterns with neither are reported.

    Output: (conv_id, pattern, path, status) with status 'added' or
    'not_found' (path NULL). Each distinct pattern of a repo meets the paths
    once, by an equi-join on repo and its literal parts; the regex sees only
    what is left. Its hits are dealt by path to blocks, each one array, so that
    requests times hits are rows of the output alone: no task sorts, holds or
    shuffles them.
    """
    key = ["repo_id", "pattern"]
    asked = requests.select(*key).distinct()
    hits = staged(_glob_hits(asked, files.select("repo_id", "path")), "glob-hits")
    sizes = hits.groupBy(*key).agg(F.ceil(F.count("*") / GLOB_BLOCK).cast("int").alias("_blocks"))
    # the number of a path's block needs its pattern's count: one row a pattern
    block = F.pmod(F.xxhash64("path"), F.col("_blocks")).cast("int")
    blocks = hits.join(sizes, key).groupBy(*key, block.alias("_block")).agg(F.collect_list("path").alias("_paths"))
    each = (requests.select("conv_id", *key).join(sizes, key, "left")
            .select("conv_id", *key, F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)).alias("_block")))
    # by number, since its few bytes become many rows: they are not to be put together in a few tasks
    each = each.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "_block")
    return (each.join(blocks, [*key, "_block"], "left")
            .select("conv_id", "pattern", F.explode_outer("_paths").alias("path"))
            .withColumn("status", F.when(F.col("path").isNull(), "not_found").otherwise("added")))


# ---------------------------------------------------------------------------
# Symbol extraction
# ---------------------------------------------------------------------------
def _java_rule(rx: str) -> str:
    """A rule for Java's matcher. It enters a group once a repetition, on the
    stack, so a line of thousands of words would overflow it; words divided by
    white space are the same as one class of both that ends in white space."""
    return py_regex(rx.replace(r"(?:\w+\s+)+(\w+)", r"\w[\w\s]*\s(\w+)"))


def _literal(rx: str) -> str:
    """Text that every match of a rule holds: a word outside optional groups, or the last bracket."""
    always = re.sub(r"\(\?:[^()]*\)[?*]", " ", rx)
    words = re.findall(r"(?<![\\\w])[a-z]{2,}", re.sub(r"\([^()]*\|[^()]*\)", " ", always))
    return words[0] if words else re.findall(r"\\([({])", always)[-1]


SYMBOLS = "array<struct<line:int,type:string,name:string>>"


def _families() -> list[tuple[list[str], list[tuple[str, str, str]]]]:
    """(extensions, [(type, Java regex, literal)]) of every family of rules."""
    return [([e] + [a for a, b in dims.RULE_ALIASES.items() if b == e], [(typ, _java_rule(rx), _literal(rx)) for typ, rx in rules])
            for e, rules in dims.SYMBOL_RULES.items()]


def _symbol(rules: list[tuple[str, str, str]], line: Column, at: Column) -> Column:
    """(line, type, name) by the first rule that a line matches; NULL if none does.
    A regex sees only lines that hold its rule's literal."""
    out = F.lit(None).cast("struct<line:int,type:string,name:string>")
    for typ, rx, literal in reversed(rules):
        hit = F.struct((at + 1).alias("line"), F.lit(typ).alias("type"), F.regexp_extract(line, rx, 1).alias("name"))
        out = F.when(line.contains(literal) & line.rlike(rx), hit).otherwise(out)
    return out


def _symbol_arrays(files: DataFrame, public_only: bool, all_files: bool) -> tuple[DataFrame, Column]:
    """Files with their lines, and the expression of the array of their symbols."""
    families = _families()
    family = _lit_map([(e, i) for i, (exts, _) in enumerate(families) for e in exts])
    f = files.select("repo_id", "path", "content", F.element_at(family, suffix_lower(F.col("path"))).alias("_family"))
    if not all_files:
        f = f.filter(F.col("_family").isNotNull())
    f = f.select("repo_id", "path", "_family", split_lines(F.when(F.col("_family").isNotNull(), F.col("content"))).alias("_lines"))
    found = F.expr(f"CAST(array() AS {SYMBOLS})")
    for i, (_, rules) in enumerate(families):
        found = F.when(F.col("_family") == i, F.transform("_lines", functools.partial(_symbol, rules))).otherwise(found)
    keep = (lambda s: s.isNotNull() & ~s["name"].startswith("_")) if public_only else (lambda s: s.isNotNull())
    return f, F.filter(found, keep)


def file_symbols(files: DataFrame, public_only: bool = True, all_files: bool = False) -> DataFrame:
    """S1 (+F7) with one row a file of a language with rules, or for all files: (repo_id, path, symbols), in line order.

    A file's lines stay an array, looked at by its own family's rules; no
    shuffle, ``content`` is dropped on the way. A private hit (name starting
    '_') still consumes its line, then is dropped.
    """
    f, symbols = _symbol_arrays(files, public_only, all_files)
    return f.select("repo_id", "path", symbols.alias("symbols"))


def extract_symbols(files: DataFrame, public_only: bool = True) -> DataFrame:
    """S1 (+F7): one row per symbol line ``(repo_id, path, line, type, name)``."""
    # exploded as an expression: a filter inferred on a column of it would compute it twice
    f, symbols = _symbol_arrays(files, public_only, False)
    return f.select("repo_id", "path", F.explode(symbols).alias("_s")).select("repo_id", "path", "_s.*")


def exclude_chat_files(files: DataFrame, chat_files: DataFrame) -> DataFrame:
    """J-1: (conv_id, repo_id, path) of the files of each session's repos that the session
    has not attached. Its rows are sessions times files; ``chat_coverage`` counts them without."""
    sessions = chat_files.select("conv_id", "repo_id").distinct()
    attached = chat_files.select("conv_id", "repo_id", "path").distinct()
    return (sessions.join(files.select("repo_id", "path"), "repo_id").select("conv_id", "repo_id", "path")
            .join(attached, ["conv_id", "repo_id", "path"], "left_anti"))


def chat_coverage(files: DataFrame, chat_files: DataFrame) -> DataFrame:
    """J-1 by counts: (conv_id, repo_id, n_files, n_attached, n_left) of every session and
    repo: the repo's files, those of them that the session holds, and the others."""
    attached = chat_files.select("conv_id", "repo_id", "path").distinct()
    there = files.select("repo_id", "path", F.lit(1).alias("_there"))
    held = (attached.join(there, ["repo_id", "path"], "left").groupBy("conv_id", "repo_id")
            .agg(F.count("_there").alias("n_attached")))
    sizes = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"))
    n = F.coalesce("n_files", F.lit(0))
    return held.join(sizes, "repo_id", "left").select("conv_id", "repo_id", n.alias("n_files"), "n_attached",
                                                      (n - F.col("n_attached")).alias("n_left"))
