"""Small dimension tables and fixed lists.

Everything under "FIXED VALUES" must equal the values the assistant uses
(model catalog, aliases, language map, symbol rules, ignore and extension
lists, agents). They are stated plainly, in their natural order. The tables
are tiny and constant (tens of rows), so they are built on the driver and
joined with ``broadcast`` -- their size never grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES -- model catalog, in catalog order:
# (model, context_window, max_output, cost_per_1k_input, cost_per_1k_output,
#  supports_vision, provider)
# ---------------------------------------------------------------------------
MODELS = [
    ("gpt-4o", 128000, 16384, 0.0025, 0.010, True, "openai"),
    ("gpt-4o-mini", 128000, 16384, 0.00015, 0.00060, True, "openai"),
    ("gpt-4-turbo", 128000, 4096, 0.010, 0.030, True, "openai"),
    ("gpt-4", 8192, 4096, 0.030, 0.060, False, "openai"),
    ("gpt-3.5-turbo", 16385, 4096, 0.0005, 0.0015, False, "openai"),
    ("o1", 200000, 100000, 0.015, 0.060, True, "openai"),
    ("o1-mini", 128000, 65536, 0.003, 0.012, False, "openai"),
    ("o3-mini", 200000, 100000, 0.0011, 0.0044, False, "openai"),
    ("claude-3-7-sonnet-20250219", 200000, 128000, 0.003, 0.015, True, "anthropic"),
    ("claude-3-5-sonnet-20241022", 200000, 8096, 0.003, 0.015, True, "anthropic"),
    ("claude-3-5-haiku-20241022", 200000, 8096, 0.0008, 0.004, True, "anthropic"),
    ("claude-3-opus-20240229", 200000, 4096, 0.015, 0.075, True, "anthropic"),
    ("claude-3-haiku-20240307", 200000, 4096, 0.00025, 0.00125, True, "anthropic"),
    ("sonnet", 200000, 128000, 0.003, 0.015, True, "anthropic"),
    ("deepseek/deepseek-chat", 64000, 8192, 0.00014, 0.00028, False, "deepseek"),
    ("deepseek/deepseek-coder", 128000, 8192, 0.00014, 0.00028, False, "deepseek"),
    ("deepseek/deepseek-reasoner", 64000, 32768, 0.00055, 0.00219, False, "deepseek"),
    ("gemini/gemini-1.5-pro", 2000000, 8192, 0.00125, 0.005, True, "google"),
    ("gemini/gemini-1.5-flash", 1000000, 8192, 0.000075, 0.0003, True, "google"),
    ("gemini/gemini-2.0-flash", 1000000, 8192, 0.0001, 0.0004, True, "google"),
    ("ollama/llama3.2", 128000, 8192, 0.0, 0.0, False, "ollama"),
    ("ollama/codellama", 100000, 4096, 0.0, 0.0, False, "ollama"),
    ("ollama/mistral", 32768, 4096, 0.0, 0.0, False, "ollama"),
    ("ollama/qwen2.5-coder", 128000, 8192, 0.0, 0.0, False, "ollama"),
    ("ollama/deepseek-coder-v2", 128000, 8192, 0.0, 0.0, False, "ollama"),
    ("groq/llama3-8b-8192", 8192, 8192, 0.00005, 0.00008, False, "groq"),
    ("groq/llama3-70b-8192", 8192, 8192, 0.00059, 0.00079, False, "groq"),
    ("groq/mixtral-8x7b-32768", 32768, 4096, 0.00024, 0.00024, False, "groq"),
    ("command-r-plus", 128000, 4096, 0.003, 0.015, False, "cohere"),
    ("command-r", 128000, 4096, 0.0005, 0.0015, False, "cohere"),
    ("mistral/mistral-large-latest", 128000, 8192, 0.002, 0.006, False, "mistral"),
    ("mistral/codestral-latest", 256000, 8192, 0.001, 0.003, False, "mistral"),
]

# FIXED VALUES -- defaults for a model missing from the catalog
UNKNOWN_MODEL = (128000, 4096, 0.0, 0.0, False, "unknown")

# FIXED VALUES -- short-name aliases (alias, model)
MODEL_ALIASES = [
    ("gpt4o", "gpt-4o"),
    ("gpt-4o-latest", "gpt-4o"),
    ("4o", "gpt-4o"),
    ("4o-mini", "gpt-4o-mini"),
    ("claude", "claude-3-7-sonnet-20250219"),
    ("claude-3-7", "claude-3-7-sonnet-20250219"),
    ("claude-3-5", "claude-3-5-sonnet-20241022"),
    ("haiku", "claude-3-5-haiku-20241022"),
    ("opus", "claude-3-opus-20240229"),
    ("deepseek", "deepseek/deepseek-chat"),
    ("deepseek-r1", "deepseek/deepseek-reasoner"),
    ("gemini-pro", "gemini/gemini-1.5-pro"),
    ("gemini-flash", "gemini/gemini-1.5-flash"),
    ("llama3", "ollama/llama3.2"),
    ("codellama", "ollama/codellama"),
    ("mistral", "ollama/mistral"),
    ("o3", "o3-mini"),
]

# FIXED VALUES -- file extension -> language
EXT_TO_LANG = [
    (".py", "python"), (".js", "javascript"), (".jsx", "javascript"),
    (".ts", "typescript"), (".tsx", "typescript"), (".go", "go"),
    (".rs", "rust"), (".java", "java"), (".c", "c"), (".cpp", "cpp"),
    (".cc", "cpp"), (".h", "c"), (".hpp", "cpp"), (".cs", "csharp"),
    (".rb", "ruby"), (".php", "php"), (".swift", "swift"), (".kt", "kotlin"),
    (".scala", "scala"), (".r", "r"), (".sh", "bash"), (".bash", "bash"),
    (".zsh", "bash"), (".fish", "fish"), (".ps1", "powershell"),
    (".html", "html"), (".htm", "html"), (".css", "css"), (".scss", "scss"),
    (".sass", "sass"), (".json", "json"), (".yaml", "yaml"), (".yml", "yaml"),
    (".toml", "toml"), (".xml", "xml"), (".md", "markdown"), (".rst", "rst"),
    (".sql", "sql"), (".lua", "lua"), (".vim", "vim"),
    (".dockerfile", "dockerfile"), (".tf", "hcl"), (".hcl", "hcl"),
    (".ex", "elixir"), (".exs", "elixir"), (".erl", "erlang"),
    (".hs", "haskell"), (".ml", "ocaml"), (".clj", "clojure"),
    (".dart", "dart"), (".proto", "protobuf"), (".graphql", "graphql"),
    (".gql", "graphql"),
]

# FIXED VALUES -- basenames (lower-cased) that name a language by themselves
SPECIAL_NAMES = [("dockerfile", "dockerfile"), ("makefile", "makefile")]

# FIXED VALUES -- symbol rules: extension -> ordered (type, Python-style regex).
# First matching rule wins for a line.
SYMBOL_RULES = {
    ".py": [
        ("class", r"^class\s+(\w+)"),
        ("def", r"^(?:    |\t)?def\s+(\w+)"),
        ("async def", r"^(?:    |\t)?async\s+def\s+(\w+)"),
    ],
    ".js": [
        ("class", r"^class\s+(\w+)"),
        ("function", r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
        ("const", r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\("),
        ("arrow", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\("),
    ],
    ".ts": [
        ("class", r"^(?:export\s+)?class\s+(\w+)"),
        ("interface", r"^(?:export\s+)?interface\s+(\w+)"),
        ("type", r"^(?:export\s+)?type\s+(\w+)\s*="),
        ("function", r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
        ("const", r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\("),
        ("enum", r"^(?:export\s+)?enum\s+(\w+)"),
    ],
    ".go": [
        ("func", r"^func\s+(?:\([^)]+\)\s+)?(\w+)"),
        ("type", r"^type\s+(\w+)\s+(?:struct|interface)"),
    ],
    ".rs": [
        ("fn", r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
        ("struct", r"^(?:pub\s+)?struct\s+(\w+)"),
        ("enum", r"^(?:pub\s+)?enum\s+(\w+)"),
        ("trait", r"^(?:pub\s+)?trait\s+(\w+)"),
        ("impl", r"^impl(?:<[^>]*>)?\s+(\w+)"),
    ],
    ".java": [
        ("class", r"^(?:public\s+|private\s+|protected\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("interface", r"^(?:public\s+)?interface\s+(\w+)"),
        ("method", r"^\s+(?:public|private|protected)\s+(?:static\s+)?(?:\w+\s+)+(\w+)\s*\("),
    ],
    ".cpp": [
        ("class", r"^class\s+(\w+)"),
        ("struct", r"^struct\s+(\w+)"),
        ("function", r"^(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{"),
    ],
    ".c": [
        ("function", r"^(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{"),
        ("struct", r"^(?:typedef\s+)?struct\s+(\w+)"),
    ],
    ".rb": [
        ("class", r"^class\s+(\w+)"),
        ("module", r"^module\s+(\w+)"),
        ("def", r"^\s+def\s+(\w+)"),
    ],
    ".php": [
        ("class", r"^class\s+(\w+)"),
        ("function", r"^(?:public|private|protected)?\s*function\s+(\w+)"),
    ],
    ".swift": [
        ("class", r"^(?:public\s+)?class\s+(\w+)"),
        ("struct", r"^(?:public\s+)?struct\s+(\w+)"),
        ("func", r"^\s+(?:public\s+)?func\s+(\w+)"),
        ("protocol", r"^protocol\s+(\w+)"),
    ],
    ".kt": [
        ("class", r"^(?:data\s+)?class\s+(\w+)"),
        ("fun", r"^(?:    )?fun\s+(\w+)"),
        ("object", r"^object\s+(\w+)"),
    ],
    ".cs": [
        ("class", r"^(?:public\s+|private\s+|protected\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("interface", r"^(?:public\s+)?interface\s+(\w+)"),
        ("method", r"^\s+(?:public|private|protected)\s+(?:static\s+)?(?:\w+\s+)+(\w+)\s*\("),
    ],
}
# FIXED VALUES -- extensions that share another extension's rules
RULE_ALIASES = {".tsx": ".ts", ".jsx": ".js"}

# FIXED VALUES -- ranking weight per tag type; every other type weighs 0
TYPE_WEIGHTS = [("class", 3), ("interface", 3), ("struct", 2),
                ("def", 1), ("func", 1), ("function", 1)]

# FIXED VALUES -- built-in ignore patterns (gitignore syntax)
BUILTIN_IGNORE = [
    ".git/**", "node_modules/**", "__pycache__/**", ".venv/**", "venv/**",
    "*.pyc", "*.pyo", "*.class", "*.o", "*.so", "*.dll", "*.exe",
    "dist/**", "build/**", "*.egg-info/**", ".pytest_cache/**",
    "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json",
    "yarn.lock", "Cargo.lock", "go.sum",
]

# FIXED VALUES -- extra text extensions scanned besides the symbol-rule ones
EXTRA_TEXT_EXTENSIONS = [".md", ".txt", ".rst", ".yaml", ".yml", ".toml", ".json",
                         ".html", ".css", ".scss", ".sql", ".sh", ".bash"]

# FIXED VALUES -- extensions treated as binary by the text check
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
    ".exe", ".dll", ".so", ".dylib", ".class", ".pyc", ".pyo",
    ".o", ".a", ".lib", ".wasm",
    ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".flac", ".wav",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    ".db", ".sqlite", ".sqlite3",
]

# FIXED VALUES -- image extension -> MIME type (default image/png)
IMAGE_MIME = [("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"),
              ("gif", "image/gif"), ("webp", "image/webp"), ("bmp", "image/bmp")]
DEFAULT_IMAGE_MIME = "image/png"

# FIXED VALUES -- file-watcher globs
WATCH_GLOBS = ["*.py", "*.js", "*.ts", "*.go", "*.rs",
               "*.java", "*.cpp", "*.c", "*.rb", "*.php"]

# FIXED VALUES -- agents (name, role); the planner is listed first but is
# not addressable by routing.
AGENTS = [
    ("planner", "Breaks down tasks into actionable sub-tasks"),
    ("coder", "Writes and edits code"),
    ("reviewer", "Reviews code quality and correctness"),
    ("tester", "Writes comprehensive test suites"),
    ("debugger", "Finds and fixes bugs with root-cause analysis"),
    ("doc_writer", "Writes documentation and docstrings"),
    ("security", "Security auditor — finds vulnerabilities"),
    ("refactor", "Improves code quality without changing behaviour"),
]
PLANNER = "planner"
DEFAULT_AGENT = "coder"
MAX_AGENT_STEPS = 5

# FIXED VALUES -- sizes and limits
REPO_MAP_TOKENS = 2048          # map budget in tokens; 3 chars per token
CHARS_PER_MAP_TOKEN = 3
HISTORY_MESSAGES = 20
CONTEXT_WARN_RATIO = 0.9
FIND_FILES_CAP = 1000
PAGE_CLIP_CHARS = 8000
MESSAGE_OVERHEAD_TOKENS = 4
MAX_HEADINGS = 15
LINK_SCAN = 30
MAX_LINKS = 20
LINK_TEXT_CHARS = 60

ROLES = ["system", "user", "assistant"]
EDIT_FORMATS = ["editblock", "whole", "udiff", "architect"]


# ---------------------------------------------------------------------------
# DataFrame builders (tiny, constant; always safe to broadcast)
# ---------------------------------------------------------------------------
MODELS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("context_window", T.IntegerType(), False),
    T.StructField("max_output", T.IntegerType(), False),
    T.StructField("cost_per_1k_input", T.DoubleType(), False),
    T.StructField("cost_per_1k_output", T.DoubleType(), False),
    T.StructField("supports_vision", T.BooleanType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("catalog_no", T.IntegerType(), False),
])


def models_df(spark: SparkSession) -> DataFrame:
    rows = [m + (i,) for i, m in enumerate(MODELS)]
    return spark.createDataFrame(rows, MODELS_SCHEMA)


def aliases_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_ALIASES, "alias string, alias_model string")


def languages_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXT_TO_LANG, "ext string, language string")


def agents_df(spark: SparkSession) -> DataFrame:
    rows = [(n, r, i) for i, (n, r) in enumerate(AGENTS)]
    return spark.createDataFrame(rows, "agent string, role string, agent_no int")


def rules_for(ext: str) -> list[tuple[str, str]]:
    return SYMBOL_RULES.get(RULE_ALIASES.get(ext, ext), [])


def symbol_extensions() -> list[str]:
    return list(SYMBOL_RULES) + list(RULE_ALIASES)


def text_extensions() -> list[str]:
    return symbol_extensions() + EXTRA_TEXT_EXTENSIONS
