"""Arrow-batched Python helpers for the few steps SQL cannot express.

These run on small per-rule / per-pattern columns (translation of a glob
or gitignore line to a regex), never on file contents. Kept in a module
without postponed annotations so Spark can read the pandas type hints.
"""

import pandas as pd
from pyspark.sql.functions import pandas_udf

from codecorpus.functions.patterns import gitwildmatch_regex, glob_regex


@pandas_udf("struct<regex:string, negate:boolean>")
def gitignore_to_regex(s: pd.Series) -> pd.DataFrame:
    out = [gitwildmatch_regex(x) if x is not None else None for x in s]
    return pd.DataFrame({"regex": [o[0] if o else None for o in out],
                         "negate": [o[1] if o else None for o in out]})


@pandas_udf("string")
def glob_to_regex(s: pd.Series) -> pd.Series:
    return s.map(lambda p: glob_regex(p) if p is not None else None)


_STEPS = "array<struct<agent:string, has_agent:boolean, task:string, has_task:boolean>>"


@pandas_udf(_STEPS)
def json_steps(s: pd.Series) -> pd.Series:
    """Objects of a strict JSON array; anything else has none (Spark's JSON parser is lenient)."""
    import json

    def parsed(text):
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            value = None
        return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []

    def fields(x):
        return {f: v for name in ("agent", "task")
                for f, v in ((name, None if x.get(name) is None else str(x[name])), (f"has_{name}", name in x))}

    return s.map(lambda text: [fields(x) for x in parsed(text)])
