"""Line dedup (operator 8, native): overlapping windows of three lines.

Every run of ``window`` consecutive lines of a text (cut at LF) is hashed to
128 bits. A window seen before, in order of (doc_id, text hash, position), is
a repeat; the lines it covers go, with overlapping repeats merged, and the
first occurrence stays. DataFrame functions only; windows are narrow rows, a
hot window is pre-aggregated before its shuffle and its join is left to AQE's
skew splitting; the texts are shuffled once, to meet their covered positions.

Edge cases: a text of fewer lines than the window, empty or null, is left as
it is; a window without any word never counts; null ids order first; a row
repeated with the same id and text is one document and gets one answer twice;
an empty table gives an empty result; other columns are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import WORD

_TIE, _STARTS, _LINES, _KEPT = "__line_tie", "__line_starts", "__line_all", "__line_kept"


def repeated_windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """(doc_id, tie, starts): first lines (from 0) of each document's repeated windows, ascending."""

    def hashed(lines: Column, seed: int) -> Column:
        h = F.transform(lines, lambda x: F.xxhash64(F.lit(seed), x))
        return F.transform(F.sequence(F.lit(0), F.size(h) - window),
                           lambda i: F.xxhash64(F.lit(seed), *[F.get(h, i + k) for k in range(window)]))

    def windows(lines: Column) -> Column:
        blank = F.transform(lines, lambda x: ~x.rlike(WORD))
        parts = F.struct(hashed(lines, 1).alias("a"), hashed(lines, 2).alias("b"), blank.alias("blank"))
        with_position = F.transform(F.array(parts), lambda p: F.transform(
            p["a"], lambda a, i: F.struct(i.alias("pos"), a.alias("a"), F.get(p["b"], i).alias("b"),
                                          F.reduce(F.slice(p["blank"], i + 1, window), F.lit(True),
                                                   lambda x, y: x & y).alias("blank"))))
        return F.when(F.size(lines) >= window, with_position[0])

    at = (docs.select("doc_id", F.xxhash64("text").alias(_TIE), F.split("text", "\n").alias(_LINES))
          .select("doc_id", _TIE, F.explode(windows(F.col(_LINES))).alias("w"))
          .where(~F.col("w.blank"))
          .select("doc_id", _TIE, "w.pos", "w.a", "w.b"))
    here = F.struct("doc_id", _TIE, "pos")
    first = (at.groupBy("a", "b").agg(F.min(here).alias("first"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    return (at.join(first, ["a", "b"]).where(here > F.col("first"))
            .groupBy("doc_id", _TIE).agg(F.sort_array(F.collect_set("pos")).alias(_STARTS)))


def dedup_lines(docs: DataFrame, window: int = 3, *, counts: bool = False) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text`` (and ``n_chars``, where
    it exists, set to the new length); ``counts`` adds n_lines and n_removed."""
    found = repeated_windows(docs, window).withColumnsRenamed({"doc_id": "__line_doc", _TIE: "__line_doc_tie"})
    tied = docs.withColumn(_TIE, F.xxhash64("text"))
    joined = tied.join(found, tied["doc_id"].eqNullSafe(found["__line_doc"])
                       & (tied[_TIE] == found["__line_doc_tie"]), "left")
    # cut into lines behind the join: before it, a text would be shuffled and sorted twice over
    joined = joined.withColumn(_LINES, F.split("text", "\n"))
    covered = F.flatten(F.transform(_STARTS, lambda p: F.sequence(p, p + (window - 1))))
    kept = joined.withColumn(_KEPT, F.when(F.col(_STARTS).isNotNull(),
                                           F.array_except(F.sequence(F.lit(0), F.size(_LINES) - 1), covered)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_LINES))
    text = F.when(F.col(_KEPT).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(_KEPT, lambda i: F.get(F.col(_LINES), i)), "\n"))
    out = {c: F.col(c) for c in docs.columns} | {"text": text}
    if counts:
        out |= {"n_lines": n_lines.cast("long"),
                "n_removed": F.when(F.col(_KEPT).isNull(), 0).otherwise(n_lines - F.size(_KEPT)).cast("long")}
    cut = kept.select(*[c.alias(name) for name, c in out.items()])
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, pos, lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2] AS k
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM l WHERE len(lines) >= 3)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth
      FROM w WHERE regexp_matches(k, '[^ \x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, pos + d AS pos FROM r, (SELECT unnest([0, 1, 2]) AS d) WHERE nth > 1),
g AS (SELECT doc_id, list(pos) AS cut FROM c GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.lines) AS BIGINT) AS n_lines,
       CAST(coalesce(len(g.cut), 0) AS BIGINT) AS n_removed,
       CASE WHEN g.cut IS NULL THEN l.text ELSE array_to_string(
            list_transform(list_filter(range(1, len(l.lines) + 1), lambda i: NOT list_contains(g.cut, i)),
                           lambda i: l.lines[i]), chr(10)) END AS text
FROM l LEFT JOIN g ON g.doc_id = l.doc_id
"""
