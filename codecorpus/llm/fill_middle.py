"""Fill-in-middle transformation (operator 13): cuts found by a learned rank index.

A text's tokens (a word with the white space before it, or white space at the
end) have boundary offsets that grow almost linearly with their rank. Each
text's offsets are covered by line segments that stay within ``EPS`` bytes of
them, each as long as the cone of slopes through its first point allows, and
the residual of every offset is kept in one byte. A cut is predicted by its
rank's segment and corrected exactly by the stored residual.

Whether, where and in which order a text is rearranged follows from the
SHA-256 of seed and id alone, so every row is handled where it lies: no
shuffle, and any task can be repeated. A text's bytes are looked at once; the
working memory of a task is a few times its longest text. The digests and the
restored text are column expressions.

Edge cases: a null text counts as empty; an empty text is plain with 0
tokens; a text of white space only is one token; texts holding a marker stay
plain, so every result can be undone; a null id is hashed as the empty string
after ``42:``; rows repeated get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest distance, in bytes, of an offset from its segment; residuals fit a signed byte.
EPS = 100
#: Points tried at first when a segment grows.
STEP = 512
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class RankIndex:
    """Offsets by rank: segments (first rank, its prediction, slope) and one residual a rank."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def build(cls, offsets: np.ndarray, eps: int = EPS) -> RankIndex:
        """Segments within ``eps`` of the ascending ``offsets``."""
        first, slope = [], []
        at, n, step = 0, len(offsets), STEP
        while at < n:
            to = min(at + step, n)
            up = offsets[at + 1:to] - offsets[at]
            ranks = np.arange(1, to - at)
            steepest = np.minimum.accumulate((up + eps) / ranks)
            flattest = np.maximum.accumulate((up - eps) / ranks)
            out = np.flatnonzero(flattest > steepest)
            if not len(out) and to < n:
                step *= 2
                continue
            last = int(out[0]) if len(out) else len(ranks)
            first.append(at)
            slope.append((steepest[last - 1] + flattest[last - 1]) / 2 if last else 0.0)
            at, step = at + 1 + last, max(STEP, last)
        index = cls(np.array(first), offsets[first], np.array(slope), np.zeros(0, dtype=np.int8))
        # rounding adds at most one to the bound of the cone
        index.residual = (offsets - index.predict(np.arange(n))).astype(np.int8)
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[s] + np.floor(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of some ranks."""
        return self.predict(ranks) + self.residual[ranks]


def boundaries(text: np.ndarray) -> np.ndarray:
    """Byte offsets of the token boundaries of a text's bytes, 0 and its length included."""
    if not len(text):
        return np.zeros(1, dtype=np.int64)
    space = _SPACE[text]
    return np.concatenate([[0], np.flatnonzero(space[1:] & ~space[:-1]) + 1, [len(text)]])


def _chars(piece: np.ndarray) -> int:
    """Code points of a piece of UTF-8."""
    return int(np.count_nonzero((piece & 0xC0) != 0x80))


def transform(docs: DataFrame, *, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    ``rate`` percent of the texts are rearranged, ``spm_rate`` percent of
    those with the suffix first. ``restored`` undoes it.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("__fim_hash", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = (docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
                        digest.alias("__fim_hash")).select("doc_id", "text", *h))
    schema = (docs.select("doc_id").schema.add("n", "long").add("form", "string").add("prefix_chars", "long")
              .add("middle_chars", "long").add("output", "binary"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def one(t: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        data = np.frombuffer(t, dtype=np.uint8)
        at = boundaries(data)
        n = len(at) - 1
        if not t or p in t or s in t or m in t or h3 % 100 >= rate:
            return n, "plain", None, None, t
        ranks = np.sort(np.array([h1 % (n + 1), h2 % (n + 1)]))
        a, b = map(int, RankIndex.build(at).offset(ranks))
        before, between, after = t[:a], t[a:b], t[b:]
        chars = _chars(data[:a]), _chars(data[a:b])
        if h4 % 100 < spm_rate:
            return n, "spm", *chars, b"".join((s, after, p, before, m, between))
        return n, "psm", *chars, b"".join((p, before, s, after, m, between))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            hashes = zip(*(b[f"h{i}"].to_pylist() for i in range(1, 5)), strict=True)
            rows = [one(t.as_py(), *x) for t, x in zip(b["text"], hashes, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))],
                                             names=schema.names)

    done = rows.mapInArrow(run, schema)
    return done.withColumn("output", F.col("output").cast("string"))


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that a row of ``transform`` was made of."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return (F.when(F.col(form) == "plain", F.col(output))
            .when(F.col(form) == "psm", F.concat(part(1), part(3), part(2)))
            .otherwise(F.concat(part(2), part(3), part(1))))


def digest(docs: DataFrame) -> DataFrame:
    """What ``transform`` makes of every document, with SHA-256 of the output and of the text restored from it."""
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                                  F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                                  F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS x FROM documents),
u AS (SELECT doc_id, t,
             regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k,
             CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
             CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT doc_id, t, k, CAST(len(k) AS BIGINT) AS n,
             least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
                  THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT doc_id, n, form, t, array_to_string(k[1:a], '') AS p, array_to_string(k[a + 1:b], '') AS m,
             array_to_string(k[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
              ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""
