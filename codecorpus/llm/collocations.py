"""Phrase collocation mining (operator 12) with counting quotient filters.

1. ``blocks``: texts are cut into words in Arrow batches; a task writes blocks
   of about ``BLOCK`` words of one language, as numbers of the block's own
   dictionary, pieces divided by 0.
2. ``vocabulary``: the dictionaries' counts are added; words seen at least
   ``least`` times get dense ids. The dictionaries meet these ids by a join, and
   each block is written again in them, rarer words as 0. No vocabulary is
   broadcast or collected.
3. For 2 to 5 words, each block counts its n-grams of frequent words in a
   counting quotient filter and sends every shard (the permuted number's upper
   bits) its part; a shard merges the sorted filters of all blocks. A frequent
   phrase has only frequent parts, so n-grams with a part that is surely rare
   are left out: the frequent (k-1)-grams set bits in a table of at most
   ``TABLE_BITS`` bits, the only broadcast. A bit set by chance costs a count
   and loses nothing.
4. Cuts, scores (in exact decimals), containment and ranks are joins and
   windows over the frequent phrases. A phrase inside a longer one of equal
   count is inside one that is longer by one word, also of that count.

An entry is sent once a block, however frequent the word, phrase or language;
permuted numbers spread evenly. All steps are written tables.

Edge cases: a null language is ``und``, a null text empty; languages without
candidates have no rows; a piece may be as long as its text; rows repeated
count again, ids play no part; an empty table gives an empty result; other
columns are ignored. More than 2**25 frequent words raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import stored
from codecorpus.llm.quotient_filter import Packing, QuotientFilter, mix

#: Words of a block, and n-grams of a shard before equal ones of a block are added up.
BLOCK, SHARD = 2_000_000, 2_000_000
#: Bytes of a text that are split at once.
SLICE = 1 << 20
#: Bits of the table of frequent n-grams, and bits for each of them while it is smaller.
TABLE_BITS, BITS_EACH = 1 << 27, 32
_MARK = b","
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _MARK * 10)
_BLOCKS = "block long, lang string, words array<binary>, counts array<long>, codes binary, tokens long"


class _Numbers(dict):
    """Numbers of words in order of appearance, from 1; the mark of a cut is 0."""

    def __init__(self) -> None:
        super().__init__({_MARK: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _codes(text: bytes, numbers: _Numbers) -> Iterator[np.ndarray]:
    """The numbers of a text's words, slice by slice; a cut comes after the last."""
    at = 0
    while at < len(text):
        to = text.find(b" ", at + SLICE)
        to = len(text) if to < 0 else to
        words = text[at:to].translate(_CLEAN).replace(_MARK, b" , ").split()
        yield np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words))
        at = to
    yield np.zeros(1, dtype=np.uint32)


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of words of one language: a dictionary, its counts and the words' numbers (zstd, 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        number, open_, size = TaskContext.get().partitionId() << 32, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang, (numbers, parts) in open_.items():
                codes = np.concatenate(parts)
                counts = np.bincount(codes, minlength=len(numbers))[1:]
                yield pa.RecordBatch.from_pylist(
                    [{"block": number, "lang": lang, "words": list(numbers)[1:], "counts": counts.tolist(),
                      "codes": z.compress(codes.tobytes()), "tokens": int(counts.sum())}], schema=kind)
                number += 1

        kind = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())),
                          ("counts", pa.list_(pa.int64())), ("codes", pa.binary()), ("tokens", pa.int64())])
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"], strict=True):
                numbers, parts = open_.setdefault(lang, (_Numbers(), []))
                for codes in _codes(text.as_py(), numbers):
                    parts.append(codes)
                    size += len(codes)
                if size >= BLOCK:
                    yield from flush()
                    open_, size = {}, 0
        yield from flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").cast("binary").alias("text")).where(F.length("text") > 0)
    return rows.mapInArrow(run, _BLOCKS)


def dense_ids(table: DataFrame, first: int = 1) -> DataFrame:
    """A stored table's rows with an ``id`` each, dense from ``first``: their places in its files."""
    placed = table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    # one row a file of the table
    files = []
    for r in placed.groupBy("__file").count().orderBy("__file").collect():
        files.append((r["__file"], first))
        first += r["count"]
    before = table.sparkSession.createDataFrame(files, "__file string, __first long")
    return placed.join(F.broadcast(before), "__file").select((F.col("__first") + F.col("__row")).alias("id"), *table.columns)


def vocabulary(cut: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, f) of the words seen ``least`` times, ids dense from 1."""
    each = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    return dense_ids(stored(each.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
                            .where(F.col("f") >= least), "phrase-words"))


def encoded(cut: DataFrame, words: DataFrame) -> DataFrame:
    """(ids): every block in the ids of the vocabulary (zstd, 32 bits), 0 for cuts and rarer words."""
    known = (cut.select("block", "lang", F.posexplode("words").alias("at", "word"))
             .join(words.select("lang", "word", "id"), ["lang", "word"], "left")
             .groupBy("block").agg(F.collect_list(F.struct("at", F.coalesce("id", F.lit(0)).alias("id"))).alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for codes, pairs in zip(b["codes"], b["ids"], strict=True):
                at, ids = (pairs.values.field(c).to_numpy() for c in ("at", "id"))
                own = np.zeros(len(at) + 1, dtype=np.uint32)
                own[at + 1] = ids
                out.append(z.compress(own[np.frombuffer(open_.decompress(codes.as_py()), dtype="<u4")].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["ids"])

    # a block of cuts alone has no words, and no n-grams
    return cut.select("block", "codes").join(known, "block").select("codes", "ids").mapInArrow(run, "ids binary")


def _bit(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The place of a permuted n-gram in a table of ``size`` bits."""
    return mix(left ^ mix(right, 1), 2) & np.uint64(size - 1)


def bit_table(frequent: DataFrame, packing: Packing, n: int) -> np.ndarray:
    """Bytes of a table in which the ``n`` rows of ``frequent`` (ids) have set their bits."""
    size = min(TABLE_BITS, max(1 << 13, 1 << (BITS_EACH * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"].flatten().to_numpy().astype(np.uint64).reshape(-1, packing.k)
            bit = _bit(*packing.permute(*packing.pack(list(ids.T))), size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 13), pa.array(bit & 8191)], names=["page", "bit"])

    def page(rows: pa.Table) -> pa.Table:
        bits = np.zeros(8192, dtype=np.uint8)
        bits[rows["bit"].to_numpy()] = 1
        return pa.table({"page": rows["page"][:1], "bits": pa.array([np.packbits(bits).tobytes()], type=pa.binary())})

    table = np.zeros(size // 8, dtype=np.uint8)
    # pages of 1 KB, TABLE_BITS / 8 bytes together at most
    for r in (frequent.select("ids").mapInArrow(places, "page long, bit long").distinct()
              .groupBy("page").applyInArrow(page, "page long, bits binary").toLocalIterator()):
        table[r["page"] * 1024:r["page"] * 1024 + 1024] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table


def _windows(ids: np.ndarray, k: int) -> list[np.ndarray]:
    return [ids[i:len(ids) - k + 1 + i] for i in range(k)]


def _set(table: np.ndarray, packing: Packing, ids: list[np.ndarray]) -> np.ndarray:
    bit = _bit(*packing.permute(*packing.pack(ids)), len(table) * 8)
    return (table[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1 == 1


def frequent_ngrams(texts: DataFrame, packing: Packing, tokens: int, least: int, table: np.ndarray | None) -> DataFrame:
    """(ids, f) of the n-grams of ``packing.k`` words seen ``least`` times; ``table`` holds the (k-1)-grams that were."""
    spark, k = texts.sparkSession, packing.k
    prefix = min(packing.left, max(0, (tokens // SHARD).bit_length()))
    shared = None if table is None else spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for x in b["ids"]:
                ids = np.frombuffer(open_.decompress(x.as_py()), dtype="<u4").astype(np.uint64)
                if len(ids) < k:
                    continue
                grams = _windows(ids, k)
                here = np.flatnonzero(np.logical_and.reduce([g > 0 for g in grams]))
                if shared is not None:
                    part, shorter = Packing(k - 1, packing.bits), _windows(ids, k - 1)
                    here = here[_set(shared.value, part, [g[here] for g in shorter])]
                    here = here[_set(shared.value, part, [g[here + 1] for g in shorter])]
                parts = QuotientFilter.count(packing, [g[here] for g in grams]).shards(prefix)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in parts], type=pa.int32()), pa.array([f.to_bytes() for _, f in parts], type=pa.binary())],
                    names=["shard", "filter"])

    def merge(parts: pa.Table) -> pa.Table:
        whole = QuotientFilter.merge([QuotientFilter.from_bytes(f.as_py(), packing, prefix) for f in parts["filter"]])
        whole = whole.where(whole.counts >= least)
        ids = np.stack(whole.ids(), axis=1).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, k, dtype=np.int32)), pa.array(ids.ravel()))
        return pa.table({"ids": lists, "f": pa.array(whole.counts)})

    return (texts.mapInArrow(count, "shard int, filter binary").groupBy("shard")
            .applyInArrow(merge, "ids array<long>, f long"))


def _scores(phrases: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases with their lowest-scoring cut: l, r and score."""
    k = F.size("ids")
    cuts = (phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), k - 1)))
            .select("*", F.slice("ids", F.lit(1), F.col("cut")).alias("head"),
                    F.slice("ids", F.col("cut") + 1, k - F.col("cut")).alias("tail")))
    side = lambda key, f: parts.select(F.col("ids").alias(key), F.col("f").alias(f))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    both = cuts.join(side("head", "l"), "head").join(side("tail", "r"), "tail").join(totals, "lang")
    product: Column = (exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")
    both = both.withColumns({"__top": product, "__low": (exact("l") * exact("r")).cast("decimal(38,0)")})
    best = F.min(F.struct(F.expr("__top div __low").alias("score"), "cut", "l", "r"))
    return (both.groupBy("ids").agg(best.alias("best"), F.first("lang").alias("lang"), F.first("n").alias("n"),
                                    F.first("a").alias("a"))
            .select("ids", "lang", "a", "best.l", "best.r", "n", "best.score"))


def mine(docs: DataFrame, *, least: int = 100, longest: int = 5, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words."""
    cut = stored(blocks(docs), "phrase-blocks")
    totals = cut.groupBy("lang").agg(F.sum("tokens").alias("n"))
    words = stored(vocabulary(cut, least), "phrase-vocabulary")
    size, tokens = words.count(), cut.agg(F.sum("tokens")).first()[0] or 0
    texts = stored(encoded(cut, words), "phrase-encoded")
    bits = max(2, size.bit_length())
    levels, table = [], None
    for k in range(2, longest + 1):
        packing = Packing(k, bits)
        levels.append(stored(frequent_ngrams(texts, packing, tokens, least, table), f"phrase-{k}"))
        n = levels[-1].count()
        if not n:
            break
        if k < longest:
            table = bit_table(levels[-1], packing, n)
    phrases = levels[0]
    for x in levels[1:]:
        phrases = phrases.unionByName(x)
    parts = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    # parts of a longer phrase with the same count
    inside = (phrases.where(F.size("ids") > 2)
              .select(F.explode(F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1)))
                      .alias("ids"), "f").distinct())
    spelled = (phrases.join(inside, ["ids", "f"], "left_anti").select("ids", "f", F.posexplode("ids").alias("at", "id"))
               .join(words.select("id", "lang", "word"), "id").groupBy("ids", "f")
               .agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", F.decode("word", "UTF-8").alias("word")))).alias("w"))
               .select("ids", "lang", F.col("f").alias("a"), F.array_join("w.word", " ").alias("phrase")))
    spelled = stored(spelled, "phrase-candidates")
    scored = _scores(spelled.select("ids", "lang", "a"), parts, totals).join(spelled.select("ids", "phrase"), "ids")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", place.cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.k, u.a, u.cut, x.f AS l, y.f AS r, t.n,
             (CAST(1000 AS HUGEINT) * u.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.cut], ' ')
      JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.cut + 1:], ' ') JOIN t ON t.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND c.a >= b.a
                                        AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d) WHERE rank <= 2000
"""
