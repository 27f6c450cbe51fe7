"""N-gram Jaccard join (operator 11): rare-first prefix filtering.

Two texts link when their sets of word shingles have a Jaccard similarity of
``percent`` or more. Equal sets are one node from the start.

1. ``screen``: a shingle that no other row holds can't be shared. Arrow blocks
   of texts send every distinct shingle once to its bucket, cut to as many bits
   as the corpus needs (two that meet by chance only keep a text longer in the
   race); buckets answer how many shingles of each text occur elsewhere. A text
   with too few of them has no partner. Other rows' sets go no further.
2. ``prefixes``: for the remaining nodes, buckets answer each block with the
   number of texts that hold a shingle. A node's shingles are put in order,
   rarest first, and its prefix is as long as any partner must meet it. The
   prefix n-grams that others hold are written with their position and the
   numbers of later shingles in four hash ranges; each node keeps the parities
   of its shingles in 1,024 ranges.
3. Nodes that share a prefix n-gram are candidates where lengths, positions and
   suffixes (the ranges' counts bound the overlap that is left, and parities
   that differ bound the shingles that are not shared) allow a link. At first
   each node meets a few leaders of its groups, and the nearest of them are
   verified; then, in groups that hold more than one component, the nodes
   outside the group's largest component meet those of other components. A pair
   within a component adds nothing to it, so a group of near copies costs a few
   rows a member and no link between texts is lost. Each pair is verified once,
   on the whole sets.
4. Components by alternating stars.

A frequent shingle is one row a block in every exchange, copies are one node,
and joins on prefix n-grams are left to AQE's skew splitting.

Edge cases: null and empty texts and texts without words have 0 shingles and
link with nothing; a text of fewer words than a shingle is one shingle, which
equals only the same words; null ids take part, and a component has the
smallest id that is not null; repeated rows get equal answers; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from codecorpus.llm.common import stored
from codecorpus.llm.graph import components

#: Shingles of a block, and of a bucket of the exchange.
BLOCK, BUCKET = 1_500_000, 2_000_000
#: Ranges of the parities, 64 to a number; leaders of a group by hash, and leaders that a node is verified with.
LANES, LEADERS, NEAREST = 16, 3, 2
#: Words whose hashes a task remembers, and bytes of them.
MEMO_WORDS, MEMO_BYTES = 300_000, 8 << 20


class _Hashes(dict):
    """XXH64 of words; starts afresh when it has grown beyond its bounds."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            self.size += len(word)
            if len(self) >= MEMO_WORDS or self.size > MEMO_BYTES:
                self.clear()
                self.size = len(word)
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, hashes: _Hashes, k: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    s = _mix(h[:n] + np.uint64(k))
    for j in range(1, k):
        s = _mix(s ^ h[j:j + n])
    return np.unique(s)


def node_of(shingles: np.ndarray) -> bytes | None:
    """The node of a set: 128 bits of hash, None for the empty set."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers of one length as compressed byte planes; the first, ascending, by its steps."""
    first, *others = columns
    out, sizes = [], []
    for x in (np.diff(first, prepend=np.uint64(0)), *others):
        x = np.ascontiguousarray(x.astype("<u8"))
        top = int(x.max()) if len(x) else 0
        sizes.append(-(-top.bit_length() // 8))
        out.append(x.view(np.uint8).reshape(-1, 8)[:, :sizes[-1]].T.tobytes())
    return zstandard.compress(np.array([len(first), *sizes], dtype="<u8").tobytes() + b"".join(out), 1)


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    n, *sizes = map(int, raw[:8 * (columns + 1)].view("<u8"))
    at, out = 8 * (columns + 1), []
    for size in sizes:
        x = np.zeros((n, 8), dtype=np.uint8)
        x[:, :size] = raw[at:at + n * size].reshape(size, n).T
        at += n * size
        out.append(x.view("<u8").ravel().astype(np.uint64))
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


class Cut:
    """Shingles cut to their upper ``bits``, and the buckets they are dealt to by the uppermost."""

    def __init__(self, shingles: int):
        self.bits = min(64, max(32, shingles.bit_length() + 10))
        self.bucket_bits = max(0, (shingles // BUCKET).bit_length())

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        return shingles >> np.uint64(64 - self.bits)

    def deal(self, short: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(bucket, rows) of ascending cut shingles."""
        if not len(short):
            return
        bucket = short >> np.uint64(self.bits - self.bucket_bits)
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(at, np.append(at[1:], len(short)), strict=True):
            yield int(bucket[a]), slice(a, b)


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ascending values, how often each occurs and the place of one occurrence."""
    order = np.argsort(values, kind="stable")
    sorted_ = values[order]
    at = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(values) else order
    return sorted_[at], np.diff(np.append(at, len(values))), order[at]


def _enough(shared: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """A partner shares at least ``percent`` of a set's shingles."""
    return (n > 0) & (100 * shared >= percent * n)


def screen(docs: DataFrame, cut: Cut, k: int, percent: int) -> DataFrame:
    """(doc_id, tie, node, n, alive) of every row: its set's name and size, and whether it can have a partner."""
    id_type = docs.schema["doc_id"].dataType
    message = StructType().add("bucket", "integer").add("block", "long").add("ids", ArrayType(id_type)).add("payload", "binary")
    answer = StructType(message.fields[1:])
    kept = StructType([StructField("doc_id", id_type), StructField("tie", LongType()), *StructType().add("node", "binary").add(
        "n", "long").fields, StructField("alive", BooleanType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = _Hashes(), TaskContext.get().partitionId() << 32
        ids, ties, place, sets, size, schema = [], [], [], {}, 0, None

        def flush() -> pa.RecordBatch:
            nodes, own = list(sets), list(sets.values())
            lengths = np.array([len(s) for s in own])
            # every distinct shingle of the block once; those that several of its sets hold are shared already
            values, counts, one = _grouped(cut(np.concatenate(own)))
            doc = np.repeat(np.arange(len(own)), lengths)
            several = counts > 1
            inside = np.isin(cut(np.concatenate(own)), values[several])
            local = np.bincount(doc[inside], minlength=len(own))
            holder = np.where(several, 0, doc[one] + 1)
            rows = [(b, None, _pack(values[r], holder[r])) for b, r in cut.deal(values)]
            meta = zstandard.compress(b"".join([np.array([len(ids), len(nodes)], dtype="<u8").tobytes(),
                                                np.array(ties, dtype="<i8").tobytes(), np.array(place, dtype="<i8").tobytes(),
                                                lengths.astype("<i8").tobytes(), local.astype("<i8").tobytes(),
                                                b"".join(x or bytes(16) for x in nodes)]), 1)
            rows.append((number % (1 << cut.bucket_bits), ids, meta))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], type=pa.int32()), pa.array([number] * len(rows), type=pa.int64()),
                 pa.array([r[1] for r in rows], type=pa.list_(schema.field("doc_id").type)),
                 pa.array([r[2] for r in rows], type=pa.binary())], names=message.names)

        for b in batches:
            schema = b.schema
            for i, tie, text in zip(b["doc_id"].to_pylist(), b["tie"].to_pylist(), b["text"], strict=True):
                s = shingle_set(text.as_py(), hashes, k)
                node = node_of(s)
                if node not in sets:
                    sets[node] = s
                    size += len(s)
                    places = {} if len(sets) == 1 else places
                    places[node] = len(sets) - 1
                ids.append(i)
                ties.append(tie)
                place.append(places[node])
                if size >= BLOCK:
                    yield flush()
                    number += 1
                    ids, ties, place, sets, size = [], [], [], {}, 0
        if ids:
            yield flush()

    def count(rows: pa.Table) -> pa.Table:
        """For every block, how many of its texts' shingles in this bucket other blocks hold too."""
        out = {"block": [], "ids": [], "payload": []}
        parts = []
        for block, ids, payload in zip(*(rows[c].to_pylist() for c in ("block", "ids", "payload")), strict=True):
            if ids is None:
                parts.append((block, *_unpack(payload, 2)))
            else:
                for c, x in zip(out, (block, ids, payload), strict=True):
                    out[c].append(x)
        if parts:
            values, counts, _ = _grouped(np.concatenate([p[1] for p in parts]))
            shared = values[counts > 1]
            for block, own, holder in parts:
                hit = holder[np.isin(own, shared, assume_unique=True) & (holder > 0)]
                holders, n, _ = _grouped(hit)
                if len(holders):
                    for c, x in zip(out, (block, None, _pack(holders, n.astype(np.uint64))), strict=True):
                        out[c].append(x)
        return pa.table({"block": pa.array(out["block"], type=pa.int64()),
                         "ids": pa.array(out["ids"], type=rows.schema.field("ids").type),
                         "payload": pa.array(out["payload"], type=pa.binary())})

    def judge(rows: pa.Table) -> pa.Table:
        """The answers for a block, summed over the buckets."""
        own = rows["ids"].is_valid().to_pylist().index(True)
        data = zstandard.decompress(rows["payload"][own].as_py())
        m, nodes = map(int, np.frombuffer(data, dtype="<u8", count=2))
        numbers = np.frombuffer(data, dtype="<i8", count=2 * m + 2 * nodes, offset=16)
        tie, place, n, shared = np.split(numbers, [m, 2 * m, 2 * m + nodes])
        names, shared = data[-16 * nodes:], shared.copy()
        for i, payload in enumerate(rows["payload"]):
            if i != own:
                holder, count = _unpack(payload.as_py(), 2)
                shared[holder.astype(np.int64) - 1] += count.astype(np.int64)
        node = [names[16 * x:16 * x + 16] if n[x] else None for x in range(nodes)]
        alive = _enough(shared, n, percent)
        return pa.table({"doc_id": rows["ids"][own].values, "tie": pa.array(tie),
                         "node": pa.array([node[x] for x in place], type=pa.binary()), "n": pa.array(n[place]),
                         # copies in other rows count as partners: they are sorted out by their node
                         "alive": pa.array(alive[place])})

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("string").cast("binary").alias("text"))
    return (rows.mapInArrow(send, message).groupBy("bucket").applyInArrow(count, answer)
            .groupBy("block").applyInArrow(judge, kept))


def alive_sets(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(block, node, shingles): the sets of the nodes that can have a partner, mostly once, in blocks."""
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie"))
    reps = (rows.where("alive").groupBy("node").agg(least.alias("least"))
            .select("node", F.col("least.doc_id").alias("__join_doc"), F.col("least.tie").alias("__join_tie")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, size, seen = _Hashes(), TaskContext.get().partitionId() << 32, 0, set()
        for b in batches:
            blocks, nodes, sets = [], [], []
            for text, want in zip(b["text"], b["node"].to_pylist(), strict=True):
                s = shingle_set(text.as_py(), hashes, k)
                # rows of one id and text hash may differ in text
                if want in seen or node_of(s) != want:
                    continue
                blocks.append(number)
                nodes.append(want)
                sets.append(s.tobytes())
                seen.add(want)
                size += len(s)
                if size >= BLOCK:
                    number, size, seen = number + 1, 0, set()
            yield pa.RecordBatch.from_arrays([pa.array(blocks, type=pa.int64()), pa.array(nodes, type=pa.binary()),
                                              pa.array(sets, type=pa.binary())], names=["block", "node", "shingles"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("string").cast("binary").alias("text"))
    met = texts.join(reps, texts["doc_id"].eqNullSafe(reps["__join_doc"]) & (texts["tie"] == reps["__join_tie"]))
    return met.select("text", "node").mapInArrow(run, "block long, node binary, shingles binary")


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype="<u8") for x in column]


def prefixes(sets: DataFrame, cut: Cut, percent: int) -> DataFrame:
    """(node, n, alone, parity, shingles, prefix): sets that can have a partner, the number of their shingles that
    no other set holds, the parities of their numbers of shingles in ranges and the shared n-grams of their prefixes.

    An n-gram of a prefix is (gram, pos, rest): the cut shingle, its place in
    the rare-first order, and how many later shingles lie in each of four
    ranges, 16 bits each (null for sets too large for that).
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, own = b["block"].to_numpy(), _sets(b["shingles"])
            out = []
            for block in np.unique(blocks):
                values, counts, _ = _grouped(cut(np.concatenate([s for s, x in zip(own, blocks, strict=True) if x == block])))
                out += [(i, block, _pack(values[r], counts[r].astype(np.uint64))) for i, r in cut.deal(values)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], type=pa.int32()), pa.array([r[1] for r in out], type=pa.int64()),
                 pa.array([r[2] for r in out], type=pa.binary())], names=["bucket", "block", "payload"])

    def count(rows: pa.Table) -> pa.Table:
        parts = [_unpack(p.as_py(), 2) for p in rows["payload"]]
        order = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
        whole = np.concatenate([p[0] for p in parts])[order]
        at = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])
        total = np.add.reduceat(np.concatenate([p[1] for p in parts])[order], at)
        values, total = whole[at][total > 1], total[total > 1]
        out = []
        for own, _ in parts:
            here = np.isin(own, values, assume_unique=True)
            out.append(_pack(own[here], total[np.searchsorted(values, own[here])]))
        return pa.table({"block": rows["block"], "payload": pa.array(out, type=pa.binary())})

    def order(block: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [_unpack(p.as_py(), 2) for p in answers["payload"]]
        values, _, one = _grouped(np.concatenate([p[0] for p in parts]))
        frequency = np.concatenate([p[1] for p in parts])[one]
        out = {"node": [], "n": [], "alone": [], "parity": [], "shingles": [], "prefix": []}
        for node, raw in zip(block["node"].to_pylist(), block["shingles"], strict=True):
            s = np.frombuffer(raw.as_py(), dtype="<u8")
            n, grams = len(s), cut(s)
            at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
            known = values[at] == grams if len(values) else np.zeros(n, dtype=bool)
            grams, often = grams[known], frequency[at[known]]
            if not _enough(np.array(len(grams)), np.array(n), percent):
                continue
            by = np.lexsort((grams, often))
            grams, alone = grams[by], n - len(grams)
            last = n - -(-percent * n // 100) + 1  # length of the prefix
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            first = first[first + alone < last]
            rest = [None] * len(first)
            if n < 1 << 16:
                lane = (np.uint64(1) << (np.uint64(16) * (grams & np.uint64(3)))).astype(np.uint64)
                before = np.cumsum(lane)
                rest = (before[-1] - before[first]).view(np.int64).tolist()
            out["node"].append(node)
            out["n"].append(n)
            out["alone"].append(alone)
            odd = np.bincount((s % np.uint64(64 * LANES)).astype(np.int64), minlength=64 * LANES) & 1
            out["parity"].append(np.packbits(odd).view(np.int64))
            out["shingles"].append(raw.as_py())
            out["prefix"].append([{"gram": int(g), "pos": int(p), "rest": r} for g, p, r in
                                  zip(grams[first].view(np.int64), first + alone, rest, strict=True)])
        gram = pa.struct([("gram", pa.int64()), ("pos", pa.int64()), ("rest", pa.int64())])
        return pa.table({"node": pa.array(out["node"], type=pa.binary()), "n": pa.array(out["n"], type=pa.int64()),
                         "alone": pa.array(out["alone"], type=pa.int64()),
                         "parity": pa.array(out["parity"], type=pa.list_(pa.int64())),
                         "shingles": pa.array(out["shingles"], type=pa.binary()),
                         "prefix": pa.array(out["prefix"], type=pa.list_(gram))})

    answers = (sets.mapInArrow(send, "bucket int, block long, payload binary").groupBy("bucket")
               .applyInArrow(count, "block long, payload binary"))
    return sets.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        order, "node binary, n long, alone long, parity array<long>, shingles binary, prefix array<struct<gram:long,pos:long,rest:long>>")


def _needed(percent: int) -> Column:
    """The least overlap o of linked sets: 100 o >= percent (nx + ny - o)."""
    return F.expr(f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}")


def _apart() -> Column:
    """At least so many shingles lie in one set of x and y only: ranges that hold an odd number in one, an even in the other."""
    return sum((F.bit_count(F.get("x.parity", F.lit(i)).bitwiseXOR(F.get("y.parity", F.lit(i)))) for i in range(LANES)), F.lit(0))


def _near_enough(percent: int) -> Column:
    return _apart() <= F.col("x.n") + F.col("y.n") - 2 * _needed(percent)


def _may_link(percent: int) -> Column:
    """Length, positional and suffix filters on two prefix n-grams (columns of x and y)."""
    c, needed = F.col, _needed(percent)
    length = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    after = lambda s: c(f"{s}.n") - c(f"{s}.pos") - 1
    position = F.least(after("x"), after("y")) + 1 >= needed
    lane = lambda s, i: F.shiftrightunsigned(c(f"{s}.rest"), 16 * i).bitwiseAND(0xFFFF)
    both = sum((F.least(lane("x", i), lane("y", i)) for i in range(1, 4)), F.least(lane("x", 0), lane("y", 0)))
    return length & position & F.coalesce(both + 1 >= needed, F.lit(True))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the distinct ``pairs`` whose whole sets reach ``percent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(_sets(b["x"]), _sets(b["y"]), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["u", "v"]).filter(pa.array(keep, type=pa.bool_()))

    side = lambda node, name: sets.select(F.col("node").alias(node), F.col("shingles").alias(name))
    return (pairs.select("u", "v").distinct().join(side("u", "x"), "u").join(side("v", "y"), "v")
            .select("u", "v", "x", "y").mapInArrow(run, "u binary, v binary"))


def linked(alive: DataFrame, percent: int) -> DataFrame:
    """(u, v): every node with links and the least node of its component."""
    grams = stored(alive.select("node", "n", "alone", F.explode("prefix").alias("g")).select("node", "n", "alone", "g.*"),
                   "join-grams")
    x = F.struct("n", "node", "pos", "rest")
    # at first, each node meets leaders of its groups: the one with the fewest shingles of its own, and some by hash
    by_hash = [F.min(F.struct(F.xxhash64("node", F.lit(i)), x.alias("x")))["x"] for i in range(LEADERS)]
    leaders = (grams.groupBy("gram").agg(F.array(F.min(F.struct("alone", x.alias("x")))["x"], *by_hash).alias("y"),
                                         F.count(F.lit(1)).alias("m")).where("m > 1"))
    met = (grams.select("gram", x.alias("x")).join(leaders, "gram").select("x", F.explode(F.array_distinct("y")).alias("y"))
           .where((F.col("x.node") != F.col("y.node")) & _may_link(percent))
           .select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct())
    side = lambda name, c: alive.select(F.col("node").alias(name), F.struct("n", "parity").alias(c))
    near = met.join(side("u", "x"), "u").join(side("v", "y"), "v").where(_near_enough(percent)).select("u", "v", _apart().alias("apart"))
    place = F.row_number().over(Window.partitionBy("u").orderBy("apart", "v"))
    nearest = near.withColumn("place", place).where(F.col("place") <= NEAREST)
    star = stored(verified(nearest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), alive, percent),
                  "join-star")
    comp = components(star, "join-near").withColumnsRenamed({"u": "node", "v": "comp"})
    # then the nodes outside a group's largest component and all others of the group
    labelled = stored(grams.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "join-labelled")
    mixed = (labelled.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("gram")
             .agg(F.max(F.struct("m", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1"))
    rest = stored(labelled.join(mixed.select("gram", "main"), "gram").join(alive.select("node", "parity"), "node")
                  .select("gram", "main", F.struct("n", "node", "pos", "rest", "comp", "parity").alias("x")), "join-mixed")
    pairs = (rest.where("x.comp <> main").join(rest.select("gram", F.col("x").alias("y")), "gram")
             .where((F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("main")) | (F.col("x.node") < F.col("y.node")))
                    & _may_link(percent) & _near_enough(percent))
             .select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")))
    more = stored(verified(pairs, alive, percent), "join-links")
    if not more.head(1):
        return comp.withColumnsRenamed({"node": "u", "comp": "v"})
    return components(star.unionByName(more), "join-components")


def near_duplicates(docs: DataFrame, *, percent: int = 80, shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    cut = Cut(size // 6)
    rows = stored(screen(docs, cut, shingle, percent), "join-rows")
    sets = stored(alive_sets(docs, rows, shingle), "join-sets")
    alive = stored(prefixes(sets, cut, percent).dropDuplicates(["node"]), "join-alive")
    comp = linked(alive, percent).withColumnsRenamed({"u": "node", "v": "root"})
    # null ids count only where a component has no other
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))
    own = rows.where("node IS NOT NULL").groupBy("node").agg(least.alias("least"))
    rooted = stored(own.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")), "join-classes")
    top = rooted.groupBy("root").agg(F.min("least").alias("least"))
    ids = rooted.select("node", "root").join(top, "root").select("node", F.col("least.doc_id").alias("component_id"))
    return (rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(ids, "node", "left")
            .select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
                                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
      FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (g) GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.v), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.u = w.doc_id GROUP BY w.doc_id, n.n
"""
