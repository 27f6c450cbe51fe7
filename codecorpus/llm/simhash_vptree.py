"""SimHash near-dedup (operator 1): vantage-point trees over fingerprints.

1. A fingerprint for each document, from the XXH64 of its word shingles, in
   Arrow batches of whole texts (no shuffle).
2. Distinct fingerprints are dealt to the leaves of a vantage-point tree grown
   on a bounded sample. A node sends a fingerprint inside when its distance d
   to the vantage is at most the radius, and outside when d > radius - r. For
   two fingerprints at most r bits apart, the triangle inequality puts both
   into one child: if one has d <= radius - r the other has d <= radius, else
   both go outside. So every link is found inside some leaf, and only the
   shell of width r is stored twice.
3. In each leaf the tree is grown further in numpy, by the same rule, until
   nodes are small; these are compared exactly. Fingerprints that no vantage
   separates (a large group of near copies) meet by the bytes that two of them
   must share. A leaf emits a spanning forest of its links, never all pairs, so a
   large group costs a row a member.
4. Components of the forests by alternating stars in Spark.

Copies share one fingerprint, so a group of equal texts is a single node.

Edge cases: null and empty texts have fingerprint zero, linked like any
other; null ids take part, and a component has the smallest id that is not
null; repeated rows get equal answers; an empty table gives an empty result;
other columns are ignored, or carried by ``keep_one``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import stored
from codecorpus.llm.graph import components

#: Shingle hashes are summed in slices of so many, to bound memory for long texts.
SLICE = 1 << 16
#: Nodes of up to so many fingerprints are compared pair by pair.
SMALL = 384


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a text: bit set where over half of the shingles' hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    sums = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        to = min(at + SLICE, n)
        h = np.array([digest(joined[a:b - 1], 42) for a, b in zip(starts[at:to], ends[at + k - 1:to + k - 1],
                                                                 strict=True)], dtype="<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tie, fp): fp is the fingerprint as a signed long, tie a hash of the text."""
    schema = docs.select("doc_id").schema.add("tie", "long").add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["tie"], pa.array(fp)], names=["doc_id", "tie", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("tie"),
                       F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose_split(fps: np.ndarray, rng: np.random.Generator, bits: int) -> tuple[np.uint64, int] | None:
    """Vantage and radius with the thinnest shell among a few candidates; None if nothing separates."""
    best, best_cost = None, 0.95
    sample = fps if len(fps) <= 2048 else rng.choice(fps, 2048, replace=False)
    for v in rng.choice(sample, min(6, len(sample)), replace=False):
        n = np.cumsum(np.bincount(distance(sample, v), minlength=65)) / len(sample)
        for radius in range(64):
            inside, outside = n[radius], 1 - (n[radius - bits] if radius >= bits else 0)
            # rows kept by both children against a halving, and how uneven they are
            cost = max(inside, outside) + 0.5 * (inside + outside - 1)
            if cost < best_cost:
                best, best_cost = (v, radius), cost
    return best


@dataclass
class VPTree:
    """Node arrays of the dealing tree; a leaf has ``left`` -1 and its number in ``leaf``."""

    vantage: list[int]
    radius: list[int]
    left: list[int]
    right: list[int]
    leaf: list[int]
    bits: int

    def deal(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) for every leaf that some of the rows go to."""
        todo = [(0, np.arange(len(fps)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.left[node] < 0:
                yield self.leaf[node], rows
                continue
            d = distance(fps[rows], np.uint64(self.vantage[node]))
            todo.append((self.left[node], rows[d <= self.radius[node]]))
            todo.append((self.right[node], rows[d > self.radius[node] - self.bits]))


def grow_tree(sample: np.ndarray, leaf_rows: int, bits: int, seed: int = 1) -> VPTree:
    """A dealing tree whose leaves hold at most ``leaf_rows`` of the sample, where splits allow it."""
    rng = np.random.default_rng(seed)
    t = VPTree([], [], [], [], [], bits)
    leaves = 0

    def build(fps: np.ndarray, level: int) -> int:
        nonlocal leaves
        here = len(t.vantage)
        for a, x in zip((t.vantage, t.radius, t.left, t.right, t.leaf), (0, 0, -1, -1, -1), strict=True):
            a.append(x)
        split = choose_split(fps, rng, bits) if len(fps) > leaf_rows and level < 40 else None
        if split is None:
            t.leaf[here] = leaves
            leaves += 1
            return here
        v, radius = split
        d = distance(fps, v)
        t.vantage[here], t.radius[here] = int(v), radius
        t.left[here] = build(fps[d <= radius], level + 1)
        t.right[here] = build(fps[d > radius - bits], level + 1)
        return here

    build(np.unique(sample), 0)
    return t


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked rows the least label of their component (labels are row numbers)."""
    while len(i):
        a, b = label[i], label[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        open_ = lo < hi
        if not open_.any():
            return
        i, j = i[open_], j[open_]
        np.minimum.at(label, hi[open_], lo[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(fps: np.ndarray, bits: int, seed: int = 1) -> np.ndarray:
    """For distinct ``fps``: the row of the first member of each one's component."""
    rng = np.random.default_rng(seed)
    label = np.arange(len(fps))
    todo = [np.arange(len(fps))]
    while todo:
        rows = todo.pop()
        if len(rows) < 2:
            continue
        split = choose_split(fps[rows], rng, bits) if len(rows) > SMALL else None
        if split is not None:
            d = distance(fps[rows], split[0])
            todo += [rows[d <= split[1]], rows[d > split[1] - bits]]
            continue
        if len(rows) > SMALL:
            _dense(fps, rows, bits, label)
        else:
            _pairs(fps, rows, bits, label)
    return label


def _pairs(fps: np.ndarray, rows: np.ndarray, bits: int, label: np.ndarray) -> None:
    i, j = np.nonzero(distance(fps[rows][:, None], fps[rows][None, :]) <= bits)
    i, j = i[i < j], j[i < j]
    _merge(label, rows[i], rows[j])


def _dense(fps: np.ndarray, rows: np.ndarray, bits: int, label: np.ndarray) -> None:
    """Links of many fingerprints that no vantage separates.

    Two that differ in at most ``bits`` bits differ in at most so many of the
    eight bytes: they agree on all others, for some choice of ``bits`` bytes.
    Groups that agree are compared in pairs, large ones by flipping the free bits.
    """
    x = fps[rows]
    for free in itertools.combinations(range(8), min(bits, 8)):
        kept = np.uint64(sum(0xFF << 8 * b for b in range(8) if b not in free))
        order = np.lexsort((x, x & kept))
        key = (x & kept)[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.append(start, len(key)))
        _runs(fps, rows[order], np.repeat(np.where(size <= SMALL, size, 1), size) - np.arange(len(key)) + np.repeat(start, size),
              bits, label)
        for at, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
            _flips(fps, rows[order[at:at + n]], [8 * byte + k for byte in free for k in range(8)], bits, label)


def _runs(fps: np.ndarray, rows: np.ndarray, left: np.ndarray, bits: int, label: np.ndarray) -> None:
    """Pairs within runs of rows; ``left`` is how many of its run a row has from itself on (less: none)."""
    at, step = np.flatnonzero(left > 1), 1
    while len(at):
        near = at[distance(fps[rows[at]], fps[rows[at + step]]) <= bits]
        _merge(label, rows[near], rows[near + step])
        step += 1
        at = at[left[at] > step]


def _flips(fps: np.ndarray, rows: np.ndarray, places: list[int], bits: int, label: np.ndarray) -> None:
    """Pairs of ascending fingerprints that differ in some of these bit places only."""
    values = fps[rows]
    for n in range(1, bits + 1):
        for flip in itertools.combinations(places, n):
            other = values ^ np.uint64(sum(1 << p for p in flip))
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            hit = np.flatnonzero(values[at] == other)
            _merge(label, rows[hit], rows[at[hit]])


def links(fps: DataFrame, bits: int = 2, *, sample_size: int = 65536, leaf_rows: int = 4096,
          max_leaves: int = 4096) -> DataFrame:
    """(u, v): a spanning forest of the links between the distinct ``fp`` of ``fps``.

    The dealing tree is grown on at most ``sample_size`` fingerprints, for
    leaves of about ``leaf_rows`` rows, at most about ``max_leaves`` of them;
    beyond that leaves grow with the data, at 8 bytes a row.
    """
    spark = fps.sparkSession
    distinct = fps.select("fp").distinct()
    n = distinct.count()
    sample = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_size).collect()],
                      dtype=np.int64).view(np.uint64)
    share = len(sample) / max(n, 1)
    tree = grow_tree(sample, max(8, int(leaf_rows * share), len(sample) // max_leaves), bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, rows in tree.deal(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, dtype=np.int32)),
                                                  pa.array(x[rows].view(np.int64))], names=["leaf", "fp"])

    def search(part: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(part["fp"].to_numpy(dtype=np.int64)).view(np.uint64)
        first = forest(x, bits)
        linked = np.flatnonzero(first != np.arange(len(x)))
        return pd.DataFrame({"u": x[linked].view(np.int64), "v": x[first[linked]].view(np.int64)})

    if n == 0:
        return spark.createDataFrame([], "u long, v long")
    return distinct.mapInArrow(deal, "leaf int, fp long").groupBy("leaf").applyInPandas(search, "u long, v long")


def classes(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(fp, doc_id, tie): of every distinct fingerprint, the least document (id, then text hash) of its component."""
    comp = components(links(fps, bits), "simhash-links").withColumnsRenamed({"u": "fp", "v": "root"})
    # null ids count only where a component has no other
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie"))
    own = fps.groupBy("fp").agg(least.alias("least"))
    rooted = stored(own.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-classes")
    top = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return rooted.drop("least").join(top, "root").select("fp", "least.doc_id", "least.tie")


def near_duplicates(docs: DataFrame, bits: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    fps = stored(fingerprints(docs, shingle), "simhash-fps")
    ids = classes(fps, bits).select("fp", F.col("doc_id").alias("component_id"))
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                      "component_id")


def keep_one(docs: DataFrame, bits: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each group (its least id, then least text hash), with all its columns; of several
    rows with that id and text, the least by a hash of all columns."""
    fps = stored(fingerprints(docs, shingle), "simhash-fps")
    names = {"doc_id": "__sim_doc", "tie": "__sim_tie"}
    equal = fps.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("__sim_n")).withColumnsRenamed(names)
    least = classes(fps, bits).select("doc_id", "tie").distinct()
    keep = stored(equal.join(least, equal["__sim_doc"].eqNullSafe(least["doc_id"]) & (equal["__sim_tie"] == least["tie"]), "left_semi"),
                  "simhash-keep")
    tied = docs.withColumn("__sim_text", F.xxhash64("text"))
    kept = tied.join(keep, tied["doc_id"].eqNullSafe(keep["__sim_doc"]) & (tied["__sim_text"] == keep["__sim_tie"]))
    own = [F.col(f"`{c}`") for c in docs.columns]
    several = (kept.where("__sim_n > 1").groupBy("doc_id", "__sim_text")
               .agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("__sim_row")).select("__sim_row.*"))
    return kept.where("__sim_n = 1").select(*own).unionByName(several)
