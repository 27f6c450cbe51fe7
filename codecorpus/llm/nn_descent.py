"""Approximate nearest neighbours (operator 3): NN-descent graph, greedy search.

Vectors with the same half-precision unit vector are one node, so a vector that
fills a third of the table is searched once. The graph starts from brute force in
small cells around random pivots and is improved in rounds, until hardly any link
changes. The nodes are dealt to parts by hash; a part's nodes, their units and
their links are the arrays of one row. In a round

1. every node shows itself, with its unit, to the nodes that it links to;
2. those that meet at a node, one of the two links new, are compared, and pairs
   that beat the worst link of an end are offered to it;
3. links and offers of a node are merged and cut.

That is two exchanges and one written table a round. Queries walk the graph
together: each round joins the best unexpanded nodes of every query with these
nodes' neighbours, units beside them, and keeps the best ``ef``; a query is done when
all of them are expanded. Half-precision unit vectors steer build and walk; the reached
nodes that can hold an answer are scored again in double precision, with all
their members (of equal vectors the ``k + 1`` smallest ids, of which one is the query).

Per node the graph keeps ``k`` links, and the nearest ``MEET`` times ``k`` of the nodes
that link to it meet (a part sends no more of them, so a node that everything links to is no
hot key): the approximation of the method, measured by its recall. Every
vector is in a node. Links and entry points grow with the number of nodes, and a
fixed block of queries is compared with brute force: ``ef`` grows until the
walk finds ``RECALL`` of their neighbours, and the other queries walk with it.
Sent to all tasks: entry points (the root of the number of nodes) and the block.

Edge cases: vectors null, empty, zero, with null or non-finite components, or
of another length than most, take no part, nor do null ids; of rows with the
same id the least vector counts; ties go to the smaller id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import stored

#: Cells of the first graph hold about so many nodes.
CELL = 128
#: Cells of the first graph at most.
CELLS = 512
#: Nodes of a part, at most, and how many times a node's links meet at it.
PART, MEET = 1024, 2
#: Offers that a part holds before it keeps only the best.
OFFERS = 1 << 18
#: Queries that are compared with brute force, and the share of their neighbours to be found.
BLOCK, RECALL = 200, 0.93
#: Two cosines of half-precision unit vectors are off by under half of this, each.
SLACK = 0.0025
#: Nodes of more members are compared with their queries in blocks of so many members and queries.
CROWD, MEMBERS, ASKING = 64, 8192, 4096
#: Queries compared with the entry points, and rows of a query's node and its neighbours looked at, at once.
STARTS, JOINED = 1024, 1024


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, raw, unit): one row an id; raw as doubles scaled by a power of two, unit in half precision."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("e") > 0))
    lengths = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw, unit = [], [], []
            for i, e in zip(b["id"].to_pylist(), b["e"], strict=True):
                x = e.values.to_numpy(zero_copy_only=False).astype("<f8")
                top = np.abs(x).max()
                if not np.isfinite(top) or top == 0:
                    continue
                x = np.ldexp(x, -int(np.frexp(top)[1])) + 0.0
                ids.append(i)
                raw.append(x.tobytes())
                unit.append((x / np.linalg.norm(x)).astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(raw, type=pa.binary()),
                                              pa.array(unit, type=pa.binary())], names=["id", "raw", "unit"])

    return (rows.where(F.size("e") == dim).mapInArrow(run, "id long, raw binary, unit binary")
            .groupBy("id").agg(F.min(F.struct("raw", "unit")).alias("v")).select("id", "v.raw", "v.unit"))


def _matrix(column: pa.Array, kind: str = "<f2") -> np.ndarray:
    """Rows of equal-length binaries as a float32 (or float64) matrix."""
    data = column.to_pylist()
    x = np.frombuffer(b"".join(data), dtype=kind).reshape(len(data), -1)
    return x.astype(np.float32) if kind == "<f2" else x


def _top(df: DataFrame, by: str, n: int, *order) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


@dataclass
class Index:
    """vectors: (id, raw, unit); nodes: (node, unit), ``size`` of them; near: (node, ids, units), the
    neighbours of each node, at most k; pivots: (node, unit) of a sample."""

    vectors: DataFrame
    nodes: DataFrame
    size: int
    near: DataFrame
    pivots: list[tuple[int, bytes]]


def _first_links(nodes: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """The nearest nodes within cells around pivots; crowded cells are split at random."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.argmax(_matrix(b["unit"]) @ pivots.T, axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["node"], b["unit"], pa.array(cell.astype(np.int32))],
                                             names=["node", "unit", "cell"])

    celled = nodes.select("node", "unit").mapInArrow(near, "node long, unit binary, cell int")
    sizes = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}
    parts = F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(max(1, n // CELL)))])

    def brute(t: pa.Table) -> pa.Table:
        ids, x = t["node"].to_numpy(), _matrix(t["unit"])
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        m = min(k, len(ids) - 1)
        best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(ids), 0), dtype=int)
        return pa.table({"u": np.repeat(ids, m), "v": ids[best.ravel()],
                         "sim": np.take_along_axis(s, best, 1).ravel().astype(np.float32)})

    return (celled.withColumn("part", F.pmod(F.xxhash64("node"), F.element_at(parts, F.col("cell"))))
            .groupBy("cell", "part").applyInArrow(brute, "u long, v long, sim float"))


def links_for(n: int) -> int:
    """Links a node: 32, and 8 more whenever the nodes double beyond 32,768."""
    return 32 + 8 * max(0, math.ceil(math.log2(max(n, 1))) - 15)


#: Rows between the steps: a part's own arrays ("own"), or arrays sent to it.
_ROWS = "part int, kind string, changed long, payload binary"


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(parts)).astype(np.int32)


def _deal(kind: str, by: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows of ``kind`` that send the columns' entries to the parts of ``by``."""
    part = _part_of(by, parts)
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(part) else []
    for a, b in zip(at, np.append(at[1:], len(part)).astype(int) if len(part) else [], strict=True):
        rows = order[a:b]
        yield int(part[rows[0]]), kind, 0, pickle.dumps(tuple(c[rows] for c in (by, *columns)), protocol=5)


def _batch(rows: list[tuple]) -> dict:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return {n: pa.array(c, type=k) for n, c, k in zip(("part", "kind", "changed", "payload"), columns, kinds, strict=True)}


def _received(table: pa.Table, kind: str, columns: int) -> list[np.ndarray]:
    got = [pickle.loads(p.as_py()) for k, p in zip(table["kind"].to_pylist(), table["payload"], strict=True) if k == kind]
    return [np.concatenate([g[i] for g in got]) for i in range(columns)] if got else []


def _top_of(by: np.ndarray, score: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Rows of the ``n`` best of each value of ``by`` (ties to the smaller), grouped by it."""
    order = np.lexsort((tie, -score, by))
    start = np.flatnonzero(np.r_[True, np.diff(by[order]) != 0]) if len(by) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return order[place < n]


def _as_units(units: np.ndarray) -> np.ndarray:
    return np.frombuffer(units.tobytes(), dtype="<f2").reshape(len(units), -1).astype(np.float32)


def _graph_steps(parts: int, k: int):
    """The three steps of a round, for parts of (nodes, units, u, v, sim, fresh): the nodes in order, the links by u."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each link u -> v sent to v, with u's unit and the worst link that u keeps."""
        for b in batches:
            for part, payload in zip(b["part"].to_pylist(), b["payload"], strict=True):
                nodes, units, u, v, sim, fresh = pickle.loads(payload.as_py())
                out = [(part, "own", 0, payload.as_py())]
                at = np.searchsorted(nodes, u)
                n = np.bincount(at, minlength=len(nodes))
                worst = np.full(len(nodes), -2.0, dtype=np.float32)
                np.minimum.at(low := np.full(len(nodes), 2.0, dtype=np.float32), at, sim)
                worst[n >= k] = low[n >= k]
                keep = _top_of(v, sim, u, MEET * k)
                out += _deal("link", v[keep], parts, u[keep], sim[keep], fresh[keep], worst[at][keep], units[at][keep])
                yield pa.RecordBatch.from_pydict(_batch(out))

    def meet(table: pa.Table) -> pa.Table:
        """Pairs that meet at a node of this part, where they beat an end's worst link."""
        own = next(i for i, x in enumerate(table["kind"].to_pylist()) if x == "own")
        nodes, units, u0, v0, sim0, fresh0 = pickle.loads(table["payload"][own].as_py())
        out = [(table["part"][own].as_py(), "own", 0, table["payload"][own].as_py())]
        got = _received(table, "link", 6)
        if got:
            keep = _top_of(got[0], got[2], got[1], MEET * k)
            v, u, sim, fresh, worst, theirs = (x[keep] for x in got)
            low = np.full(len(nodes), -2.0, dtype=np.float32)
            n = np.bincount(np.searchsorted(nodes, u0), minlength=len(nodes))
            np.minimum.at(least := np.full(len(nodes), 2.0, dtype=np.float32), np.searchsorted(nodes, u0), sim0)
            low[n >= k] = least[n >= k]
            # a node learns of those that link to it
            back = sim > low[np.searchsorted(nodes, v)]
            found, size = [(v[back], u[back], sim[back])], 0
            start = np.flatnonzero(np.r_[True, np.diff(v) != 0])
            for i, j in zip(start, np.append(start[1:], len(v)), strict=True):
                if j - i < 2 or not fresh[i:j].any():
                    continue
                x = _as_units(theirs[i:j])
                near = x @ x.T
                ok = (fresh[i:j, None] | fresh[None, i:j]) & (near > worst[i:j, None])
                np.fill_diagonal(ok, False)
                p, q = np.nonzero(ok)
                found.append((u[i:j][p], u[i:j][q], near[p, q]))
                size += len(p)
                if size > OFFERS:
                    found, size = [best_offers(found)], 0
            a, b, s = best_offers(found)
            out += _deal("offer", a, parts, b, s.astype(np.float32))
        return pa.table(_batch(out))

    def best_offers(found: list[tuple]) -> tuple:
        """The best of each node (2 k from all parts together), of which the same may come from many nodes of the part."""
        a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((b, a))
        a, b, s = a[order], b[order], s[order]
        one = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, dtype=bool)
        a, b, s = a[one], b[one], s[one]
        best = _top_of(a, s, b, max(4, min(k, 2 * k // parts)))
        return a[best], b[best], s[best]

    def merge(table: pa.Table) -> pa.Table:
        """A part's arrays after the offers: the k best links of each node; a link that was there is not new."""
        own = [p.as_py() for x, p in zip(table["kind"].to_pylist(), table["payload"], strict=True) if x == "own"]
        if own:
            nodes, units, u, v, sim, _ = pickle.loads(own[0])
        else:
            nodes, units = _received(table, "node", 2)
            order = np.argsort(nodes)
            nodes, units = nodes[order], units[order]
            u, v, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        offers = _received(table, "offer", 3) or [u[:0], v[:0], sim[:0]]
        old = np.r_[np.ones(len(u), dtype=bool), np.zeros(len(offers[0]), dtype=bool)]
        u, v, sim = (np.concatenate(x) for x in zip((u, v, sim), offers, strict=True))
        order = np.lexsort((~old, v, u))
        u, v, sim, old = u[order], v[order], sim[order], old[order]
        one = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, dtype=bool)
        u, v, sim, old = u[one], v[one], sim[one], old[one]
        keep = _top_of(u, sim, v, k)
        state = (nodes, units, u[keep], v[keep], sim[keep], ~old[keep])
        return pa.table(_batch([(table["part"][0].as_py(), "own", int((~old[keep]).sum()), pickle.dumps(state, protocol=5))]))

    return show, meet, merge


def _blobs(column: pa.Array) -> np.ndarray:
    """Equal-length binaries as a matrix of bytes."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(data), -1)


def _dealt(rows: DataFrame, kind: str, parts: int) -> DataFrame:
    """Nodes (node, unit) or offers (u, v, sim) as rows sent to their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = ([b["node"].to_numpy(), _blobs(b["unit"])] if kind == "node" else
                           [b["u"].to_numpy(), b["v"].to_numpy(), b["sim"].to_numpy()])
                yield pa.RecordBatch.from_pydict(_batch(list(_deal(kind, columns[0], parts, *columns[1:]))))

    return rows.mapInArrow(run, _ROWS)


def build(vectors: DataFrame, *, k: int | None = None, rounds: int | None = None,
          pivots: int | None = None) -> Index:
    """The graph over all valid vectors; a node is named by its smallest id.

    ``k`` and ``pivots`` follow the number of nodes unless given; without
    ``rounds`` the graph is improved until hardly any link changes.
    """
    spark = vectors.sparkSession
    valid = stored(valid_vectors(vectors), "nn-valid")
    nodes = stored(valid.groupBy("unit").agg(F.min("id").alias("node")).select("node", "unit"), "nn-nodes")
    n = nodes.count()
    k, pivots = k or links_for(n), pivots or max(512, 2 * math.isqrt(n))
    some = [(r["node"], bytes(r["unit"])) for r in
            nodes.select("node", "unit").orderBy(F.xxhash64("node"), "node").limit(2 * pivots).collect()]
    if len(some) < 2:
        return Index(valid, nodes, n, spark.createDataFrame([], "node long, ids binary, units binary"), some)
    matrix = np.frombuffer(b"".join(x for _, x in some), dtype="<f2").reshape(len(some), -1).astype(np.float32)
    use, parts = int(np.clip(n // CELL, 1, min(pivots, CELLS))), -(-n // PART)
    show, meet, merge = _graph_steps(parts, k)
    first = _dealt(nodes, "node", parts)
    for some_pivots in (matrix[:use], matrix[-use:]):
        first = first.unionByName(_dealt(_first_links(nodes, some_pivots, k), "offer", parts))
    state = stored(first.groupBy("part").applyInArrow(merge, _ROWS), "nn-graph")
    for _ in itertools.count() if rounds is None else range(rounds):
        state = stored(state.mapInArrow(show, _ROWS).groupBy("part").applyInArrow(meet, _ROWS)
                       .groupBy("part").applyInArrow(merge, _ROWS), "nn-graph")
        if state.agg(F.sum("changed")).first()[0] <= 0.002 * n * k:
            break
    return Index(valid, nodes, n, stored(_neighbours(state, parts), "nn-near"), some)


def _neighbours(state: DataFrame, parts: int) -> DataFrame:
    """(node, ids, units): each node's neighbours, with their units."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, payload in zip(b["part"].to_pylist(), b["payload"], strict=True):
                nodes, units, u, v, _, _ = pickle.loads(payload.as_py())
                out = [(part, "own", 0, pickle.dumps((nodes, units), protocol=5)), *_deal("ask", v, parts, u)]
                yield pa.RecordBatch.from_pydict(_batch(out))

    def answer(table: pa.Table) -> pa.Table:
        nodes, units = _received(table, "own", 2)
        got = _received(table, "ask", 2)
        return pa.table(_batch(list(_deal("unit", got[1], parts, got[0], units[np.searchsorted(nodes, got[0])])) if got else []))

    def put(table: pa.Table) -> pa.Table:
        u, v, units = _received(table, "unit", 3)
        order = np.argsort(u, kind="stable")
        u, v, units = u[order], v[order], units[order]
        at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        ends = np.append(at[1:], len(u))
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
        return pa.table({"node": u[at], "ids": pa.array(cut(v), type=pa.binary()), "units": pa.array(cut(units), type=pa.binary())})

    return (state.mapInArrow(ask, _ROWS).groupBy("part").applyInArrow(answer, _ROWS)
            .groupBy("part").applyInArrow(put, "node long, ids binary, units binary"))


def search(index: Index, queries: DataFrame, *, k: int = 5, ef: int | None = None, width: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every valid
    row of ``queries`` (vec_id, embedding), but not the row's own id.

    Without ``ef`` it grows until the walk of a block of queries finds
    ``RECALL`` of what brute force finds; few queries walk together with the block.
    """
    spark = queries.sparkSession
    wanted = stored(valid_vectors(queries).withColumnRenamed("id", "query_id"), "nn-queries")
    if not index.pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if ef is not None:
        return _walk(index, wanted, k, ef, width)
    ef = max(160, math.isqrt(index.size))
    if ef >= index.size:
        return _walk(index, wanted, k, ef, width)
    block = stored(wanted.orderBy(F.xxhash64("query_id"), "query_id").limit(BLOCK), "nn-block")
    truth = stored(nearest(index.vectors, block, k), "nn-truth")
    few = wanted.count() <= 8 * BLOCK
    while True:
        found = stored(_walk(index, wanted if few else block, k, ef, width), "nn-found")
        if ef >= index.size or recall(found, truth) >= RECALL:
            break
        ef *= 2
    if few:
        return found
    others = stored(wanted.join(F.broadcast(block.select("query_id")), "query_id", "left_anti"), "nn-others")
    return found.unionByName(_walk(index, others, k, ef, width))


def nearest(vectors: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest by brute force of a few (query_id, raw), which are collected."""
    rows = block.select("query_id", "raw").collect()
    asked, units = np.array([r["query_id"] for r in rows], dtype=np.int64), b"".join(bytes(r["raw"]) for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.frombuffer(units, dtype="<f8").reshape(len(asked), -1)
        y = y / np.linalg.norm(y, axis=1, keepdims=True)
        for b in batches:
            if not b.num_rows or not len(asked):
                continue
            ids, x = b["id"].to_numpy(), _matrix(b["raw"], "<f8")
            s = y @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            s[asked[:, None] == ids[None, :]] = -np.inf
            m = min(k, len(ids))
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            score = np.take_along_axis(s, best, 1).ravel()
            ok = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, m)[ok]), pa.array(ids[best.ravel()][ok]),
                                              pa.array(score[ok])], names=["query_id", "vec_id", "score"])

    found = vectors.select("id", "raw").mapInArrow(run, "query_id long, vec_id long, score double")
    return _top(found, "query_id", k, F.desc("score"), "vec_id")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the nearest that was found; vectors as near as the last of them count."""
    worst = truth.groupBy("query_id").agg(F.min("score").alias("worst"))
    hits = found.join(worst, "query_id").where("score >= worst - 1e-12").count()
    return hits / max(1, truth.count())


#: A query's walk: its unit and the nodes reached, with their sims and whether they are expanded; ``open`` of them are not.
_WALK = "query_id long, unit binary, ids binary, sims binary, done binary, open long"


def _walk(index: Index, wanted: DataFrame, k: int, ef: int, width: int | None) -> DataFrame:
    """The answers to ``wanted`` (query_id, raw, unit)."""
    width = width or max(16, ef // 3)
    pivots, units = [p for p, _ in index.pivots], b"".join(x for _, x in index.pivots)
    kind = "query_id long, unit binary, ids binary, sims binary"
    names = ["query_id", "unit", "ids", "sims"]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest entry points; a query equal to a node starts there too."""
        p = np.frombuffer(units, dtype="<f2").reshape(len(pivots), -1).astype(np.float32)
        ids, m = np.array(pivots, dtype=np.int64), min(ef, len(pivots))
        for b in (b.slice(at, STARTS) for b in batches for at in range(0, b.num_rows, STARTS)):
            s = _matrix(b["unit"]) @ p.T
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            near, sims = ids[best], np.take_along_axis(s, best, 1).astype(np.float32)
            rows = [(i[i != o], x[i != o]) if o is not None else (i, x) for i, x, o in zip(near, sims, b["node"].to_pylist(), strict=True)]
            own = [([], []) if o is None else ([o], [2.0]) for o in b["node"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["query_id"], b["unit"],
                 pa.array([np.r_[np.array(o[0], dtype=np.int64), r[0]].tobytes() for o, r in zip(own, rows, strict=True)], type=pa.binary()),
                 pa.array([np.r_[np.array(o[1], dtype=np.float32), r[1]].astype(np.float32).tobytes() for o, r in zip(own, rows, strict=True)],
                          type=pa.binary())], names=names)

    def frontier(done: np.ndarray) -> np.ndarray:
        """The best nodes not expanded yet (nodes lie in descending order)."""
        return np.flatnonzero(~done)[:width]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qs, nodes, us, worst = [], [], [], []
            for q, u, ids, sims, done in zip(*(b[c].to_pylist() for c in ("query_id", "unit", "ids", "sims", "done")), strict=True):
                ids, sims = np.frombuffer(ids, dtype=np.int64), np.frombuffer(sims, dtype=np.float32)
                at = frontier(np.frombuffer(done, dtype=bool))
                qs += [q] * len(at)
                us += [u] * len(at)
                nodes += ids[at].tolist()
                worst += [float(sims[-1]) if len(ids) >= ef else -2.0] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(qs, type=pa.int64()), pa.array(us, type=pa.binary()),
                                              pa.array(nodes, type=pa.int64()), pa.array(worst, type=pa.float32())],
                                             names=["query_id", "unit", "node", "worst"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The neighbours of a query's node that are nearer than the worst it keeps."""
        for b in (b.slice(at, JOINED) for b in batches for at in range(0, b.num_rows, JOINED)):
            out_ids, out_sims = [], []
            for u, worst, ids, near in zip(b["unit"].to_pylist(), b["worst"].to_pylist(), b["ids"].to_pylist(),
                                           b["units"].to_pylist(), strict=True):
                ids = np.frombuffer(ids, dtype=np.int64)
                s = (np.frombuffer(near, dtype="<f2").reshape(len(ids), -1).astype(np.float32)
                     @ np.frombuffer(u, dtype="<f2").astype(np.float32))
                ok = s > worst
                out_ids.append(ids[ok].tobytes())
                out_sims.append(s[ok].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b["query_id"], pa.nulls(b.num_rows, pa.binary()), pa.array(out_ids, type=pa.binary()),
                                              pa.array(out_sims, type=pa.binary())], names=names)

    def merge(table: pa.Table) -> pa.Table:
        """Each query's nodes and what was found for it: the best ``ef``; what was just joined is expanded."""
        own, new = {}, {}
        columns = [table[c].to_pylist() for c in table.column_names]
        for row in zip(*columns, strict=True):
            r = dict(zip(table.column_names, row, strict=True))
            if r["unit"] is not None:
                own[r["query_id"]] = r
            else:
                new.setdefault(r["query_id"], []).append((r["ids"], r["sims"]))
        out = []
        for q, r in own.items():
            ids, sims = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["sims"], dtype=np.float32)
            done = np.zeros(len(ids), dtype=bool) if r["done"] is None else np.frombuffer(r["done"], dtype=bool).copy()
            if r["done"] is not None:
                done[frontier(done)] = True
            more = new.get(q, [])
            ids = np.concatenate([ids, *(np.frombuffer(i, dtype=np.int64) for i, _ in more)])
            sims = np.concatenate([sims, *(np.frombuffer(s, dtype=np.float32) for _, s in more)])
            done = np.r_[done, np.zeros(len(ids) - len(done), dtype=bool)]
            # what a query holds already comes first of the equal ones
            one = np.sort(np.unique(ids, return_index=True)[1])
            ids, sims, done = ids[one], sims[one], done[one]
            best = np.lexsort((ids, -sims))[:ef]
            out.append((q, r["unit"], ids[best].tobytes(), sims[best].tobytes(), done[best].tobytes(), int((~done[best]).sum())))
        kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64()]
        return pa.table({n: pa.array(c, type=t) for n, c, t in zip(
            ("query_id", "unit", "ids", "sims", "done", "open"), zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)})

    bins = F.pmod(F.xxhash64("query_id"), F.lit(max(8, -(-index.size // PART)))).alias("bin")
    none = F.lit(None).cast("binary").alias("done")
    begun = wanted.select("query_id", "unit").join(index.nodes, "unit", "left").select("query_id", "unit", "node").mapInArrow(start, kind)
    state = stored(begun.select("*", none).groupBy(bins).applyInArrow(merge, _WALK), "nn-walk")
    while state.where("open > 0").head(1):
        front = state.where("open > 0").mapInArrow(step, "query_id long, unit binary, node long, worst float")
        found = front.join(index.near, "node").select("query_id", "unit", "worst", "ids", "units").mapInArrow(compare, kind)
        state = stored(state.drop("open").unionByName(found.select("*", none)).groupBy(bins).applyInArrow(merge, _WALK), "nn-walk")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, dtype=np.int64) for x in b["ids"].to_pylist()]
            sims = [np.frombuffer(x, dtype=np.float32) for x in b["sims"].to_pylist()]
            lengths = [len(x) for x in ids]
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["query_id"].to_numpy(), lengths)), pa.array(cat(ids, np.int64)),
                                              pa.array(cat(sims, np.float32))], names=["query_id", "node", "sim"])

    return _exact(index, wanted, state.select("query_id", "ids", "sims").mapInArrow(reached, "query_id long, node long, sim float"), k)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def _exact(index: Index, wanted: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """The k nearest members of the nodes that the walk has reached, by double precision and id."""
    kind = "query_id long, vec_id long, score double"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            yield pa.RecordBatch.from_arrays(
                [b["query_id"], b["id"], pa.array(_cosines(_matrix(b["raw"], "<f8"), _matrix(b["asked"], "<f8")))],
                names=["query_id", "vec_id", "score"])

    def block(asking: pa.Table, members: pa.Table) -> pa.Table:
        """The best k of a block of members for each of a block of queries."""
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if asking.num_rows and members.num_rows:
            ids, x, y = members["id"].to_numpy(), _matrix(members["raw"], "<f8"), _matrix(asking["asked"], "<f8")
            near = x / np.linalg.norm(x, axis=1, keepdims=True)
            for q, v in zip(asking["query_id"].to_numpy(), y, strict=True):
                s = near @ (v / np.linalg.norm(v))
                s[ids == q] = -np.inf
                m = min(k, len(s))
                # the product's last bits depend on the row's place: what is that close is scored like pairs
                some = np.flatnonzero((s >= np.partition(s, len(s) - m)[len(s) - m] - 1e-13) & np.isfinite(s))
                exact = _cosines(x[some], np.repeat(v[None], len(some), axis=0))
                best = np.lexsort((ids[some], -exact))[:k]
                out.append((np.full(len(best), q, dtype=np.int64), ids[some][best], exact[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    # k + 1 nodes hold k members besides the query; a node further behind than rounding explains has none of the answers
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "node"))
    last = F.max(F.when(F.col("place") == k + 1, F.col("sim"))).over(Window.partitionBy("query_id"))
    near = (state.withColumn("place", place).withColumn("last", last).where(f"last IS NULL OR sim >= last - {SLACK}")
            .select("query_id", "node"))
    near = stored(near, "nn-near")
    reached = near.select("node").distinct().join(index.nodes, "node")
    members = stored(_top(index.vectors, "raw", k + 1, "id").join(reached, "unit").select("node", "id", "raw"), "nn-members")
    crowds = stored(members.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
                    .join(near.groupBy("node").agg(F.count("*").alias("q")), "node")
                    .select("node", F.ceil(F.col("n") / MEMBERS).alias("ms"), F.ceil(F.col("q") / ASKING).alias("qs")),
                    "nn-crowds")
    asked = wanted.select("query_id", F.col("raw").alias("asked"))
    scored = (near.join(crowds, "node", "left_anti").join(members, "node").join(asked, "query_id")
              .select("query_id", "id", "raw", "asked").mapInArrow(pairs, kind))
    if crowds.head(1):
        queries = (near.join(crowds, "node").join(asked, "query_id")
                   .select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ms") - 1)).alias("m"),
                           F.pmod(F.xxhash64("query_id"), F.col("qs")).alias("q"), "query_id", "asked"))
        held = (members.join(crowds, "node")
                .select("node", F.pmod(F.xxhash64("id"), F.col("ms")).alias("m"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)).alias("q"), "id", "raw"))
        scored = scored.unionByName(queries.groupBy("node", "m", "q").cogroup(held.groupBy("node", "m", "q"))
                                    .applyInArrow(block, kind))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (scored.where("vec_id <> query_id").withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
