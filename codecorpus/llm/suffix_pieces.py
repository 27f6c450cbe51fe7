"""SentencePiece encoding and decoding (operator 5) by suffix-array matching.

The distinct units of a batch (words with their leading space marks) are
concatenated; a suffix array of the text is searched by bisection for every
piece of the vocabulary at once, which gives each piece's range of
occurrences; the occurrences, sorted by position, are the edges of a lattice.

The last step is not a shortest path: this vocabulary is a BPE model, for
which the library joins the best-scored adjacent pair first, and the path of
the best sum of scores has other ids. So the edges are relaxed in merge order:
in each round every unit joins its best pair that is an edge (leftmost of
equals), for all units of the batch together, until no pair is an edge.
Characters without a piece become byte pieces.

Edge cases: a null or empty text has no ids; any character is encoded (byte
pieces); very long units go through a heap instead of rounds; repeated rows
are encoded one by one; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.tokens import MEMO_BYTES, Memo, UnitEncoder, shared

MARK = "▁"
RUNS = re.compile(rf"(?<=[^{MARK}])(?={MARK})")
#: Units of more characters than this are joined with a heap.
LONG = 512
#: The text indexed at once is about so many bytes.
INDEXED = 1 << 19


class Vocabulary:
    """The pieces of a model file, read through the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in normal}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.pieces):
            raise ValueError("pieces that hold a space after a letter, or a line end, are not supported")
        self.bytes = np.zeros(256, dtype="<u4")
        for i in ids:
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
        self.text = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else
                     b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        long = sorted((p.encode(), i) for p, i in self.pieces.items() if len(p) > 1)
        self.width = max((len(p) for p, _ in long), default=1)
        self.low = np.array([p for p, _ in long], dtype=f"S{self.width}")
        self.high = np.array([p + b"\xff" * (self.width - len(p)) for p, _ in long], dtype=f"S{self.width}")
        self.length = np.array([len(p) for p, _ in long], dtype=np.int64)
        self.score = np.array([sp.get_score(i) for _, i in long])
        self.id = np.array([i for _, i in long], dtype=np.int64)


def edges(text: bytes, starts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of all pieces of two or more characters: sorted keys
    position * (width + 1) + length, and the piece (row of the vocabulary's arrays)."""
    padded = np.frombuffer(text + bytes(v.width), dtype=np.uint8)
    suffixes = np.ndarray((len(text),), dtype=f"S{v.width}", buffer=padded, strides=(1,))[starts]
    order = np.argsort(suffixes, kind="stable")
    ranked = suffixes[order]
    lo, hi = np.searchsorted(ranked, v.low, "left"), np.searchsorted(ranked, v.high, "right")
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    at = starts[order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]]
    key = at * (v.width + 1) + v.length[which]
    by_position = np.argsort(key)
    return key[by_position], which[by_position]


def _join_long(chars: list[tuple[int, int]], key: np.ndarray, piece: np.ndarray, v: Vocabulary) -> list[tuple[int, int]]:
    """The same joins for one long unit: (start, end) of its symbols."""
    start, end = [a for a, _ in chars], [b for _, b in chars]
    nxt, prev = [*range(1, len(chars)), -1], [-1, *range(len(chars) - 1)]
    alive = [True] * len(chars)
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i] if i >= 0 else -1
        if i < 0 or j < 0 or end[j] - start[i] > v.width:
            return
        k = start[i] * (v.width + 1) + end[j] - start[i]
        at = int(np.searchsorted(key, k))
        if at < len(key) and key[at] == k:
            heapq.heappush(heap, (-v.score[piece[at]], start[i], i, end[j]))

    for i in range(len(chars)):
        offer(i)
    while heap:
        _, _, i, to = heapq.heappop(heap)
        if not alive[i] or nxt[i] < 0 or end[nxt[i]] != to:
            continue
        j = nxt[i]
        end[i], alive[j], nxt[i] = to, False, nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        offer(i)
        offer(prev[i])
    return [(start[i], end[i]) for i in range(len(chars)) if alive[i]]


def segment(units: list[str], v: Vocabulary) -> list[bytes]:
    """The ids (little-endian uint32) of each unit."""
    raw = [u.encode() for u in units]
    text = b"".join(raw)
    data = np.frombuffer(text, dtype=np.uint8)
    start = np.flatnonzero((data & 0xC0) != 0x80)
    end = np.append(start[1:], len(data))
    bounds = np.cumsum([0, *map(len, raw)])
    owner = np.searchsorted(bounds, start, side="right") - 1
    key, piece = edges(text, start, v)
    size = np.bincount(owner, minlength=len(units))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for u in np.flatnonzero(size > LONG):
        here = np.flatnonzero(owner == u)
        s = _join_long(list(zip(start[here].tolist(), end[here].tolist(), strict=True)), key, piece, v)
        done.append((np.full(len(s), u), np.array([a for a, _ in s]), np.array([b for _, b in s])))
    short = size[owner] <= LONG
    owner, start, end = owner[short], start[short], end[short]
    while len(start):
        # a pair is an edge if its key is found; units without one are finished
        pair = np.flatnonzero((owner[:-1] == owner[1:]) & (end[1:] - start[:-1] <= v.width))
        k = start[pair] * (v.width + 1) + end[pair + 1] - start[pair]
        at = np.searchsorted(key, k)
        hit = at < len(key)
        hit[hit] = key[at[hit]] == k[hit]
        pair, at = pair[hit], at[hit]
        active = np.zeros(len(units), dtype=bool)
        active[owner[pair]] = True
        open_ = active[owner]
        done.append((owner[~open_], start[~open_], end[~open_]))
        if not len(pair):
            break
        # the best pair of each unit: highest score, then leftmost
        order = np.lexsort((pair, -v.score[piece[at]], owner[pair]))
        best = pair[order[np.r_[True, np.diff(owner[pair][order]) != 0]]]
        end[best] = end[best + 1]
        keep = open_.copy()
        keep[best + 1] = False
        owner, start, end = owner[keep], start[keep], end[keep]
    owner, start, end = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(start)
    owner, start, end = owner[order], start[order], end[order]
    k = start * (v.width + 1) + end - start
    at = np.minimum(np.searchsorted(key, k), max(len(key) - 1, 0))
    ids = np.full(len(k), -1, dtype=np.int64)
    if len(key):
        found = key[at] == k
        ids[found] = v.id[piece[at[found]]]
    out: list[list[int]] = [[] for _ in units]
    for o, a, b, i in zip(owner.tolist(), start.tolist(), end.tolist(), ids.tolist(), strict=True):
        if i < 0:
            i = v.pieces.get(text[a:b].decode(), -1)
        if i < 0:
            out[o] += v.bytes[data[a:b]].tolist()
        else:
            out[o].append(i)
    return [np.array(x, dtype="<u4").tobytes() for x in out]


class PieceEncoder(UnitEncoder):
    """Whole texts to ids; each distinct unit is matched once while it stays in the memo."""

    def __init__(self, path: str, memo: int = MEMO_BYTES):
        self.vocabulary, self.memo = Vocabulary(path), Memo(memo)

    @staticmethod
    def units(text: str) -> list[str]:
        """Words with their leading marks, and line ends; no piece reaches across these cuts."""
        marked = MARK + text.replace(" ", MARK)
        out: list[str] = []
        for i, line in enumerate(marked.split("\n")):
            if i:
                out.append("\n")
            if line:
                out += RUNS.split(line)
        return out

    def _learn(self, missing: list[str]) -> pa.Array:
        ids, order, todo, size = [], np.argsort(np.array(missing, dtype=object)), [], 0
        for u in [missing[i] for i in order.tolist()]:
            todo.append(u)
            size += len(u.encode())
            if size >= INDEXED:
                ids += segment(todo, self.vocabulary)
                todo, size = [], 0
        if todo:
            ids += segment(todo, self.vocabulary)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        out = pa.array(ids, type=pa.large_binary()).take(pa.array(back))
        self.memo.remember(missing, out)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the mark set before it."""
        text = b"".join([self.vocabulary.text[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return text.decode("utf-8", errors="replace").removeprefix(" ")


def encode(docs: DataFrame, model: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and round_trip (decoding gives the text back,
    its marks read as spaces) of every document; ``with_ids`` adds the ids."""
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_crc32", "long").add("round_trip", "boolean")
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(PieceEncoder, model)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = part["text"].to_pylist()
                ids = encoder.encode(texts)
                arrays = [part["doc_id"], pa.array([len(x) // 4 for x in ids], type=pa.int64()),
                          pa.array([zlib.crc32(x) for x in ids], type=pa.int64()),
                          pa.array([encoder.decode(x) == (t or "").replace(MARK, " ") for x, t in
                                    zip(ids, texts, strict=True)], type=pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, type=pa.binary())] * with_ids,
                                                 names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
