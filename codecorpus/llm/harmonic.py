"""Packing (operator 7): harmonic classes of reciprocal capacities.

A document's ids are cut into pieces; a piece of length in (C/(k+1), C/k]
belongs to class k, and k pieces of a class fill one sequence of capacity C.
Documents may be cut, so lengths that would waste more than ``slack`` of their
share are cut at the next reciprocal of C, and only short ends stay inexact.
Every task packs the documents it reads, on its own: no shuffle, and memory
for one open sequence a class. What is left open at the end of a task is
strung together into full sequences, the last of them at powers of two.

Edge cases: a null or empty text is one end id; null ids are packed like any
other; repeated rows are packed one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from codecorpus.llm.tokens import UnitEncoder, pieces, shared, word_units

#: Ends of documents below this share of the capacity are not cut any more.
SHORT = 32


def cut(n: int, capacity: int, slack: float = 1 / 64) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``n`` ids, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        share = capacity // k
        if share - rest <= slack * share or rest * SHORT < capacity:
            out.append((rest, k))
            break
        out.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return out


class Packer:
    """Open sequences of one task. Rows: (doc_id, start, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, ids, total, self.next, offset
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        for length, k in cut(total, self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, start, ids[4 * start:4 * (start + length)], total))
            start += length
            if len(bin_) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """The open pieces, strung together and cut where a sequence is full or at a power of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[2]) // 4 for p in rest)
        rest.reverse()
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc_id, start, ids, total = rest.pop()
                n = min(room, len(ids) // 4)
                taken.append((doc_id, start, ids[:4 * n], total))
                if 4 * n < len(ids):
                    rest.append((doc_id, start + n, ids[4 * n:], total))
                room -= n
            yield from self._close(taken)
        self.open = {}


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and the ids themselves (little-endian uint32) with ``with_ids``.

    ``tokenizer`` is the path of a tokenizers file that drops white space.
    """
    schema = docs.select("doc_id").schema
    for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(c, LongType())
    if with_ids:
        schema = schema.add("ids", BinaryType())
    end = end_id.to_bytes(4, "little")

    def rows_to_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        doc, start, ids, total, seq, offset = zip(*rows, strict=True) if rows else [()] * 6
        longs = [start, [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], total, seq, offset]
        arrays = [pa.array(doc, type=kind), *[pa.array(x, type=pa.int64()) for x in longs]]
        if with_ids:
            arrays.append(pa.array(ids, type=pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(UnitEncoder, tokenizer, word_units)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        kind = None
        for b in batches:
            kind = b.schema.field("doc_id").type
            for part in pieces(b):
                texts = encoder.encode(part["text"].to_pylist())
                rows = [r for d, ids in zip(part["doc_id"].to_pylist(), texts, strict=True)
                        for r in packer.add(d, ids + end)]
                yield rows_to_batch(rows, kind)
        if kind is not None:
            yield rows_to_batch(list(packer.finish()), kind)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, pieces): the pieces (with ids) of each sequence in order."""
    return (pieces.groupBy("sequence_id")
            .agg(F.sum("length").alias("length"),
                 F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("pieces")))
