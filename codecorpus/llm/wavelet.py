"""Token-ID output (operator 4): one wavelet matrix a shard.

Documents are range-partitioned by (doc_id, text hash) and sorted, so shards
hold consecutive documents; a task encodes its texts and writes a file for
every ``max_tokens`` ids, under a name that sorts like the ids. A file holds
the documents' ids and lengths and the bit-planes of the matrix, in pieces that
are zstd compressed each by itself, with the ones before every piece: opening a file
reads this directory, and access, count and occurrences inflate only the pieces
that they pass through. Reading all documents back decodes whole planes and
asks for the ends by rank and select too. A file is
written under a temporary name and moved, so a repeated task replaces it.

Edge cases: a null or empty text is one end id; null ids come first; repeated
rows are written one by one; an empty table gives no file and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import scratch, stored
from codecorpus.llm.tokens import UnitEncoder, byte_units, pieces, shared

MAGIC = b"WVM2"
#: Words of 64 bits in a piece of a plane.
PIECE = 4096


class Plane:
    """A bit-plane in pieces: ``load`` gives the words of one, ``before`` the ones before each of them and in all."""

    def __init__(self, words: int, before: np.ndarray, load: Callable[[int], np.ndarray]):
        self.words, self.before, self.load = words, before, load
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def of(words: np.ndarray) -> Plane:
        pieces = [words[i:i + PIECE] for i in range(0, len(words), PIECE)]
        ones = [int(np.bitwise_count(p).sum()) for p in pieces]
        return Plane(len(words), np.cumsum([0, *ones], dtype=np.int64), pieces.__getitem__)

    def _piece(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of a piece, and the ones of the plane before each."""
        if i not in self.open:
            x = self.load(i)
            self.open[i] = x, self.before[i] + np.cumsum(np.r_[0, np.bitwise_count(x[:-1])], dtype=np.int64)
        return self.open[i]

    def at(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words by number, and the ones before them; behind the last there are no bits and all ones."""
        x, ones = np.zeros(len(words), dtype=np.uint64), np.full(len(words), self.before[-1], dtype=np.int64)
        piece = words // PIECE
        for i in np.unique(piece[words < self.words]).tolist():
            here = np.flatnonzero((piece == i) & (words < self.words))
            own, before = self._piece(i)
            x[here], ones[here] = own[words[here] - i * PIECE], before[words[here] - i * PIECE]
        return x, ones

    def find(self, bit: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the k-th (from 0) ones, or zeros: the word it is in, its bits and how many of the kind come before the word."""
        places = np.minimum(np.arange(len(self.before)) * PIECE, self.words)
        start = self.before if bit else places * 64 - self.before
        piece = np.searchsorted(start, k, side="right") - 1
        word, x, seen = np.zeros(len(k), dtype=np.int64), np.zeros(len(k), dtype=np.uint64), np.zeros(len(k), dtype=np.int64)
        for i in np.unique(piece).tolist():
            here = np.flatnonzero(piece == i)
            own, ones = self._piece(i)
            kind = ones if bit else (i * PIECE + np.arange(len(own))) * 64 - ones
            w = np.searchsorted(kind, k[here], side="right") - 1
            word[here], x[here], seen[here] = i * PIECE + w, own[w], kind[w]
        return word, x, seen

    def whole(self) -> np.ndarray:
        return np.concatenate([self.load(i) for i in range(len(self.before) - 1)]) if self.words else np.zeros(0, dtype="<u8")

    def to_bytes(self, z: zstandard.ZstdCompressor) -> bytes:
        pieces = [z.compress(np.ascontiguousarray(self.load(i)).tobytes()) for i in range(len(self.before) - 1)]
        return b"".join([struct.pack("<QI", self.words, len(pieces)), self.before.astype("<i8").tobytes(),
                         np.array([len(p) for p in pieces], dtype="<u4").tobytes(), *pieces])

    @staticmethod
    def from_bytes(data: memoryview) -> Plane:
        words, n = struct.unpack_from("<QI", data)
        before = np.frombuffer(data, dtype="<i8", count=n + 1, offset=12).astype(np.int64)
        sizes = np.frombuffer(data, dtype="<u4", count=n, offset=20 + 8 * n)
        at = 20 + 12 * n + np.cumsum(np.r_[0, sizes], dtype=np.int64)

        def load(i: int) -> np.ndarray:
            return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at[i]:at[i + 1]]), dtype="<u8")

        return Plane(words, before, load)


def _parted(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the zeros and of the ones: on mixed bits several times faster to move by than the mask itself."""
    return np.flatnonzero(~bit), np.flatnonzero(bit)


class WaveletMatrix:
    """Bit-planes of symbol numbers, most significant first; a plane is stably
    parted, zeros before ones, for the next. ``symbols`` are the distinct ids."""

    def __init__(self, planes: list[Plane], n: int, symbols: np.ndarray):
        self.planes, self.n, self.bits, self.symbols = planes, n, len(planes), symbols
        self.zeros = [n - int(p.before[-1]) for p in planes]

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        symbols = np.flatnonzero(np.bincount(ids)) if n and ids.max() < 1 << 22 else np.unique(ids)
        bits = max(1, (len(symbols) - 1).bit_length()) if n else 1
        if n and symbols[-1] < 1 << 22:
            number = np.zeros(int(symbols[-1]) + 1, dtype=np.uint32)
            number[symbols] = np.arange(len(symbols))
            cur = number[ids]
        else:
            cur = np.searchsorted(symbols, ids)
        cur = cur.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for level in range(bits - 1, -1, -1):
            bit = ((cur >> cur.dtype.type(level)) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(Plane.of(np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8), dtype="<u8")))
            cur = np.concatenate([cur.take(places) for places in _parted(bit)])
        return WaveletMatrix(planes, n, symbols.astype("<u4"))

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level].whole().view(np.uint8), count=self.n, bitorder="little").astype(bool)

    def _rank1(self, level: int, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each position (0..n), and the bit there."""
        pos = np.asarray(pos, dtype=np.int64)
        low = (pos & 63).astype(np.uint64)
        x, ones = self.planes[level].at(pos >> 6)
        part = x & ((np.uint64(1) << low) - np.uint64(1))
        return ones + np.bitwise_count(part).astype(np.int64), (x >> low) & np.uint64(1) == 1

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) zero or one."""
        word, x, seen = self.planes[level].find(bit, k)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == bit
        return word * 64 + np.argmax(np.cumsum(bits, axis=1) > (k - seen)[:, None], axis=1)

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The ids at the positions."""
        pos, out = np.asarray(positions, dtype=np.int64), np.zeros(len(positions), dtype=np.int64)
        for level in range(self.bits):
            ones, one = self._rank1(level, pos)
            out = out * 2 + one
            pos = np.where(one, self.zeros[level] + ones, pos - ones)
        return self.symbols[out]

    def _number(self, symbol: int) -> int:
        """The symbol's number, or -1."""
        at = int(np.searchsorted(self.symbols, symbol))
        return at if at < len(self.symbols) and self.symbols[at] == symbol else -1

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the copies of a symbol number among positions [lo, hi) end up below the last plane."""
        if symbol < 0:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, np.array([lo, hi]))[0]
            if symbol >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + int(a), self.zeros[level] + int(b)
            else:
                lo, hi = lo - int(a), hi - int(b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``symbol`` among positions [lo, hi)."""
        a, b = self._range(self._number(symbol), lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, symbol: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Positions of ``symbol`` in [lo, hi), ascending."""
        symbol = self._number(symbol)
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        pos = np.arange(a, b, dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            if not len(pos):
                break
            one = symbol >> (self.bits - 1 - level) & 1
            pos = self._select(level, one, pos - self.zeros[level] if one else pos)
        return np.sort(pos)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            bit = self._bits(level)
            prev = np.empty_like(cur)
            zeros, ones = _parted(bit)
            prev[zeros] = cur[:self.zeros[level]]
            prev[ones] = cur[self.zeros[level]:] | (kind(1) << kind(self.bits - 1 - level))
            cur = prev
        return self.symbols[cur]

    def to_bytes(self, doc_ids: pa.Array, lengths: np.ndarray) -> bytes:
        """The file: magic, n, planes, then length-prefixed sections (documents, symbols, planes)."""
        docs = io.BytesIO()
        t = pa.table({"doc_id": doc_ids, "length": pa.array(lengths, type=pa.int64())})
        with pa.ipc.new_stream(docs, t.schema) as w:
            w.write_table(t)
        z = zstandard.ZstdCompressor(level=1)
        parts = [z.compress(docs.getvalue()), z.compress(self.symbols.tobytes()), *[p.to_bytes(z) for p in self.planes]]
        return MAGIC + struct.pack("<QI", self.n, self.bits) + b"".join(struct.pack("<Q", len(p)) + p for p in parts)

    @staticmethod
    def from_bytes(data: bytes) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
        """(doc_ids, lengths, matrix) of a file."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, bits = struct.unpack_from("<QI", data, 4)
        at, parts, z = 16, [], zstandard.ZstdDecompressor()
        for _ in range(bits + 2):
            (size,) = struct.unpack_from("<Q", data, at)
            parts.append(memoryview(data)[at + 8:at + 8 + size])
            at += 8 + size
        t = pa.ipc.open_stream(z.decompress(parts[0])).read_all().combine_chunks()
        ids = t["doc_id"].combine_chunks()
        return ids, t["length"].to_numpy(), WaveletMatrix(
            [Plane.from_bytes(p) for p in parts[2:]], n, np.frombuffer(z.decompress(parts[1]), dtype="<u4"))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 0, shards: int | None = None,
                 max_tokens: int = 4_000_000) -> DataFrame:
    """Write all documents under ``folder``; returns (file, n_docs, n_tokens) of the files.

    ``folder`` is shared and one that ``pyarrow.fs`` can open; ``shards`` tasks
    write (default: the session's shuffle partitions), each a file for about
    every ``max_tokens`` ids.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(UnitEncoder, tokenizer, byte_units)
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        ids, lengths, texts, size, part = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, texts, size, part
            name = f"{task.partitionId():08d}-{part:06d}.wvm"
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(texts), dtype="<u4"))
            data = matrix.to_bytes(pa.concat_arrays(ids), np.array(lengths, dtype=np.int64))
            temporary = f"{base}/_{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, f"{base}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lengths)], type=pa.int64()),
                                              pa.array([matrix.n], type=pa.int64())],
                                             names=["file", "n_docs", "n_tokens"])
            ids, lengths, texts, size, part = [], [], [], 0, part + 1
            return row

        for b in batches:
            for piece in pieces(b):
                encoded = [x + end for x in encoder.encode(piece["text"].to_pylist())]
                ids.append(piece["doc_id"])
                lengths += [len(x) // 4 for x in encoded]
                texts += encoded
                size += sum(len(x) // 4 for x in encoded)
                if size >= max_tokens:
                    yield flush()
        if lengths:
            yield flush()

    order = [F.col("doc_id"), F.col("__tie")]
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("__tie"))
            .repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text"))
    return stored(rows.mapInArrow(run, "file string, n_docs long, n_tokens long"), "wavelet-files")


def read_shards(spark: SparkSession, folder: str, files: DataFrame, doc_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``files`` gives the ids before each file: a running sum over one row a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                doc_ids, lengths, matrix = WaveletMatrix.from_bytes(content.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                # the matrix must name the same last ids, and hold as many of the end as were decoded
                last = matrix.access(ends - 1)
                if not (last == ids[ends - 1]).all() or matrix.count(int(last[0])) != np.count_nonzero(ids == last[0]):
                    raise ValueError(f"{path.as_py()}: ranks do not agree with the planes")
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts, ends, strict=True)]
                name = path.as_py().rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(lengths)), doc_ids, pa.array(starts, type=pa.int64()),
                     pa.array(lengths, type=pa.int64()), pa.array(crc, type=pa.int64())],
                    names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    docs = (spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
            .mapInArrow(run, f"file string, doc_id {doc_type}, at long, n_tokens long, ids_crc32 long"))
    return docs.join(first, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens",
                                           "ids_crc32")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the shards to a fresh shared folder and read every document back."""
    spark = docs.sparkSession
    folder = scratch(spark, "wavelet")
    files = write_shards(docs, folder, tokenizer)
    if not files.head(1):
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, "
                                         "n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, files, docs.schema["doc_id"].dataType.simpleString())
