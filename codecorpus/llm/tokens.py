"""Exact token ids of whole texts by the tokenizers library, with a memo of units.

A text is cut into units at places where the tokenizer's own pre-tokenizer
always cuts, whatever stands around; each distinct unit is encoded once while
it stays in the worker's memo. The ids are those of encoding the whole text.
"""

from __future__ import annotations

import codecs
import contextlib
import gc
import os
import re
import string
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte-level models write bytes as signs: printable Latin-1 as it is, the others from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
SPACE_SIGN = chr(BYTE_SIGNS[32])
#: Before a single space between two characters that are no white space.
SPACE_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")
#: Where a text holds none of these, its words are divided by single spaces and line ends inside words only.
UNUSUAL = ["  ", " \n", "\n ", "\0", *map(chr, (9, 11, 12, 13, 28, 29, 30, 31))]
WIDE_SPACES = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Marks a unit that does not follow a space.
BARE = "\0"
#: Punctuation that ends a unit is a run of its own after a letter; apostrophes may begin contractions.
TAIL = "".join(c for c in string.punctuation if c not in "'<>|")


def byte_marked(text: str) -> str | None:
    """The units of a plain text for a byte-level tokenizer, joined by spaces; None where units may hold spaces."""
    plain = text[0] != " " and text[-1] != " " and not any(x in text for x in UNUSUAL)
    if not plain or not text.isascii() and any(x in text for x in WIDE_SPACES):
        return None
    if "\n\n" in text or text[0] == "\n" or text[-1] == "\n":
        return BARE + text
    # a line end alone between two words is a token of its own
    return BARE + text.replace("\n", f" {BARE}\n {BARE}")


def byte_units(text: str) -> list[str]:
    """Units of a byte-level tokenizer: words that follow a space, without it; others are marked BARE."""
    marked = byte_marked(text)
    if marked is not None:
        return marked.split(" ")
    if BARE in text:
        return [BARE + text]
    return [u[1:] if u[0] == " " and len(u) > 1 and not u[1].isspace() else BARE + u for u in SPACE_BEFORE_WORD.split(text)]


def byte_text(unit: str) -> str:
    """The text that a unit of ``byte_units`` stands for."""
    return unit[1:] if unit[0] == BARE else " " + unit


def word_marked(text: str) -> str:
    """The units of a tokenizer that lower-cases and drops white space, joined by spaces."""
    raw = text.encode()
    if b"<" not in raw:  # special tokens are matched before lower-casing
        raw = raw.lower()
    return raw.translate(_SPACES).decode()


def word_units(text: str) -> list[str]:
    """Units of a tokenizer that lower-cases and drops white space."""
    return word_marked(text).split(" ")


_SPACES = bytes.maketrans(bytes(range(9, 14)), b" " * 5)


_held: tuple | None = None


def shared(kind: type, *args):
    """One encoder for all tasks that a Python worker runs, so that its memo serves them all.

    A worker holds one at a time, the one that its tasks asked for last.
    """
    global _held
    key = (kind, args)
    if _held is None or _held[0] != key:
        _held = None
        _held = (key, kind(*args))
    return _held[1]


@contextlib.contextmanager
def no_cycle_search() -> Iterator[None]:
    """Pauses the collector of reference cycles: encoding makes many short-lived lists and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def byte_signs(word: str) -> str:
    """A word of letters, with or without a space before it, as a byte-level model writes its bytes."""
    if word.isascii():
        return SPACE_SIGN + word[1:] if word[0] == " " else word
    return codecs.charmap_decode(word.encode(), "strict", _SIGNS)[0]


_SIGNS = "".join(chr(BYTE_SIGNS.get(b, b)) for b in range(256))
#: Anything but letters and signs below U+0250; the dotted capital I grows when lower-cased.
_FAR = re.compile("[^\0-\u012f\u0131-\u024f]").search


#: Bytes that a generation of a worker's memo may take, and what an entry takes besides its unit and ids.
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 200
#: Longer units are not remembered.
LONG_UNIT = 64
#: Texts that are encoded at once, and characters after which no further one joins them.
CHUNK, CHUNK_CHARS = 1024, 1 << 22


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of texts that are encoded at once."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(), dtype=np.int64), 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_CHARS)) + 1
        to = min(at + CHUNK, full, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def binaries(data: bytes | np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of so many bytes each, one after the other in ``data``."""
    offsets = np.cumsum(np.r_[0, sizes], dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Memo(dict):
    """Rows of units in ``data``, an array of their ids, in two generations of at most ``limit`` bytes: when the young
    one is full it becomes the old one, from which units that occur again are taken over. Long units are left out."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size, self.data = limit, 0, binaries(b"", np.zeros(0))
        self.old, self.old_data = {}, self.data

    def known(self, units: list[str], *, young: bool) -> tuple[np.ndarray, pa.Array]:
        """Places of those of the units that the old generation (or either) holds, and their ids."""
        held = np.fromiter(map(self.old.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        at = np.flatnonzero(held >= 0)
        ids = self.old_data.take(pa.array(held[at]))
        if young:
            held[:] = np.fromiter(map(super().get, units, repeat(-1)), dtype=np.int64, count=len(units))
            held[at] = -1
            more = np.flatnonzero(held >= 0)
            at, ids = np.r_[at, more], pa.concat_arrays([ids, self.data.take(pa.array(held[more]))])
        return at, ids

    def remember(self, units: list[str], ids: pa.Array) -> None:
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        if lengths.max(initial=0) > LONG_UNIT:
            short = np.flatnonzero(lengths <= LONG_UNIT)
            units, ids, lengths = [units[i] for i in short.tolist()], ids.take(pa.array(short)), lengths[short]
        cost = np.cumsum(lengths + pc.binary_length(ids).to_numpy() + ENTRY_BYTES)
        at = 0
        while at < len(units):
            before = int(cost[at - 1]) if at else 0
            to = max(at, int(np.searchsorted(cost, self.limit - self.size + before, side="right")))
            if to == at and not self:
                to = at + 1  # larger than a generation
            if to == at:
                self.old = {}  # goes before the copy is made
                self.old, self.old_data = dict(self), self.data
                self.clear()
                self.size, self.data = 0, self.data.slice(0, 0)
                continue
            self.update(zip(units[at:to], range(len(self.data), len(self.data) + to - at), strict=True))
            self.data = pa.concat_arrays([self.data, ids.slice(at, to - at)])
            self.size += int(cost[to - 1]) - before
            at = to


class UnitEncoder:
    """Encodes batches of texts to little-endian uint32 bytes.

    ``memo`` bounds the bytes of a generation of the units remembered.
    """

    def __init__(self, path: str, units: Callable[[str], list[str]], memo: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.units = Tokenizer.from_file(path), units
        spaced = units is byte_units
        self.marked = {byte_units: byte_marked, word_units: word_marked}[units]
        self.text_of, self.bare, self.fold = (byte_text, BARE, None) if spaced else (str, "", str.lower)
        self.memo = Memo(memo)

    def _learn(self, missing: list[str]) -> pa.Array:
        """Ids of distinct units, which are remembered; a tail of punctuation after a Latin letter is encoded apart."""
        number, first, second, bare = {}, [], [], self.bare
        for u in missing:
            if not u.isalpha():
                head = u.rstrip(TAIL)
                if len(head) < len(u) and head and "<" not in u and ord(head[-1]) < 0x250 and head[-1].isalpha() and head[-1] != "\u0130":
                    first.append(number.setdefault(head, len(number)))
                    second.append(number.setdefault(bare + u[len(head):], len(number)))
                    continue
            first.append(number.setdefault(u, len(number)))
            second.append(-1)
        plain = list(number)
        at, known = self.memo.known(plain, young=True)
        fresh = np.ones(len(plain), dtype=bool)
        fresh[at] = False
        rest = [u for u, x in zip(plain, fresh.tolist(), strict=True) if x]
        learned = self._tokenized(rest)
        self.memo.remember(rest, learned)
        # rows of the parts, and an empty one for the tail of a unit without one
        row = np.full(len(plain) + 1, len(plain))
        row[at], row[np.flatnonzero(fresh)] = np.arange(len(at)), len(at) + np.arange(len(rest))
        pairs = np.stack([first, second], axis=1).ravel() if missing else np.zeros(0, dtype=np.int64)
        parts = pa.concat_arrays([known, learned, binaries(b"", np.zeros(1))]).take(pa.array(row[pairs]))
        ids = binaries(parts.buffers()[2] or b"", pc.binary_length(parts).to_numpy().reshape(-1, 2).sum(axis=1))
        split = np.flatnonzero(np.array(second, dtype=np.int64) >= 0)
        self.memo.remember([missing[i] for i in split.tolist()], ids.take(pa.array(split)))
        return ids

    def _tokenized(self, units: list[str]) -> pa.Array:
        tokenize, text_of, fold = self.tokenizer.model.tokenize, self.text_of, self.fold
        before, out, rest = SPACE_SIGN if self.bare else "", [], []
        for u in units:
            if u.isascii() and u.isalpha():
                # one word of Latin letters: the BPE model alone, without the steps around it
                out.append([t.id for t in tokenize(before + (fold(u) if fold else u))])
                continue
            text = text_of(u)
            letters = u if u.isalpha() else text[1:] if text[:1] == " " else text
            if letters.isalpha() and (letters.isascii() or not _FAR(letters)):
                out.append([t.id for t in tokenize(byte_signs(fold(text) if fold else text))])
            else:
                rest.append((len(out), text))
                out.append([])
        encoded = self.tokenizer.encode_batch([text for _, text in rest], add_special_tokens=False)
        for (i, _), e in zip(rest, encoded, strict=True):
            out[i] = e.ids
        return binaries(np.fromiter(chain.from_iterable(out), dtype="<u4"), 4 * np.fromiter(map(len, out), dtype=np.int64, count=len(out)))

    @staticmethod
    def marked(text: str) -> str | None:
        """A text whose units are what lies between its spaces; None if the units have to be cut by themselves."""
        return None

    @no_cycle_search()
    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and to < at + CHUNK and size < CHUNK_CHARS:
                size += len(texts[to] or "")
                to += 1
            out += self._encode(texts[at:to])
            at = to
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        """A unit that occurs often in the texts is looked up once; ids are gathered by its number."""
        plain, odd, cut, units, counts = [], [], [], [], []
        for i, t in enumerate(texts):
            marked = self.marked(t) if t else None
            if marked is not None:
                plain.append(i)
                cut.append(marked)
            else:
                own = self.units(t) if t else []
                odd.append(i)
                units += own
                counts.append(len(own))
        split = pc.split_pattern(pa.array(cut, type=pa.large_string()), " ")
        numbered = pa.concat_arrays([split.flatten(), pa.array(units, type=pa.large_string())]).dictionary_encode()
        distinct, codes = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        memo = self.memo
        held = list(map(memo.get, distinct))
        rows = pa.array(held, type=pa.int64())
        here, gone = np.flatnonzero(rows.is_valid()), np.flatnonzero(rows.is_null())
        ids, place = [memo.data.take(rows.drop_null())], [here]
        if len(gone):
            missing = [u for u, x in zip(distinct, held, strict=True) if x is None]
            at, old = memo.known(missing, young=False)
            memo.remember([missing[i] for i in at.tolist()], old)
            new = np.ones(len(gone), dtype=bool)
            new[at] = False
            ids += [old, self._learn([u for u, x in zip(missing, new.tolist(), strict=True) if x])]
            place += [gone[at], gone[new]]
        row = np.empty(len(distinct), dtype=np.int64)
        row[np.concatenate(place)] = np.arange(len(distinct))
        all_ids = pa.concat_arrays(ids).take(pa.array(row[codes]))
        end, data = np.frombuffer(all_ids.buffers()[1], dtype=np.int64), (all_ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        # where each text ends, in units and then in bytes
        ends = np.cumsum(np.r_[0, pc.list_value_length(split).to_numpy(), np.array(counts, dtype=np.int64)])
        ends = end[ends]
        out = [b""] * len(texts)
        for i, a, z in zip(plain + odd, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = data[a:z]
        return out
