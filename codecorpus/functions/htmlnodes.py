"""HTML pages as arrays of elements and texts, for column expressions.

The standard library's parser cuts a page into tags and texts and decodes its
entities; what is kept of them is positions. An element is closed by an end tag
of its name, or with an element around it; an unclosed one holds all that
follows it there. Void elements hold nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc

# FIXED VALUES -- elements that never have content
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem",
        "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame",
        "image", "isindex", "nextid", "spacer"}
#: Attributes that the page expressions read.
ATTRIBUTES = ("id", "class", "href", "name", "content")

ELEMENT = "struct<tag:string,opened:int,closed:int,first:int,last:int," + ",".join(f"{a}:string" for a in ATTRIBUTES) + ">"
TEXT = "struct<at:int,text:string>"
_ARROW = [("elements", pa.list_(pa.struct([("tag", pa.string()), *[(c, pa.int32()) for c in ("opened", "closed", "first", "last")],
                                           *[(a, pa.string()) for a in ATTRIBUTES]]))),
          ("texts", pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())])))]


class Positions(HTMLParser):
    """Elements with the positions they open and close at, and the texts ``first`` to ``last`` - 1 in them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements, self.texts, self.open, self.clock, self.glue = [], [], [], 0, False
        self.feed(html)
        self.close()
        self.shut(self.open)

    def tick(self) -> int:
        self.clock += 1
        self.glue = False
        return self.clock

    def shut(self, elements: list[dict]) -> None:
        at = self.tick()
        for e in elements:
            e["closed"], e["last"] = at, len(self.texts)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        e = {"tag": tag, "opened": self.tick(), "first": len(self.texts)}
        e |= {a: own[a] or "" for a in ATTRIBUTES if a in own}
        self.elements.append(e)
        self.shut([e])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.handle_startendtag(tag, attrs)
        if tag not in VOID:
            self.open.append(self.elements[-1])

    def handle_endtag(self, tag: str) -> None:
        depth = max((i for i, e in enumerate(self.open) if e["tag"] == tag), default=None)
        if depth is not None:
            self.shut(self.open[depth:])
            del self.open[depth:]

    def handle_data(self, data: str) -> None:
        if self.glue:
            self.texts[-1]["text"] += data
        else:
            self.texts.append({"at": self.tick(), "text": data})
            self.glue = True

    def handle_comment(self, data: str) -> None:
        self.tick()

    handle_decl = handle_pi = unknown_decl = handle_comment


#: Pages of so many bytes, or so many pages, are held as Python objects at once.
PARSED_BYTES, PARSED_PAGES = 1 << 20, 256


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with an ``html`` column, cut before a page that would pass the limits."""
    first, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch["html"]), 0).to_pylist()):
        if i > first and (size + n > PARSED_BYTES or i - first == PARSED_PAGES):
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    yield batch.slice(first)


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds elements and texts to batches with an ``html`` column (null: none of either).

    An element takes many times its bytes as a Python object, so a batch is parsed and
    given back in pieces: what a worker holds does not grow with the batch's pages."""
    for b in (piece for batch in batches for piece in _pieces(batch)):
        pages = [Positions(h.as_py() or "") for h in b["html"]]
        yield pa.RecordBatch.from_arrays(
            [*b.columns, *(pa.array([getattr(p, name) for p in pages], type=kind) for name, kind in _ARROW)],
            names=[*b.schema.names, *(name for name, _ in _ARROW)])
