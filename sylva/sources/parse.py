"""The parse kernel: XML text to canonical node rows, in bounded batches."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import XmlParseError
from ..schema import PARSED

BATCH_ROWS = 20_000
PIECE = 1 << 16
#: Joins URI, local name and prefix in what expat reports; it can't occur in XML 1.0.
SEPARATOR = "\x1f"
BLANK = " \t\r\n\f\v"
WHITESPACE = ("preserve", "drop_blank")

ARROW = to_arrow_schema(PARSED)
KINDS = ("document", "element", "attribute", "text", "cdata", "comment", "pi")
_KIND = {kind: i for i, kind in enumerate(KINDS)}
#: What each name gives, in the order of a name's parts.
_PARTS = ("qualified_name", "local_name", "prefix", "namespace_uri")


def expanded(local: str, uri: str) -> str:
    return f"{{{uri}}}{local}" if uri else local


class _Element:
    __slots__ = ("anc", "at", "children", "depth", "node_id", "path", "seen")

    def __init__(self, node_id: int, depth: int, path: int | None, anc: tuple[int, ...]):
        self.node_id, self.depth, self.path, self.anc = node_id, depth, path, anc
        self.at: int | None = None  # of its ancestors among those of the batch
        self.children = 0
        self.seen: dict[int, int] = {}


class NodeReader:
    """Event handlers that append rows. Names and paths are numbered, and looked up once for a batch."""

    def __init__(self, document_id: str, drop_blank: bool, encoding: str | None, columns: list[str]):
        self.document_id, self.drop_blank, self.columns = document_id, drop_blank, columns
        self.rows: list[tuple] = []  # parent, sibling, depth, kind, name, value, path, ancestors, occurrence
        self.ancestors: list[tuple[int, ...]] = []
        self.next_id = 1
        self.text: list[str] = []
        self.in_cdata = False
        self.names: dict[str, int] = {}
        self.parts: list[tuple[str, str, str, str, str]] = []
        self.steps: dict[tuple[int | None, int], int] = {}
        self.paths: list[list[str]] = []
        p = self.parser = expat.ParserCreate(encoding, SEPARATOR)
        p.namespace_prefixes = True
        p.ordered_attributes = True
        p.specified_attributes = True
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler = self.start, self.end
        p.CharacterDataHandler = self.text.append
        p.StartCdataSectionHandler, p.EndCdataSectionHandler = self.start_cdata, self.end_cdata
        p.CommentHandler, p.ProcessingInstructionHandler = self.comment, self.pi
        p.SkippedEntityHandler = self.skipped
        p.ExternalEntityRefHandler = lambda *_: 0  # nothing is ever fetched
        p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler = self.start_doctype, self.end_doctype
        self.in_doctype = False
        self.stack = [_Element(1, 0, None, ())]
        self.row(None, None, 0, "document", None, None, None, None, None)

    def row(self, parent, sibling, depth, kind, name, value, path, anc, occurrence) -> int:
        n = self.next_id
        self.next_id = n + 1
        self.rows.append((parent, sibling, depth, _KIND[kind], name, value, path, anc, occurrence))
        return n

    def name(self, given: str) -> int:
        """The number of a name with its qualified, local and expanded form, prefix and URI."""
        found = self.names.get(given)
        if found is None:
            parts = given.split(SEPARATOR)
            uri, local, prefix = (*parts, "")[:3] if len(parts) > 1 else ("", parts[0], "")
            self.parts.append((f"{prefix}:{local}" if prefix else local, local, prefix, uri, expanded(local, uri)))
            found = self.names[given] = len(self.parts) - 1
        return found

    def step(self, path: int | None, name: int) -> int:
        """The number of the path of an element with this name inside a path."""
        found = self.steps.get((path, name))
        if found is None:
            self.paths.append([*(self.paths[path] if path is not None else ()), self.parts[name][4]])
            found = self.steps[path, name] = len(self.paths) - 1
        return found

    def around(self, element: _Element) -> int | None:
        """The number, in this batch, of the element's ancestors and itself."""
        if not element.anc:
            return None
        at = element.at
        if at is None or at >= len(self.ancestors) or self.ancestors[at] is not element.anc:
            element.at = at = len(self.ancestors)
            self.ancestors.append(element.anc)
        return at

    def content(self, kind: str, name: int | None, value: str) -> None:
        owner = self.stack[-1]
        owner.children += 1
        self.row(owner.node_id, owner.children, owner.depth + 1, kind, name, value, owner.path, self.around(owner), None)

    def flush(self) -> None:
        if self.text:
            value = "".join(self.text)
            self.text.clear()
            if len(self.stack) > 1 and value and not (self.drop_blank and not value.strip(BLANK)):
                self.content("text", None, value)

    def start(self, given: str, attributes: list[str]) -> None:
        self.flush()
        name = self.name(given)
        owner = self.stack[-1]
        owner.children += 1
        element = _Element(self.next_id, owner.depth + 1, self.step(owner.path, name), (*owner.anc, self.next_id))
        occurrence = owner.seen[element.path] = owner.seen.get(element.path, 0) + 1
        at = self.around(element)
        self.row(owner.node_id, owner.children, element.depth, "element", name, None, element.path, at, occurrence)
        for i in range(0, len(attributes), 2):
            self.row(element.node_id, None, element.depth + 1, "attribute", self.name(attributes[i]), attributes[i + 1], element.path, at, None)
        self.stack.append(element)

    def end(self, _: str) -> None:
        self.flush()
        self.stack.pop()

    def start_cdata(self) -> None:
        self.flush()
        self.in_cdata = True

    def end_cdata(self) -> None:
        self.in_cdata = False
        value = "".join(self.text)
        self.text.clear()
        self.content("cdata", None, value)

    def comment(self, value: str) -> None:
        if not self.in_doctype:
            self.flush()
            self.content("comment", None, value)

    def pi(self, target: str, value: str) -> None:
        if not self.in_doctype:
            self.flush()
            self.content("pi", self.name(target), value)

    def start_doctype(self, *_) -> None:
        self.in_doctype = True

    def end_doctype(self) -> None:
        self.in_doctype = False

    def skipped(self, name: str, _: bool) -> None:
        raise XmlParseError(f"Could not parse XML source: undefined entity '{name}'", self.document_id)

    def take(self) -> pa.RecordBatch:
        parent, sibling, depth, kind, name, value, path, anc, occurrence = zip(*self.rows, strict=True)
        n = len(parent)

        def looked_up(numbers: tuple, values: list, kind: pa.DataType) -> pa.Array:
            return pa.array(values, kind).take(pa.array(numbers, pa.int32()))

        def column(c: str) -> pa.Array:
            of = ARROW.field(c).type
            if c == "document_id":
                return pa.repeat(pa.scalar(self.document_id, of), n)
            if c in ("node_id", "node_order"):
                return pa.array(range(self.next_id - n, self.next_id), of)
            if c == "node_type":
                return looked_up(kind, KINDS, of)
            if c in _PARTS:
                return looked_up(name, [x[_PARTS.index(c)] for x in self.parts], of)
            if c == "path":
                return looked_up(path, self.paths, of)
            if c == "anc_ids":
                return looked_up(anc, self.ancestors, of)
            return pa.array({"parent_id": parent, "sibling_order": sibling, "depth": depth, "value": value, "sibling_occurrence": occurrence}[c], of)

        out = pa.RecordBatch.from_arrays([column(c) for c in self.columns], schema=pa.schema([ARROW.field(c) for c in self.columns]))
        self.rows.clear()
        self.ancestors.clear()
        return out


def parse_document(document_id: str, source: str | bytes, whitespace: str = "preserve", batch_rows: int = BATCH_ROWS, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most about batch_rows node rows of one document. Text is decoded already; bytes declare their encoding.

    columns: those that are wanted; the others aren't made.
    """
    reader = NodeReader(document_id, whitespace == "drop_blank", "utf-8" if isinstance(source, str) else None, columns or ARROW.names)
    raw = source.encode() if isinstance(source, str) else bytes(source)
    try:
        for i in range(0, len(raw), PIECE):
            reader.parser.Parse(raw[i : i + PIECE], False)
            if len(reader.rows) >= batch_rows:
                yield reader.take()
        reader.parser.Parse(b"", True)
    except expat.ExpatError as error:
        raise XmlParseError(f"Could not parse XML source: {error}", document_id) from error
    if reader.rows:
        yield reader.take()


def well_formed(source: str | bytes) -> bool:
    try:
        for _ in parse_document("probe", source, columns=["node_id"]):
            pass
    except XmlParseError:
        return False
    return True
