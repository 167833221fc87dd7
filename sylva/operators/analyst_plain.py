"""The analyst table of plain documents, made by two readings of their texts: what is in them, then the rows.

No node becomes a row of its own. What a document has beyond plain elements, attributes and texts is left to the general
way over nodes, with the same result.
"""

from __future__ import annotations

from collections import namedtuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionaries import dictionary
from ..functions.kernels import map_arrow
from ..functions.naming import local_of
from ..sources.plain import NotPlain, PlainDocument

#: Rows that the kernel hands on at once.
ROWS = 20_000
#: Of values that inference takes for alike (whole numbers but 1, words) only the first and the last tell anything.
ALIKE = (r"^[2-9]$|^[1-9][0-9]{1,8}$", r"^[A-EG-SU-Za-eg-su-z]")

FACTS = "what string, path array<string>, name string, presence boolean, n long, most long, document_id string, node_order int, value string"
_FACTS = pa.schema([("what", pa.string()), ("path", pa.list_(pa.string())), ("name", pa.string()), ("presence", pa.bool_()), ("n", pa.int64()), ("most", pa.int64()), ("document_id", pa.string()), ("node_order", pa.int32()), ("value", pa.string())])

Field = namedtuple("Field", "path name presence n most place")
Place = namedtuple("Place", "late document_id node_order")
First = namedtuple("First", "place relative name kind")
Found = namedtuple("Found", "entity_path signature presence first most kinds path attribute")
Name = namedtuple("Name", "node_type namespace_uri prefix local_name")


#: Of documents at rest: what the JVM reads of them and sends is as long as this leaves it.
CODEC = "zstd"


def packed(sources: DataFrame) -> DataFrame:
    """document_id, content (compressed UTF-8 or the bytes), size, text (whether it was a string); rows of null content go."""

    def kernel(batches):
        for batch in batches:
            for document_id, content in zip(batch.column(0), batch.column(1), strict=True):
                if content.is_valid:
                    raw, text = content.as_buffer(), pa.types.is_string(content.type) or pa.types.is_large_string(content.type)
                    row = [document_id.as_py()], [pa.compress(raw, CODEC, asbytes=True)], [raw.size], [text]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], ["document_id", "content", "size", "text"])

    return map_arrow(sources.select("document_id", "content"), kernel, "document_id string, content binary, size long, text boolean")


def unpacked(sources: DataFrame, kind: str) -> DataFrame:
    """The sources again. kind: of their content."""

    def kernel(batches):
        for batch in batches:
            for document_id, content, size, _ in zip(*batch.columns, strict=True):
                raw = pa.decompress(content.as_buffer(), size.as_py(), CODEC, asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([document_id.as_py()], pa.string()), pa.array([raw], pa.binary()).cast(pa.string() if kind == "string" else pa.binary())], ["document_id", "content"])

    return map_arrow(sources.select("document_id", "content", "size", "text"), kernel, f"document_id string, content {kind}")


def _documents(batches, drop_blank: bool, check: bool):
    """document_id and the plain document, or None, of each row of packed sources."""
    for batch in batches:
        for document_id, content, size, text in zip(*batch.columns, strict=True):
            pa.default_memory_pool().release_unused()
            try:
                yield document_id.as_py(), PlainDocument(pa.decompress(content.as_buffer(), size.as_py(), CODEC, asbytes=True), drop_blank, "utf-8" if text.as_py() else None, check)
            except NotPlain:
                yield document_id.as_py(), None


def telling(values: pa.Array) -> pa.Array:
    """The different values, without those that tell inference no more than others."""
    values = pc.unique(values)
    left = np.ones(len(values), bool)
    for pattern in ALIKE:
        alike = np.flatnonzero(pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False))
        if len(alike) > 2:
            ends = pc.min_max(values.take(pa.array(alike))).as_py()
            left[alike] = False
            left[[values.index(ends["min"]).as_py(), values.index(ends["max"]).as_py()]] = True
    return values.filter(pa.array(left))


def facts(sources: DataFrame, drop_blank: bool = True) -> DataFrame:
    """What each document has: paths, paths that alternate, fields and their telling values; of one that isn't plain, a row that says so."""

    def rows_of(document_id: str, document: PlainDocument | None):
        if document is None:
            yield ("other", None, None, None, 1, None, document_id, None, None)
            return
        for p, path in enumerate(document.paths):
            mine = document.at_path[p]
            yield ("path", list(path), None, None, len(mine), document.most_per_parent(p), document_id, int(document.node_id[mine[0]]), None)
        for path in sorted(document.alternating()):
            yield ("alternating", list(path), None, None, None, None, document_id, None, None)
        for path, name, presence, _, ids, values in document.fields():
            some = None if values is None else values.filter(pc.not_equal(values, ""))
            most = pc.max(pc.value_counts(some).field("counts")).as_py() if some is not None and len(some) else 0
            yield ("field", list(path), name, presence, len(some) if some is not None else 0, most, document_id, int(ids.min()), None)
            for value in () if values is None else telling(values).to_pylist():
                yield ("value", list(path), name, presence, None, None, document_id, None, value)

    def kernel(batches):
        waiting: list[tuple] = []

        def taken():
            columns = zip(*waiting, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FACTS, strict=True)], schema=_FACTS)

        for document_id, document in _documents(batches, drop_blank, True):
            for row in rows_of(document_id, document):
                waiting.append(row)
                if len(waiting) == ROWS:
                    yield taken()
                    waiting.clear()
            document = None  # before the next one is made
        if waiting:
            yield taken()

    return map_arrow(sources.select("document_id", "content", "size", "text"), kernel, FACTS)


class Facts:
    """What all documents have together, on the driver: it follows the vocabulary. None of it if a document isn't plain."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.plain = not table.where("what = 'other'").limit(1).count()
        self.paths: dict[tuple[str, ...], tuple[int, int]] = {}  # occurrences, most under a parent
        self.first: dict[tuple[str, ...], tuple[str, int]] = {}
        self.alternating: set[tuple[str, ...]] = set()
        self.fields: list[Field] = []
        if not self.plain:
            return
        sums = table.where("what != 'value'").groupBy("what", "path", "name", "presence").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min(F.struct("document_id", "node_order")).alias("first"))
        for r in sums.collect():
            path = tuple(r.path)
            if r.what == "path":
                self.paths[path], self.first[path] = (r.n, r.most), tuple(r.first)
            elif r.what == "alternating":
                self.alternating.add(path)
            else:
                self.fields.append(Field(path, r.name, r.presence, r.n, r.most, Place(r.name is None, *r.first)))

    def names(self) -> list[Name]:
        seen: dict[Name, tuple] = {}
        for name, at in [(Name("element", "", "", p[-1]), at) for p, at in self.first.items()] + [(Name("attribute", "", "", f.name), f.place[1:]) for f in self.fields if f.name is not None]:
            seen[name] = min(at, seen.get(name, at))
        return sorted(seen, key=seen.__getitem__)

    def entities(self) -> dict[tuple[str, ...], int]:
        found = {p for p, (_, most) in self.paths.items() if len(p) == 1 or most > 1} | (self.alternating & set(self.paths))
        return {p: self.paths[p][0] for p in sorted(found, key=self.first.__getitem__)}

    def sources(self, entities: dict[tuple[str, ...], int]) -> list[Found]:
        """The fields as the catalog of columns reads them. Between an entity and a field no path repeats, so a field occurs once."""
        out = []
        for f in self.fields:
            depth = next(d for d in range(len(f.path), 0, -1) if f.path[:d] in entities)
            relative = list(f.path[depth:])
            kind = "attribute" if f.name is not None else "presence" if f.presence else "value"
            signature = "\u001e".join(["attribute" if f.name is not None else "element", "\u001f".join(relative), f.name or ""])
            out.append(Found(f.path[:depth], signature, f.presence, First(f.place, relative, f.name, kind), 1, [kind], f.path, f.name))
        return out

    def values(self, spark: SparkSession, columns: dict[tuple, str]) -> DataFrame:
        """column, value: the telling values. columns: by path, attribute's name and whether it is a presence."""
        known = dictionary(spark, [(list(p), n, c) for (p, n, presence), c in columns.items() if not presence], "path array<string>, name string, column string")
        own = self.table.where("what = 'value'").select("path", "name", "value").alias("x")
        on = (F.col("x.path") == F.col("k.path")) & F.col("x.name").eqNullSafe(F.col("k.name"))
        return own.join(known.alias("k"), on).select("column", "value")


def rows(sources: DataFrame, entities: list[tuple[str, ...]], columns: dict[tuple, str], drop_blank: bool = True) -> DataFrame:
    """document_id, entity (its number), node_id, parent_id, above (the node of the entity above), depth, occurrence, and a
    text column c0, c1... for each of columns: the row's own fields and those of the entity above. columns: as in Facts.values.
    """
    number = {p: i for i, p in enumerate(entities)}
    above = [next((number[p[:d]] for d in range(len(p) - 1, 0, -1) if p[:d] in number), None) for p in entities]
    places = {key: i for i, key in enumerate(columns)}
    names = ["document_id", "entity", "node_id", "parent_id", "above", "depth", "occurrence", *(f"c{i}" for i in range(len(columns)))]
    types = [pa.string(), *[pa.int32()] * 6, *[pa.string()] * len(columns)]

    def owners(document: PlainDocument, elements: np.ndarray, path: tuple[str, ...], to: int) -> np.ndarray:
        """The elements' ancestors at the depth of a path's first `to` steps."""
        for _ in range(len(path) - to):
            elements = document.parent[elements]
        return elements

    def rows_of(document_id: str, document: PlainDocument | None):
        if document is None:  # the first reading has seen all
            raise ValueError(f"document '{document_id}' has changed")
        of = {number[p]: document.at_path[i] for i, p in enumerate(document.paths) if p in number}
        rank = np.zeros(len(document.path), np.int32)
        for mine in of.values():
            rank[mine] = np.arange(len(mine))
        own: dict[int, dict[int, tuple[np.ndarray, pa.Array]]] = {e: {} for e in of}  # by entity and column: places of its rows' values, -1 for none
        for path, name, presence, elements, _, values in document.fields():
            depth = next(d for d in range(len(path), 0, -1) if path[:d] in number)
            e = number[path[:depth]]
            at = np.full(len(of[e]), -1, np.int32)
            at[rank[owners(document, elements, path, depth)]] = np.arange(len(elements)) if values is not None else 0
            own[e][places[path, name, presence]] = at, pa.array(["TRUE"]) if values is None else values
        for e, mine in of.items():
            up = None
            if above[e] is not None:
                up = owners(document, mine, entities[e], len(entities[above[e]]))
            for start in range(0, len(mine), ROWS):
                now = mine[start : start + ROWS]
                n = len(now)
                out = [pa.repeat(pa.scalar(document_id, pa.string()), n), pa.repeat(pa.scalar(e, pa.int32()), n), pa.array(document.node_id[now], pa.int32())]
                parents = document.parent[now]
                out.append(pa.array(np.where(parents < 0, 1, document.node_id[parents]), pa.int32()))
                out.append(pa.nulls(n, pa.int32()) if up is None else pa.array(document.node_id[up[start : start + n]], pa.int32()))
                out += [pa.array(document.depth[now], pa.int32()), pa.array(np.arange(start + 1, start + n + 1), pa.int32())]
                for c in range(len(columns)):
                    if c in own[e]:
                        at, values = own[e][c]
                        at = at[start : start + n]
                    elif up is not None and c in own[above[e]]:
                        at, values = own[above[e]][c]
                        at = at[rank[up[start : start + n]]]
                    else:
                        out.append(pa.nulls(n, pa.string()))
                        continue
                    out.append(values.take(pa.array(at, mask=at < 0)))
                yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(out, types, strict=True)], names)

    def kernel(batches):
        for document_id, document in _documents(batches, drop_blank, False):
            yield from rows_of(document_id, document)
            document = None  # before the next one is made

    schema = "document_id string, entity int, node_id int, parent_id int, above int, depth int, occurrence int" + "".join(f", c{i} string" for i in range(len(columns)))
    return map_arrow(sources.select("document_id", "content", "size", "text"), kernel, schema)


def source_path(path: tuple[str, ...]) -> str:
    return "/".join(local_of(p) for p in path)
