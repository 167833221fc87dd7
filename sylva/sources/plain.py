"""Plain documents, read as arrays: elements, attributes in double quotes and texts, without prefixes, declarations or mixed content.

The same elements, node ids and values as the parse kernel's, without a Python object for each node. A document is cut
into pieces at its tags; a tag's markup is one of few strings, so each different one is taken apart once. What isn't
plain is left to the kernel.
"""

from __future__ import annotations

import re
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .parse import BLANK, PIECE

#: Bytes of a document that are taken apart at once.
BYTES = 1 << 20
#: Levels of elements beyond which a document isn't plain.
DEEPEST = 64

_NAME = r"[^\s/=:'\"<>&]+"
_HEAD = re.compile(rf"(/?)({_NAME})(?:\s+({_NAME})\s*=\s*|\s*(/?))")
_NEXT = re.compile(rf"\s+({_NAME})\s*=\s*|\s*(/?)")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


class NotPlain(Exception):
    """A document has something that only the kernel reads."""


def _numbered(a: np.ndarray, b: np.ndarray, many: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Numbers of pairs of small numbers, and the pairs; b is below many."""
    both = a.astype(np.int64) * many + b
    used = np.flatnonzero(np.bincount(both))
    number = np.zeros(int(used[-1]) + 1 if len(used) else 0, np.int64)
    number[used] = np.arange(len(used))
    return number[both], [divmod(int(x), many) for x in used]


class PlainDocument:
    """names, depths, node ids, parents and paths of the elements in order, and the values of their attributes and texts.

    check: whether the document may not be well-formed; then it isn't plain.
    """

    def __init__(self, raw: bytes, drop_blank: bool, encoding: str | None = "utf-8", check: bool = True):
        if any(x in raw for x in (b"<!", b"<?", b"&#", b"\r", b"\0")) or raw[:3] == b"\xef\xbb\xbf":
            raise NotPlain
        if check:
            parser = expat.ParserCreate(encoding)
            try:
                for i in range(0, len(raw), PIECE):
                    parser.Parse(raw[i : i + PIECE], False)
                parser.Parse(b"", True)
            except expat.ExpatError as error:
                raise NotPlain from error
        self.drop_blank, self.escapes = drop_blank, b"&" in raw
        self.numbers: dict[tuple, int] = {}  # of shapes: what kind of tag, its name and its attributes
        self.shapes: list[tuple] = []
        self.values: dict[tuple[int, int], list[pa.Array]] = {}  # by shape and place of the attribute; -1: texts
        tags, texted, at = [], [], raw.find(b"<")
        while 0 <= at < len(raw):
            end = raw.rfind(b"<", at + 1, at + BYTES) if at + BYTES < len(raw) else len(raw)
            if end < 0:
                end = raw.find(b"<", at + BYTES)
                end = len(raw) if end < 0 else end
            shape, text = self._piece(raw[at:end])
            tags.append(shape)
            texted.append(text)
            at = end
        self._elements(np.concatenate(tags), np.concatenate(texted))

    def _piece(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The shapes of the tags of a piece, which begins with one, and whether a text follows."""
        buf = np.frombuffer(raw, np.uint8)
        lt, gt = np.flatnonzero(buf == 60), np.flatnonzero(buf == 62)
        n = len(lt)
        if len(gt) != n or not (lt < gt).all() or not (gt[:-1] < lt[1:]).all():
            raise NotPlain

        def inside(places: np.ndarray) -> np.ndarray:
            tag = np.searchsorted(lt, places, "right") - 1
            return places < gt[tag]

        for other in (buf == 39, buf < 32):
            if inside(np.flatnonzero(other)).any():
                raise NotPlain
        quotes = np.flatnonzero(buf == 34)
        quotes = quotes[inside(quotes)]
        per_tag = np.bincount(np.searchsorted(lt, quotes, "right") - 1, minlength=n)
        if (per_tag & 1).any():
            raise NotPlain
        cut = (buf == 60) | (buf == 62)
        cut[quotes] = True
        at = np.flatnonzero(cut)
        # Segments: what stands between two cuts, and each cut itself, one after the other.
        offsets = np.empty(2 * len(at) + 2, np.int32)
        offsets[0], offsets[1:-1:2], offsets[2::2], offsets[-1] = 0, at, at + 1, len(raw)
        segments = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw))
        first = 2 * np.flatnonzero(buf[at] == 60) + 2  # of each tag
        attributes = per_tag // 2
        shape = self._shapes(segments, first, attributes)
        after = first + 2 * per_tag + 2
        length = (offsets[1:] - offsets[:-1])[after]
        text = length > 0
        if self.drop_blank:
            unsure = np.flatnonzero(text & (buf[np.minimum(offsets[after], len(raw) - 1)] <= 32))
            if len(unsure):
                text[unsure] = [bool(x.strip(BLANK)) for x in segments.take(pa.array(after[unsure])).to_pylist()]
        for s in np.unique(shape).tolist():
            mine = shape == s
            for j in range(len(self.shapes[s][2])):
                self.values.setdefault((s, j), []).append(self._taken(segments, first[mine] + 4 * j + 2))
            if text[mine].any():
                self.values.setdefault((s, -1), []).append(self._taken(segments, after[mine & text]))
        return shape, text

    def _taken(self, segments: pa.Array, at: np.ndarray) -> pa.Array:
        out = segments.take(pa.array(at))
        if self.escapes:
            for a, b in _ENTITIES:
                out = pc.replace_substring(out, a, b)
        return out

    def _shapes(self, segments: pa.Array, first: np.ndarray, attributes: np.ndarray) -> np.ndarray:
        def coded(at: np.ndarray) -> tuple[np.ndarray, list[str]]:
            found = segments.take(pa.array(at)).dictionary_encode()
            return found.indices.to_numpy(), found.dictionary.to_pylist()

        code, heads = coded(first)
        known: list[tuple] = []
        for head in heads:
            m = _HEAD.fullmatch(head)
            if not m or m[1] and (m[3] or m[4]):
                raise NotPlain
            known.append(("end" if m[1] else "empty" if m[4] else "open" if m[3] else "start", m[2], (m[3],) if m[3] else ()))
        for j in range(int(attributes.max(initial=0))):
            has = np.flatnonzero(attributes > j)
            more, nexts = coded(first[has] + 4 * j + 4)
            of, pairs = _numbered(code[has], more, len(nexts))
            made = []
            for a, b in pairs:
                kind, name, names = known[a]
                m = _NEXT.fullmatch(nexts[b])
                if not m or kind != "open":
                    raise NotPlain
                made.append(("open" if m[1] else "empty" if m[2] else "start", name, (*names, m[1]) if m[1] else names))
            code = code.copy()
            code[has] = of + len(known)
            known += made
        numbers = np.full(len(known), -1, np.int64)
        for c in np.unique(code).tolist():
            if known[c][0] == "open" or "xmlns" in known[c][2]:
                raise NotPlain
            if known[c] not in self.numbers:
                self.numbers[known[c]] = len(self.shapes)
                self.shapes.append(known[c])
            numbers[c] = self.numbers[known[c]]
        return numbers[code].astype(np.int32)

    def _elements(self, shape: np.ndarray, text: np.ndarray) -> None:
        kinds = np.array([{"start": 0, "end": 1, "empty": 2}[k] for k, *_ in self.shapes], np.int8)[shape]
        level = np.cumsum(np.array([1, -1, 0], np.int8)[kinds], dtype=np.int32)
        text = text & (level > 0)  # around the root there are blanks only
        if (text & (kinds != 0)).any() or (text[:-1] & (kinds[1:] != 1)).any():  # text beside elements
            raise NotPlain
        is_element = kinds != 1
        self.depth = (level + (kinds == 2))[is_element].astype(np.int32)
        deepest = int(self.depth.max(initial=0))
        if deepest > DEEPEST:
            raise NotPlain
        self.shape, self.texted = shape[is_element], text[is_element]
        attributes = np.array([len(a) for *_, a in self.shapes], np.int32)[self.shape]
        self.attributes = attributes
        nodes = 1 + attributes + self.texted
        self.node_id = 2 + np.cumsum(nodes, dtype=np.int32) - nodes  # the document is node 1
        self.ordinal = np.zeros(len(self.shape), np.int32)  # among the elements of a shape
        self.text_ordinal = np.zeros(len(self.shape), np.int32)
        for s in range(len(self.shapes)):
            mine = np.flatnonzero(self.shape == s)
            self.ordinal[mine] = np.arange(len(mine))
            self.text_ordinal[mine] = np.cumsum(self.texted[mine]) - 1
        names = sorted({n for _, n, _ in self.shapes})
        name = np.array([names.index(n) for _, n, _ in self.shapes], np.int32)[self.shape]
        self.parent, self.path = np.full(len(self.shape), -1, np.int32), np.zeros(len(self.shape), np.int32)
        self.paths: list[tuple[str, ...]] = []
        above = np.zeros(0, np.int64)
        for d in range(1, deepest + 1):
            mine = np.flatnonzero(self.depth == d)
            if d > 1:
                self.parent[mine] = above[np.searchsorted(above, mine) - 1]
            of, pairs = _numbered(self.path[self.parent[mine]] if d > 1 else np.zeros(len(mine), np.int64), name[mine], len(names))
            self.path[mine] = of + len(self.paths)
            self.paths += [(*(self.paths[p] if d > 1 else ()), names[n]) for p, n in pairs]
            above = mine
        self.inner = np.zeros(len(self.shape), bool)  # has elements
        self.inner[self.parent[self.parent >= 0]] = True
        self.at_path = [np.flatnonzero(self.path == p).astype(np.int32) for p in range(len(self.paths))]

    def most_per_parent(self, path: int) -> int:
        parents = self.parent[self.at_path[path]]  # in order
        starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        return int(np.diff(np.append(starts, len(parents))).max())

    def alternating(self) -> set[tuple[str, ...]]:
        """The paths of children of parents whose children alternate between one path and others, one of which occurs once, and of those parents."""
        out: set[tuple[str, ...]] = set()
        for d in range(2, int(self.depth.max(initial=0)) + 1):
            mine = np.flatnonzero(self.depth == d)
            parent, path = self.parent[mine], self.path[mine]
            starts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            counts = np.diff(np.append(starts, len(parent)))
            leads = path == np.repeat(path[starts], counts)
            fits = leads == ((np.arange(len(mine)) - np.repeat(starts, counts)) % 2 == 0)
            good = (counts >= 4) & (counts % 2 == 0) & np.logical_and.reduceat(fits, starts)
            for g in np.flatnonzero(good).tolist():
                children, often = np.unique(path[starts[g] : starts[g] + counts[g]], return_counts=True)
                if (often == 1).any():
                    out |= {self.paths[c] for c in children} | {self.paths[c][:-1] for c in children}
        return out

    def fields(self):
        """Path, attribute's name or None, whether it is a presence, its elements, node ids and values (None: of a presence), one after the other."""
        for p, path in enumerate(self.paths):
            mine = self.at_path[p]
            shapes = np.unique(self.shape[mine]).tolist()
            for name in sorted({a for s in shapes for a in self.shapes[s][2]}):
                parts = []
                for s in shapes:
                    if name in self.shapes[s][2]:
                        j = self.shapes[s][2].index(name)
                        some = mine[self.shape[mine] == s]
                        parts.append((some, self.node_id[some] + 1 + j, self._of(s, j, self.ordinal[some])))
                yield path, name, False, *_joined(parts)
            parts = []
            for s in shapes:
                some = mine[(self.shape[mine] == s) & self.texted[mine]]
                if len(some):
                    parts.append((some, self.node_id[some], self._of(s, -1, self.text_ordinal[some])))
            if parts:
                yield path, None, False, *_joined(parts)
            some = mine[~self.texted[mine] & ~self.inner[mine] & (self.attributes[mine] == 0)]
            if len(some):
                yield path, None, True, some, self.node_id[some], None

    def _of(self, shape: int, place: int, at: np.ndarray) -> pa.Array:
        values = self.values[shape, place]
        if len(values) > 1:
            values = self.values[shape, place] = [pa.concat_arrays(values)]
        return values[0] if len(at) == len(values[0]) else values[0].take(pa.array(at))


def _joined(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    elements, ids, values = zip(*parts, strict=True)
    return np.concatenate(elements), np.concatenate(ids), pa.concat_arrays(values) if len(values) > 1 else values[0]
