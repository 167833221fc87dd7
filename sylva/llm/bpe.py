"""Byte-level BPE by recursive queries.

Each task has a DuckDB database of its own with the merge table of the vocabulary. The distinct pre-tokens of a
batch become rows (word, position, token); a recursive query joins neighbours to the merge table and contracts
each word's leftmost pair of least rank, until no word has a pair. The ids of a text are those of its pre-tokens
in order. Decoding joins (text, position, id) rows to the vocabulary and aggregates each text's pieces in order of position.

Nulls: a null text is encoded as an empty one, null ids decode to nothing; doc_id may be null or repeated. A
pre-token of more than LONG bytes is contracted pair by pair outside SQL, where the steps of a recursive query
would hold the square of its length. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.kernels import kept as kept_in_worker
from ..functions.kernels import map_arrow
from .common import documents, gathered
from .pretokens import Numbered, PreTokenizer

LONG = 256
#: Rows of all steps of one recursive query (at most the squares of its words' lengths), rows in one decoding query, and
#: remembered pre-tokens: bounds on memory. Nothing is spilled to a machine's disk.
STEP_ROWS, ROWS, KNOWN = 4_000_000, 1_000_000, 1_000_000
#: Rows whose new pre-tokens are contracted together, and characters whose parts are looked up at once.
GATHERED, CUT = 8000, 8_000_000

# A row has the key of the pair that it begins: the rank of the merged token, then the place. One window over all words in
# order reads the neighbours: it sorts once for each step, where windows by word would be many and small.
CONTRACT = """
WITH RECURSIVE s(step, w, pos, tok, key) AS (
    SELECT 0, w, pos, tok, (m.merged::BIGINT << 20) + pos
    FROM (SELECT *, CASE WHEN lead(w) OVER o = w THEN lead(tok) OVER o END AS nxt FROM start WINDOW o AS (ORDER BY w, pos)) n
    LEFT JOIN merges m ON m.pair = (n.tok::BIGINT << 32) + n.nxt
  UNION ALL
    SELECT step + 1, w, pos, n.tok, (m.merged::BIGINT << 20) + pos
    FROM (
        SELECT step, w, pos,
            CASE WHEN key = best THEN (best >> 20)::INTEGER ELSE tok END AS tok,
            CASE WHEN key = best THEN CASE WHEN w2 = w THEN tok2 END
                 WHEN w1 = w THEN CASE WHEN key1 = best THEN (best >> 20)::INTEGER ELSE tok1 END END AS nxt
        FROM (
            SELECT s.*, best,
                lag(s.w) OVER o AS w0, lag(key) OVER o AS key0,
                lead(s.w) OVER o AS w1, lead(key) OVER o AS key1, lead(tok) OVER o AS tok1,
                lead(s.w, 2) OVER o AS w2, lead(tok, 2) OVER o AS tok2
            FROM s JOIN (SELECT w, min(key) AS best FROM s GROUP BY w HAVING min(key) IS NOT NULL) b ON b.w = s.w
            WINDOW o AS (ORDER BY s.w, s.pos)
        )
        WHERE NOT (w0 IS NOT DISTINCT FROM w AND key0 IS NOT DISTINCT FROM best)
    ) n
    LEFT JOIN merges m ON m.pair = (n.tok::BIGINT << 32) + n.nxt
)
SELECT s.w, list(tok ORDER BY pos) AS ids
FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) last ON s.w = last.w AND s.step = last.step
GROUP BY s.w ORDER BY s.w
"""

# An id that the vocabulary doesn't have gives a null piece.
DECODE = "SELECT text, list(piece ORDER BY pos) AS pieces FROM rows LEFT JOIN vocabulary USING (tok) GROUP BY text ORDER BY text"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by one vocabulary; one to a worker process."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.texts = Numbered(PreTokenizer(pattern))
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], n) for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        l, r, merged = np.array(pairs, dtype=np.int64).T
        merges = pa.table({"pair": (l << 32) + r, "merged": merged.astype(np.int32)})
        self.names = pa.array(map(str, range(max(self.ranks.values()) + 1)), pa.string())
        vocabulary = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "piece": pa.array(self.ranks.keys(), pa.binary())})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.forget()

    def forget(self) -> None:
        self.texts.forget()
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pre-tokens, which have the next numbers, in order."""
        words = [p.encode() for p in pieces]
        starts, lengths = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
        found, total = [self.ids], len(self.ids)
        ranks = list(map(self.ranks.get, words))
        single = [i for i, n in enumerate(ranks) if n is not None]
        rest = [i for i, n in enumerate(ranks) if n is None]

        def keep(at: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
            nonlocal total
            lengths[at], starts[at] = sizes, total + np.cumsum(sizes) - sizes
            found.append(ids)
            total += len(ids)

        keep(single, np.ones(len(single), np.int64), np.array([ranks[i] for i in single], np.int32))
        short = [i for i in rest if len(words[i]) <= LONG]
        for i, j in _runs([len(words[i]) ** 2 for i in short], STEP_ROWS):
            keep(short[i:j], *self.contract([words[k] for k in short[i:j]]))
        for i in rest:
            if len(words[i]) > LONG:
                ids = np.array(contract_long(self.bytes[np.frombuffer(words[i], np.uint8)].tolist(), self.pairs), np.int32)
                keep([i], np.array([len(ids)]), ids)
        self.starts, self.lengths, self.ids = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths]), np.concatenate(found)

    @property
    def pairs(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_pairs"):
            found = self.db.execute("SELECT pair >> 32 AS l, pair & 4294967295 AS r, merged FROM merges").fetchnumpy()
            self._pairs = dict(zip(zip(found["l"].tolist(), found["r"].tolist(), strict=True), found["merged"].tolist(), strict=True))
        return self._pairs

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(b) for b in words], dtype=np.int64)
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        tok = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        self.db.register("start", pa.table({"w": w, "pos": pos, "tok": tok}))
        out = self.db.sql(CONTRACT).to_arrow_table()["ids"].combine_chunks()
        self.db.unregister("start")
        return np.diff(out.offsets.to_numpy()).astype(np.int64), out.values.to_numpy().astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end."""
        texts = pa.array(texts, pa.string())
        return self._ids(texts, *self._parts(texts))

    def runs(self, texts: pa.Array):
        """a, b, ids, ends: encode() of neighbours texts[a:b] of at most ROWS characters. The parts of many runs are looked up at
        once, each different one a single time."""
        texts = pc.fill_null(texts, "")
        sizes = pc.utf8_length(texts).to_pylist()
        for first, last in _runs(sizes, CUT):
            at, ends = self._parts(texts.slice(first, last - first))
            for a, b in _runs(sizes[first:last], ROWS):
                yield first + a, first + b, *self._ids(texts.slice(first + a, b - a), at[ends[a] : ends[b]], ends[a : b + 1] - ends[a])

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.texts.pieces) > KNOWN or self.texts.full:
            self.forget()
        return self.texts.parts_of(texts)

    def _ids(self, texts: pa.Array, parts: np.ndarray, part_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, counts = self.texts.pieces_of(texts, parts, part_ends)
        if len(self.texts.pieces) > len(self.lengths):
            self.learn(list(islice(self.texts.pieces, len(self.lengths), None)))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[counts]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text; ends: where each text's ids end, from 0. An ordered aggregation of their pieces."""
        text = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        self.db.register("rows", pa.table({"text": text, "pos": np.arange(len(ids), dtype=np.int32), "tok": ids}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("rows")
        out = [b""] * (len(ends) - 1)
        for batch in found.to_batches():
            lists = batch.column("pieces")
            pieces = lists.values
            if pieces.null_count:
                raise ValueError("an id that the vocabulary doesn't have")
            _, offsets, values = pieces.buffers()
            at = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1][lists.offsets.to_numpy()]
            data = memoryview(values or b"")  # the pieces of a list lie one after the other
            for i, a, b in zip(batch.column("text").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[i] = bytes(data[a:b])
        return out


def contract_long(tokens: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same contraction of one long word: a heap of (rank, position) over a linked list."""
    n = len(tokens)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    alive = [True] * n
    heap = [(m, i) for i in range(n - 1) if (m := pairs.get((tokens[i], tokens[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        m, i = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or pairs.get((tokens[i], tokens[j])) != m:
            continue
        tokens[i], alive[j], after[i] = m, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (m := pairs.get((tokens[a], tokens[b]))) is not None:
                heapq.heappush(heap, (m, a))
    return [t for t, x in zip(tokens, alive, strict=True) if x]


@kept_in_worker
@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _runs(sizes: list[int], most: int):
    """Ranges of neighbours whose sizes add up to `most` at the most; a larger one is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def encoded(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and ids, the tokens of the whole text as array<int>."""

    def encode(batches):
        c = codec(path, pattern)
        for batch in gathered(batches, GATHERED):
            for a, b, ids, ends in c.runs(batch.column(batch.num_columns - 1)):
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns[:-1]), lists], [*keep, "ids"])

    rows = docs.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, encode, f"{kept}, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of rows and bytes, what their ids stand for."""

    def decode(batches):
        c = codec(path, pattern)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = [n or 0 for n in lists.value_lengths().to_pylist()]
            for a, b in _runs(sizes, ROWS):
                part = lists.slice(a, b - a)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                out = c.decode(ids, np.cumsum([0, *sizes[a:b]]))
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns[:-1]), pa.array(out, pa.binary())], [*keep, "bytes"])

    rows = rows.select(*keep, "ids")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, decode, f"{kept}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded and decoded by one process."""

    def kernel(batches):
        c = codec(path, pattern)
        for batch in gathered(batches, GATHERED):
            for a, b, ids, ends in c.runs(batch.column(batch.num_columns - 1)):
                out = c.decode(ids, ends)
                names = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c.names.take(pa.array(ids))), " ")
                columns = [
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in names], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns[:-1]), *columns], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, kernel, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
