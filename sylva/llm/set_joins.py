"""Exact Jaccard links inside candidate blocks, by T-occurrence search with DivideSkip.

Sets that can be similar lie in one block. A block has an inverted index: for each element the sets with it, in order
of size. A query with n elements needs partners that occur in at least T of its lists. The longest lists are set aside.
The short ones are merged, by a heap or, where they hold many entries, by counting; what occurs often enough there is
looked up in the long ones by binary search. Only links that join two components are returned: their closure is that of
all links.

A block with many sets is cut by size into buckets so wide that similar sets are in one or in neighbours, and these into
parts. Each two parts that can have similar sets meet in a cell of their own, so no task holds more than a cell, whatever
the size of a block. A part is copied into each of its cells, which for a large block is many times: the cells are dealt to
rounds, so that the copies of one round are about as many as the sets.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, map_arrow, maybe_broadcast, release, written

#: Sets and elements in a part of a block.
PART_SETS, PART_ELEMENTS = 3000, 500_000
#: The weight of DivideSkip's choice of how many lists are long.
MU = 0.01
#: Up to so many entries of short lists are merged by a heap; more are counted, which gives the same.
HEAP = 64
#: Candidates that are looked up in the long lists at once; those that these links join to the query are then passed over.
PROBED = 32
#: Cells of at most so many sets are merged together, all their lists by counting, up to so many entries in pairs: no list is
#: long there.
SMALL, TOGETHER = 48, 2_000_000
#: The elements that the cells of a round hold, copies included, are about so many times those of all sets.
ROUND = 1.5


def least_overlap(n: int, percent: int) -> int:
    """The fewest elements that a set of n shares with any partner of at most its size, at this similarity."""
    return -(-percent * n // 100)


def divide_skip(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets (sorted, distinct elements), as many as join components. side: only across sides."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if side is not None:
        side = side[order]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    by_element = np.argsort(element, kind="stable")
    lists = owner[by_element]  # of all elements, one after the other; the sets of a list are in order of size
    entries = element[by_element] * len(sets) + lists  # sorted: a list is searched by (element, set)
    starts = np.concatenate([[0], np.cumsum(np.bincount(element))])
    place = np.empty(len(element), dtype=np.int64)
    place[by_element] = np.arange(len(element))
    ends = np.cumsum(sizes)
    label, links = np.arange(len(sets)), []  # of the components
    for x in range(1, len(sets)):
        n = int(sizes[x])
        mine = element[ends[x] - n : ends[x]]
        lengths = place[ends[x] - n : ends[x]] - starts[mine]  # the sets before x in each list
        need = least_overlap(n, percent)
        longest = int(lengths.max(initial=0))
        if not longest:
            continue
        aside = min(need - 1, int(need / (MU * math.log2(longest + 1) + 1)))
        by_length = np.argsort(-lengths, kind="stable")
        long, short = by_length[:aside], by_length[aside:]
        found, counts = _merged(lists, starts[mine[short]], lengths[short], need - aside)
        fit = 100 * sizes[found] >= percent * n
        if side is not None:
            fit &= side[found] != side[x]
        best = np.argsort(-counts[fit], kind="stable")
        found, counts = found[fit][best], counts[fit][best]
        if len(found) * len(long) > int(lengths[long].sum()):  # so many that merging the long lists costs less than probing them
            counts = counts + np.bincount(_entries(lists, starts[mine[long]], lengths[long]), minlength=x)[found]
            long = long[:0]
        while len(found):
            now, overlap = found[:PROBED], counts[:PROBED]
            if len(long):
                asked = mine[long][None, :] * len(sets) + now[:, None]
                at = np.minimum(np.searchsorted(entries, asked), len(entries) - 1)
                overlap = overlap + (entries[at] == asked).sum(axis=1)
            for c in now[100 * overlap >= percent * (n + sizes[now] - overlap)].tolist():
                if label[c] != label[x]:
                    label[label == label[x]] = label[c]
                    links.append((order[c], order[x]))
            left = label[found[PROBED:]] != label[x]
            found, counts = found[PROBED:][left], counts[PROBED:][left]
    return links


def _entries(lists: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first `lengths` entries of the lists that begin at `starts`."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return lists[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _merged(lists: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What occurs in at least so many of the lists, in order, and in how many."""
    if int(lengths.sum()) > HEAP:
        counts = np.bincount(_entries(lists, starts, lengths))
        found = np.flatnonzero(counts >= max(1, least))
        return found, counts[found]
    heap = [(int(lists[a]), int(a), int(a + n)) for a, n in zip(starts, lengths, strict=True) if n]
    heapq.heapify(heap)
    found, counts = [], []
    while heap:
        top, k = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, a, end = heap[0]
            k += 1
            if a + 1 < end:
                heapq.heapreplace(heap, (int(lists[a + 1]), a + 1, end))
            else:
                heapq.heappop(heap)
        if k >= least:
            found.append(top)
            counts.append(k)
    return np.array(found, np.int64), np.array(counts, np.int64)


def small_links(cells: list[tuple[list[np.ndarray], np.ndarray | None]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sets of many small cells, one after the other: a set of the same component, and whether it has a link.

    cells: sets (elements in order), and sides if only links across them count. T-occurrence with all lists merged at once:
    the entries of a cell's list are paired, and the pairs counted.
    """
    sets = [x for elements, _ in cells for x in elements]
    sizes = np.array([len(x) for x in sets])
    cell = np.repeat(np.arange(len(cells)), [len(elements) for elements, _ in cells])
    side = np.concatenate([np.zeros(len(e), np.int64) if across is None else across.astype(np.int64) for e, across in cells])
    crossing = np.array([across is not None for _, across in cells])[cell]
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets)
    order = np.lexsort((owner, element, cell[owner]))
    element, owner = element[order], owner[order]
    new_list = np.append(True, (element[1:] != element[:-1]) | (cell[owner[1:]] != cell[owner[:-1]]))
    kept = new_list | np.append(True, owner[1:] != owner[:-1])  # an element counts once in a set
    list_ = np.cumsum(new_list)[kept]
    owner = owner[kept]
    distinct = np.bincount(owner, minlength=len(sets))
    pairs = []
    for d in range(1, max(len(elements) for elements, _ in cells)):
        same = np.flatnonzero(list_[:-d] == list_[d:])
        if not len(same):
            break
        pairs.append(owner[same] * len(sets) + owner[same + d])
    label, linked = np.arange(len(sets)), np.zeros(len(sets), bool)
    if pairs:
        pairs = np.sort(np.concatenate(pairs))
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        overlap = np.diff(np.append(first, len(pairs)))
        a, b = np.divmod(pairs[first], len(sets))
        fit = 100 * overlap >= percent * (distinct[a] + distinct[b] - overlap)
        fit &= ~crossing[a] | (side[a] != side[b])
        a, b = a[fit], b[fit]
        linked[a] = linked[b] = True
        while True:
            before = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            if (label == before).all():
                break
    return label, linked


#: Sets whose cells are compared together, pairs verified at once, and sets of a cell up to which all its pairs are compared.
COMPARED, VERIFIED, ALL_PAIRS = 8000, 1000, 48


class Sets:
    """Sets as rows of a matrix, with 256 bits of each: what one set's bits have over another's bounds their overlap from above."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent, self.sizes = percent, sizes
        self.places = np.arange(int(sizes.max(initial=1)))
        begins = np.cumsum(sizes) - sizes
        # A shorter row repeats its last element: the same set.
        self.rows = values[begins[:, None] + np.minimum(self.places, sizes[:, None] - 1)]
        order = np.argsort(self.rows, axis=1, kind="stable")
        inorder = np.take_along_axis(self.rows, order, axis=1)
        new = np.ones(inorder.shape, bool)
        new[:, 1:] = inorder[:, 1:] != inorder[:, :-1]
        self.first = np.empty_like(new)
        np.put_along_axis(self.first, order, new, axis=1)
        self.distinct = new.sum(axis=1)
        flags = np.zeros((len(sizes), 256), bool)
        flags[np.arange(len(sizes))[:, None], self.rows & 255] = True
        self.bits = np.packbits(flags, axis=1).view(np.uint64)
        self.spare = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64) - self.distinct

    def maybe(self, a, b) -> np.ndarray:
        """Flags of the pairs that may be similar; similar ones all are among them."""
        common = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64)
        least = -(-self.percent * (self.distinct[a] + self.distinct[b]) // (100 + self.percent))
        return common >= np.maximum(self.spare[a], self.spare[b]) + least

    def similar(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """a and b of the pairs that are similar, and from where to behind where either's elements are in the other."""
        out = []
        for at in range(0, len(a), VERIFIED):
            x, y = a[at : at + VERIFIED], b[at : at + VERIFIED]
            same = self.rows[x][:, :, None] == self.rows[y][:, None, :]
            in_y, in_x = same.any(axis=2), same.any(axis=1)
            overlap = (in_y & self.first[x]).sum(axis=1)
            fit = 100 * overlap >= self.percent * (self.distinct[x] + self.distinct[y] - overlap)
            x, y, spans = x[fit], y[fit], []
            for of, flags in ((x, in_y[fit]), (y, in_x[fit])):
                flags &= self.places < self.sizes[of][:, None]
                spans += [flags.argmax(axis=1), flags.shape[1] - flags[:, ::-1].argmax(axis=1)]
            out.append((x, y, *spans))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 6


def span_links(values: np.ndarray, sizes: np.ndarray, cells: np.ndarray, sides: np.ndarray, crossing: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """For the sets of many cells: one of the same component, whether it has a link, and lo and hi, from where to behind where partners have its elements.

    values, sizes: all sets' elements. cells: numbers of their cells, ascending. Where crossing, only links across sides count.
    All pairs of a small cell are compared; of a larger one those that share a rare element and that no link joins by then.
    """
    sets, n = Sets(values, sizes, percent), len(sizes)
    label, linked = np.arange(n), np.zeros(n, bool)
    lo, hi = np.full(n, np.iinfo(np.int32).max), np.zeros(n, np.int64)

    def keep(a, b, a_lo, a_hi, b_lo, b_hi):
        linked[a] = linked[b] = True
        for at, low, high in ((a, a_lo, a_hi), (b, b_lo, b_hi)):
            np.minimum.at(lo, at, low)
            np.maximum.at(hi, at, high)

    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)
    large = np.repeat(ends - starts > ALL_PAIRS, ends - starts)
    pairs = []
    for d in range(1, ALL_PAIRS):
        a = np.flatnonzero((cells[:-d] == cells[d:]) & ~large[d:])
        if not len(a):
            break
        b = a + d
        meet = ~crossing[a] | (sides[a] != sides[b])
        a, b = a[meet], b[meet]
        found = sets.maybe(a, b)
        pairs.append((a[found], b[found]))
    if pairs:
        a, b, *spans = sets.similar(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
        keep(a, b, *spans)
        while True:
            before = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            if (label == before).all():
                break
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if end - start <= ALL_PAIRS:
            continue
        for a, b in _meetings(sets, start, end, label):
            if crossing[start]:
                apart = sides[a] != sides[b]
                a, b = a[apart], b[apart]
            near = sets.maybe(a, b)
            a, b, *spans = sets.similar(a[near], b[near])
            keep(a, b, *spans)
            label[start:end] = start + _united(label[start:end] - start, a - start, b - start)
    return label, linked, lo, hi


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least of each component) after links between a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _meetings(sets: Sets, start: int, end: int, label: np.ndarray):
    """Pairs of a large cell, some at a time, among which are all similar ones that no earlier link joins. label changes meanwhile.

    Of each set only its rarest elements count, so many that similar sets have one of them in common. In each of their lists
    all sets meet the first one, then those meet that are still apart.
    """
    n, percent = end - start, sets.percent
    rows, first, distinct = sets.rows[start:end], sets.first[start:end], sets.distinct[start:end]
    _, element, often = np.unique(rows, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    ranks = np.sort(np.where(first, rank[element.reshape(rows.shape)], len(often)), axis=1)
    least = -(-percent * (distinct + np.maximum(distinct.min(), -(-percent * distinct // 100))) // (100 + percent))
    owner, place = np.nonzero(np.arange(rows.shape[1]) < (distinct - least + 1)[:, None])
    of = ranks[owner, place]
    order = np.argsort(of, kind="stable")
    of, owner = of[order], owner[order] + start
    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    leader = np.repeat(owner[begins], np.diff(np.append(begins, len(of))))
    pairs = np.unique((leader * end + owner)[leader != owner])
    for at in range(0, len(pairs), n):
        a, b = np.divmod(pairs[at : at + n], end)
        apart = label[a] != label[b]
        yield a[apart], b[apart]
    # Lists of one component alone have nothing more to give.
    mixed_lists = np.logical_or.reduceat(label[owner] != label[leader], begins)
    left = np.repeat(mixed_lists, np.diff(np.append(begins, len(of))))
    of, owner = of[left], owner[left]
    at = np.arange(len(of))
    for d in range(1, len(of)):
        at = at[at < len(of) - d]
        at = at[of[at] == of[at + d]]
        if not len(at):
            return
        a, b = owner[at], owner[at + d]
        apart = label[a] != label[b]
        if apart.any():
            a, b = np.divmod(np.unique(a[apart] * end + b[apart]), end)
            yield a, b


def is_cut(sets: Column, total: Column) -> Column:
    """Whether a block with so many sets and elements is cut into parts."""
    return (sets > PART_SETS) | (total > PART_ELEMENTS)


def whole_groups(batches, columns: int):
    """The same rows, those with equal values in the first columns together, and the columns' values. Equal rows lie together."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = np.stack([batch.column(c).to_numpy() for c in range(columns)])
        whole = int(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))[-1])  # the last group may go on
        rest = batch.slice(whole)
        if whole:
            yield batch.slice(0, whole), keys[:, :whole]
    if rest is not None:
        yield rest, keys[:, whole:]


def block_parts(sizes: DataFrame) -> DataFrame:
    """block, bucket, own, up, down: the parts of the buckets of blocks that are cut, and of the buckets next to them; as a table.

    sizes: block, bucket, sets, total (elements).
    """
    parts = lambda sets, total: F.greatest(F.ceil(sets / PART_SETS), F.ceil(total / PART_ELEMENTS)).cast("int")
    large = sizes.groupBy("block").agg(parts(F.sum("sets"), F.sum("total")).alias("n")).where("n > 1").select("block")
    cut = written(sizes.join(large, "block").select("block", "bucket", parts(F.col("sets"), F.col("total")).alias("own")), "parts")
    for name, step in (("up", 1), ("down", -1)):
        other = cut.select("block", (F.col("bucket") - step).alias("bucket"), F.col("own").alias(name))
        cut = cut.join(other, ["block", "bucket"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return cut


def rounds_of(sizes: DataFrame, parts: DataFrame) -> int:
    """In how many rounds the cells are looked through. sizes, parts: of block_parts."""
    copies = F.coalesce(F.col("own") + F.col("up") + F.col("down"), F.lit(1))
    sums = sizes.join(parts, ["block", "bucket"], "left").agg(F.sum("total").alias("elements"), F.sum(F.col("total") * copies).alias("copied")).first()
    return max(1, math.ceil((sums.copied or 0) / (ROUND * (sums.elements or 1))))


def in_cells(sets: DataFrame, parts: DataFrame, rounds: int = 1, now: int = 0) -> DataFrame:
    """block, x, y, i, j, side, id, elements, and what more sets have: each set in the cells where its part (x, i or y, j) of the block meets others.

    sets: block, id, elements, bucket and more. parts: of block_parts, as a table. A block that isn't cut has one cell, with i and j -1.
    Of all rounds, those of one.
    """
    own = sets.join(maybe_broadcast(parts), ["block", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("own", F.lit(1))).cast("int"))
    bucket, part, no = F.col("bucket"), F.col("part"), F.array().cast("array<int>")

    def upto(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(no)

    def cell(x, y, i, j, side):
        return F.struct(x.alias("x"), y.alias("y"), i.alias("i"), j.alias("j"), side.alias("side"))

    zero, whole = F.lit(0), F.lit(-1)
    cells = F.when(F.col("own").isNull(), F.array(cell(zero, zero, whole, whole, F.lit(False)))).otherwise(
        F.concat(
            F.transform(upto("own"), lambda j: cell(bucket, bucket, F.least(part, j), F.greatest(part, j), part > j)),
            F.transform(upto("up"), lambda j: cell(bucket, bucket + 1, part, j, F.lit(False))),
            F.transform(upto("down"), lambda j: cell(bucket - 1, bucket, j, part, F.lit(True))),
        )
    )
    if rounds > 1:
        cells = F.filter(cells, lambda c: F.pmod(F.xxhash64("block", c["x"], c["y"], c["i"], c["j"]), F.lit(rounds)) == now)
    return own.withColumn("cell", F.explode(cells)).select("block", "cell.*", *(c for c in sets.columns if c not in ("block", "bucket")))


def jaccard_links(sets: DataFrame, percent: int, spans: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """a, b: links between sets at least so similar, inside blocks, as stars: one id of a cell's component, and another.

    sets: block, id, elements (an array of whole numbers). An id occurs once in a block. spans: sets also have owner, a number,
    and repeated. Then there are lo and hi, too, where in b's elements, which come in an order, the first one and behind the last
    one is that a partner has; for b = a as well; and whole, whether the block has one cell. There a names b's component, and of
    the components that have several owners or a repeated set all sets are returned, repeated ones from end to end; of the others
    none. These links are found by span_links, from whole numbers as ids and sets that aren't empty.
    counts: block, sets, total (elements), where they are known and all sets are about as large, so that sets are read once only.
    """
    kind = sets.schema["id"].dataType
    id_type = pa.string() if kind.simpleString() == "string" else pa.int64()
    names = ["a", "b", "lo", "hi", "whole"] if spans else ["a", "b"]
    types = [id_type] * 2 + [pa.int32(), pa.int32(), pa.bool_()][: len(names) - 2]

    def stars(ids: list, elements: list[np.ndarray], across: np.ndarray | None) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while up.setdefault(i, i) != i:
                up[i] = i = up[up[i]]
            return i

        for a, b in divide_skip([np.unique(x) for x in elements], percent, across):
            x, y = root(a), root(b)
            up[max(x, y, key=ids.__getitem__)] = min(x, y, key=ids.__getitem__)
        rows = [(ids[root(i)], ids[i]) for i in up if root(i) != i]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def search(batches):
        key, ids, sides, elements = None, [], [], []
        small, waiting = [], 0

        def together():
            label, linked = small_links([(e, across) for _, e, across in small], percent)
            names_ = [x for mine, _, _ in small for x in mine]
            at = np.flatnonzero(linked & (label != np.arange(len(label))))
            columns = [[names_[i] for i in label[at]], [names_[i] for i in at]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def links():
            nonlocal small, waiting
            _, x, y, i, j = key
            across = np.array(sides) if (x, i) != (y, j) else None
            if len(ids) > SMALL:
                yield stars(ids, elements, across)
            elif len(ids) > 1:
                small.append((ids, elements, across))
                waiting += sum(map(len, elements)) * len(ids) // 2
            if waiting > TOGETHER:
                yield together()
                small, waiting = [], 0

        for batch in batches:
            *cells, side, id_ = (batch.column(c).to_pylist() for c in range(7))
            cells = list(zip(*cells, strict=True))
            values, at = batch.column(7).flatten().to_numpy(), 0
            for row, size in enumerate(batch.column(7).value_lengths().to_pylist()):
                if (now := cells[row]) != key:
                    if key is not None:
                        yield from links()
                    key, ids, sides, elements = now, [], [], []
                ids.append(id_[row])
                sides.append(side[row])
                elements.append(values[at : at + size])
                at += size
        if key is not None:
            yield from links()
        if small:
            yield together()

    def compare(batches):
        for batch, keys in whole_groups(gathered(batches, COMPARED), 5):
            yield compared(batch, keys)

    def compared(batch, keys):
        _, x, y, i, j = keys
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
        sides, repeated = (batch.column(c).to_numpy(zero_copy_only=False) for c in (5, 9))
        ids, owner = batch.column(6).to_numpy(), batch.column(8).to_numpy()
        sizes = batch.column(7).value_lengths().to_numpy().astype(np.int64)
        label, linked, lo, hi = span_links(batch.column(7).flatten().to_numpy(), sizes, np.cumsum(new), sides, (x != y) | (i != j), percent)
        least, most, often = owner.copy(), owner.copy(), repeated.copy()
        np.minimum.at(least, label, owner)
        np.maximum.at(most, label, owner)
        np.logical_or.at(often, label, repeated)
        whole = i < 0
        lo, hi = np.where(whole & repeated, 0, lo), np.where(whole & repeated, sizes, hi)
        at = np.flatnonzero(np.where(whole, (often | (least != most))[label], linked))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids[label[at]], ids[at], lo[at], hi[at], whole[at]), types, strict=True)], names)

    if counts is None:
        # Sizes of similar sets differ by less than a bucket; the sum keeps exact bounds on their side.
        bucket = F.floor((F.log(F.size("elements").cast("double")) + 1e-9) / math.log(100 / percent)).cast("int")
        sets = sets.withColumn("bucket", bucket)
        sizes = sets.groupBy("block", "bucket").agg(F.count("*").alias("sets"), F.sum(F.size("elements")).alias("total"))
    else:
        sets, sizes = sets.withColumn("bucket", F.lit(0)), counts.withColumn("bucket", F.lit(0))
    sizes = written(sizes, "sizes")
    # Where all sets of a block are in one bucket, small ones needn't be added up.
    parts = written(block_parts(sizes if counts is None else sizes.where(is_cut(F.col("sets"), F.col("total")))), "cuts")
    rounds = rounds_of(sizes, parts)
    release(sizes, collect=False)

    def found(now: int) -> DataFrame:
        cells = in_cells(sets, parts, rounds, now)
        dealt = cells.repartition("block", "x", "y", "i", "j").sortWithinPartitions("block", "x", "y", "i", "j")
        return map_arrow(dealt, compare if spans else search, f"a {kind.simpleString()}, b {kind.simpleString()}" + ", lo int, hi int, whole boolean" * spans)

    out = None
    for now in range(rounds):
        links = found(now)
        if rounds > 1:
            links = written(links, "round")
            sets.sparkSession._jvm.System.gc()  # the round's copies go from the disks
        out = links if out is None else out.unionByName(links)
    return out
