"""Every operator against a plain version of what it must give, on rows with nulls, empty and long texts, ties and copies."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest

from sylva.llm import bpe, classifier, common, fingerprints, line_dedup, mixing, ngram_join, quality_rules, set_joins, sharding, substring_dedup, token_counts
from sylva.llm.components import components
from sylva.llm.pretokens import Numbered, PreTokenizer
from sylva.llm.set_joins import divide_skip

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def test_words_are_those_of_the_pattern():
    text = "a\x0bb\x1cc d　e\x85f\r\n\tg"
    assert [w.decode() for w in text.encode().split()] == WORD.findall(text)


def test_op1_mixing(spark, docs, rows, empty):
    found = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert len(found) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    left, weights, target = dict(zip(order, [1, 2, 3] * len(order), strict=False)), None, {}
    budget = sum(sizes.values())
    while True:  # share, cap, share again
        weights = sum(left.values())
        over = [s for s in left if budget * left[s] / weights > 3 * sizes[s]]
        if not over:
            target |= {s: budget * w / weights for s, w in left.items()}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            budget -= 3 * sizes[s]
            del left[s]
        if not left:
            break
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        largest = max(len(WORD.findall(r[1] or "")) for r in rows if r[2] == s)
        assert abs(taken[s] - target[s]) <= largest
    assert sum(taken.values()) <= sum(sizes.values())
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in found)


@pytest.mark.parametrize("text", ["don't we'll  go\n\n now", " 　x y", "a\n b", "tail ", "٠١abc½", "", "  ", "\U0001f642\U0001f642 ‍", "a" * 600 + " b" + "!" * 400])
def test_bpe_is_the_library(text):
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    codec = bpe.codec(path, public.PATTERN)
    ids, ends = codec.encode([text, text])
    expected = library.encode_ordinary(text)
    assert ids.tolist() == expected * 2
    assert codec.decode(ids, ends) == [text.encode()] * 2


def test_workers_keep_a_codec_for_their_own_kernels_only():
    from sylva.functions import kernels

    c = bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    kernels.drop_kept(bpe.__name__)
    assert bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN) is c
    kernels.drop_kept(ngram_join.__name__)
    assert bpe.codec.cache_info().currsize == 0


def test_op2_and_op3_are_the_libraries(spark, docs, rows, empty):
    import tiktoken
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    expected = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe.round_trip(docs, path, public.PATTERN).collect()))) == sorted(map(str, expected))
    ids = bpe.encoded(docs, path, public.PATTERN, ("doc_id", "row"))
    back = {r.row: r.bytes.decode() for r in bpe.decoded(ids, path, public.PATTERN, ("row",)).collect()}
    assert back == {r[6]: r[1] or "" for r in rows}
    assert bpe.round_trip(empty, path, public.PATTERN).count() == 0

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    expected = sorted(str((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False)))) for r in rows)
    for head in (1 << 18, 20):
        assert sorted(str(tuple(r)) for r in token_counts.token_counts(docs, path, head).collect()) == expected
    assert token_counts.token_counts(empty, path).count() == 0


def test_pretokens_in_parts_are_those_of_the_whole():
    split = PreTokenizer(public.PATTERN)
    for text in ["a b c", " a", "a ", "a\nb c.\nd", "x y z", "it's we're", "", " ", "\n"]:
        assert split.split(text) == split.find(text)
        assert split.counts(text) == Counter(split.find(text))


@pytest.mark.parametrize("special", [(), ("<|x|>", "<y z>")])
def test_numbered_pretokens_are_those_of_the_whole(special):
    splitter = PreTokenizer(public.PATTERN, special)
    texts = ["a b c", " a", "a ", None, "a  b", "a\n b", "a \nb", "a\n\nb c.\n", "x\u3000 y", "x\u00a0y z", "it's we're 's", "", " ", "  ", "\n", "a <|x|> b<|x|>", "<y z> <y", "٠١abc½ \U0001f642"]
    numbered = Numbered(splitter)
    for some in (texts, texts[::-1], texts[4:5], [], ["a"]):
        found, ends = numbered.cut(pa.array(["skipped", *some], pa.string()).slice(1))
        names = list(numbered.pieces)
        assert [[names[i] for i in found[a:b]] for a, b in zip(ends[:-1], ends[1:])] == [splitter.whole(t or "") for t in some]


def test_a_part_is_split_once_for_all_texts():
    splitter, asked = PreTokenizer(public.PATTERN), []
    find = splitter.find
    splitter.find = lambda text: (asked.append(text), find(text))[1]
    numbered = Numbered(splitter)
    for _ in range(3):
        numbered.cut(pa.array(["one two-three two-three", "one two-three"] * 50))
    assert sorted(asked) == [" one", " two-three", "one"]


def test_a_codec_that_forgets_gives_the_same(docs, monkeypatch):
    path = public.path("byte_bpe_50k.tiktoken")
    whole = bpe.Codec(path, public.PATTERN)
    texts = [r.text or "" for r in docs.select("text").collect()]
    expected = [x.tolist() for x in whole.encode(texts)]
    monkeypatch.setattr(Numbered, "PARTS", 3)
    small = bpe.Codec(path, public.PATTERN)
    ids = [small.encode([t])[0].tolist() for t in texts]
    assert sum(ids, []) == expected[0] and np.cumsum([0, *map(len, ids)]).tolist() == expected[1]


def test_op2_cuts_runs_together(rows, monkeypatch):
    c = bpe.Codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    texts = [r[1] or "" for r in rows if len(r[1] or "") < 5000]
    expected = [c.encode([t])[0].tolist() for t in texts]
    monkeypatch.setattr(bpe, "ROWS", 1500)
    for most, cuts in ((10**6, 1), (4000, None)):
        monkeypatch.setattr(bpe, "CUT", most)
        c.forget()
        calls, parts_of = [], bpe.Numbered.parts_of
        monkeypatch.setattr(c.texts, "parts_of", lambda x, calls=calls: (calls.append(len(x)), parts_of(c.texts, x))[1])
        found = list(c.runs(pa.array(texts, pa.string())))
        assert len(found) > 5 and [i for a, b, _, _ in found for i in range(a, b)] == list(range(len(texts)))
        assert [ids[x:y].tolist() for _, _, ids, ends in found for x, y in zip(ends[:-1], ends[1:], strict=True)] == expected
        assert sum(calls) == len(texts) and (len(calls) == cuts if cuts else 1 < len(calls) < len(found))


def test_op3_splits_few_texts_at_once():
    batches = list(token_counts._slices([pa.RecordBatch.from_pydict({"text": ["a"] * 1100}), pa.RecordBatch.from_pydict({"text": ["b"]})]))
    assert [b.num_rows for b in batches] == [512, 512, 76, 1]


def shares(rows, n, other=None):
    """The rows, by doc_id and text, that have a run of n words which another such row has, too."""
    seen = defaultdict(set)
    for r in rows:
        w = (r[1] or "").split()
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add((r[0], r[1]))
    return {d for found in seen.values() if len(found) > 1 for d, _ in found}


def test_op4_finds_passages(spark, docs, rows, empty):
    found = substring_dedup.repeated_passages(docs).collect()
    assert shares(rows, 50) <= {r.doc_id for r in found}
    assert {r.doc_id for r in found} - {None} <= shares(rows, 25) - {None}
    assert any(r.removed for r in found)
    assert all(r.n_words >= 46 for r in found)
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_op4_spans_and_components(spark):
    """Passages of 50 to 120 words, in two to four documents each, against what was planted."""
    rng = np.random.default_rng(8)
    texts, planted = [], []
    for k in range(40):
        passage = words_of(rng, 52 + 2 * k)
        for _ in range(2 + k % 3):
            before = words_of(rng, int(rng.integers(0, 60)))
            planted.append((len(before), len(passage), k))
            texts.append([*before, *passage, *words_of(rng, int(rng.integers(0, 60)))])
    alone = [words_of(rng, 150) for _ in range(40)]
    short = words_of(rng, 49)  # under the limit
    alone += [[*words_of(rng, 30), *short, *words_of(rng, 30)] for _ in range(6)]
    order = rng.permutation(len(texts) + len(alone)).tolist()
    docs = spark.createDataFrame([(order[i], " ".join(x)) for i, x in enumerate([*texts, *alone])], "doc_id long, text string")
    found = {r.doc_id: r for r in substring_dedup.repeated_passages(docs).collect()}
    assert set(found) == {order[i] for i in range(len(texts))}
    by_passage = defaultdict(list)
    for i, (start, n, k) in enumerate(planted):
        r = found[order[i]]
        assert start <= r.start_word <= start + 8
        assert start + n - 8 <= r.start_word + r.n_words <= start + n
        by_passage[k].append(r)
    for group in by_passage.values():
        assert len({r.component_id for r in group}) == 1
        first = min(r.doc_id for r in group)
        assert [r.doc_id for r in group if not r.removed] == [first]
        assert {r.first_doc_id for r in group} == {first}
    assert len({r.component_id for r in found.values()}) == 40


def words_of(rng, n):
    return [f"{a}{b}" for a, b in rng.integers(0, 10**6, (n, 2))]


def test_op4_finds_passages_with_a_changed_word(spark):
    rng = np.random.default_rng(3)
    texts = []
    for i in range(60):
        passage = words_of(rng, 60)
        changed = [*passage[:30], "changed", *passage[31 - i % 2 :]]  # another word, or one more
        texts += [[*words_of(rng, 40), *x, *words_of(rng, 40)] for x in (passage, changed)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    found = substring_dedup.repeated_passages(docs).collect()
    assert len({r.doc_id for r in found if r.n_words >= 50}) >= 0.95 * len(texts)
    assert all(40 <= r.start_word and r.start_word + r.n_words <= 101 for r in found)
    assert {r.doc_id for r in found if r.removed} <= set(range(1, 120, 2))
    links = defaultdict(set)
    for r in found:
        links[r.component_id].add(r.doc_id // 2)
    assert all(len(x) == 1 for x in links.values())


def test_op4_links_variants_of_one_passage(spark):
    """Of three documents only the second is like both others: its passage has no changed word, theirs have one each."""
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(30):
        passage = words_of(rng, 75)
        for at in (25, None, 50):
            mine = [*passage]
            if at is not None:
                mine[at] = "changed"
            texts.append([*words_of(rng, 40), *mine, *words_of(rng, 40)])
    found = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")).collect()
    whole = defaultdict(set)
    for r in found:
        whole[r.component_id].add(r.doc_id)
    assert sum(len(x) == 3 for x in whole.values()) >= 28


def test_op4_joins_what_cells_have_linked_in_cut_blocks_only(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(4):
        passage = words_of(rng, 90)
        for at in range(5, 85, 10):
            texts.append([*words_of(rng, 30), *passage[:at], "changed", *passage[at + 1 :], *words_of(rng, 30)])
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    joined, components = [], substring_dedup.components
    monkeypatch.setattr(substring_dedup, "components", lambda edges: (joined.append(edges.count()), components(edges))[1])
    found = sorted(map(tuple, substring_dedup.repeated_passages(docs).collect()))
    assert len({r[0] for r in found}) >= 28
    assert joined[0] == 0
    monkeypatch.setattr(set_joins, "PART_SETS", 2)
    assert sorted(map(tuple, substring_dedup.repeated_passages(docs).collect())) == found
    assert joined[2] > 0


def test_op4_reads_texts_twice(spark, docs, monkeypatch):
    """Once for runs, once for paragraphs: what is compared comes from the shingles kept with them."""
    read, map_arrow = [], substring_dedup.map_arrow
    monkeypatch.setattr(substring_dedup, "map_arrow", lambda df, *more: (read.append("text" in df.columns), map_arrow(df, *more))[1])
    assert substring_dedup.repeated_passages(docs).count()
    assert sum(read) == 2


def test_op4_centers(spark, monkeypatch):
    """Classes, what collides, and the sizes of blocks, with centers on either side of a batch's end, against plain Python."""
    rng = np.random.default_rng(13)
    monkeypatch.setattr(substring_dedup, "GATHERED", 7)
    keys = rng.integers(-(1 << 62), 1 << 62, 30).tolist()
    classes = [(i, keys[int(rng.integers(0, 30))], [int(b) for b in rng.integers(0, 6, 3)]) for i in range(150)]
    rows = []
    for i, named, bands in classes:
        for k in range(int(rng.integers(1, 4))):
            rows.append((int(rng.integers(-9, 9)), bool(rng.random() < 0.1), [(i, k, 55, named, sum(b << (21 * j) for j, b in enumerate(bands)))]))
    kind = "text_hash long, copied boolean, x array<struct<class:long,start:int,n:int,named:long,bands:long>>"
    found = defaultdict(list)
    for r in substring_dedup.center_table(spark.createDataFrame(rows, kind).repartition(3)).collect():
        found[r["class"]].append(r)
    collides = {i for i, named, bands in classes if any(i != j and named == other and any(map(int.__eq__, bands, more)) for j, other, more in classes)}
    sets = Counter(named for i, named, _ in classes if i in collides)
    for i, named, _ in classes:
        mine = [(text, x[0][1], copied) for text, copied, x in rows if x[0][0] == i]
        repeated = len({text for text, _, _ in mine}) > 1 or any(copied for _, _, copied in mine)
        if not repeated and i not in collides:
            assert i not in found
            continue
        assert sorted((r.text_hash, r.start) for r in found[i]) == sorted(x[:2] for x in mine)
        assert {(r.named, r.repeated, r.sets) for r in found[i]} == {(named, repeated, sets[named] if i in collides else 0)}
        assert [(r.text_hash, r.start) for r in found[i] if r.first] == [min(x[:2] for x in mine)]
    assert {r.named: r["class"] in collides for x in found.values() for r in x if r.lead} == dict.fromkeys(sets, True)
    assert sum(r.lead for x in found.values() for r in x) == len(sets)


def test_op4_finds_passages_whose_pieces_came_before(spark):
    rng = np.random.default_rng(5)
    texts, later = [], []
    for _ in range(40):
        passage = words_of(rng, 60)
        texts += [[*words_of(rng, 30), *passage[k : k + 30], *words_of(rng, 30)] for k in (0, 15, 30)]
        later += [[*words_of(rng, 30), *passage, *words_of(rng, 30)] for _ in range(2)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate([*texts, *later])], "doc_id long, text string")
    found = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == set(range(len(texts), len(texts) + len(later)))
    assert {r.doc_id for r in found if r.removed} == set(range(len(texts) + 1, len(texts) + len(later), 2))


def test_centers_are_chosen_by_content():
    rng = np.random.default_rng(4)
    run = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    places = []
    for n in (0, 7, 100):
        before = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        at = substring_dedup.chosen(np.concatenate([before, run, before]), 9)
        assert (np.diff(at) <= 9).all()
        places.append([i - n for i in at.tolist() if 8 <= i - n < 52])
    assert places[0] == places[1] == places[2]
    assert substring_dedup.chosen(run[:5], 9).tolist() == [int(run[:5].argmin())]
    assert substring_dedup.chosen(run[:0], 9).tolist() == []


def test_op5_sharding(spark, docs, rows, empty):
    records = common.written(sharding.slotted(docs), "slotted")
    slots = common.written(sharding.slot_map(records), "map")
    found = sharding.placed(records, slots).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in found) == sorted(str((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))) for r in rows)
    places = defaultdict(list)
    for r in found:
        places[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    before = {r.virtual_slot: (r.shard, r.bytes) for r in slots.collect()}
    after = {r.virtual_slot: r.shard for r in sharding.grown(slots, sharding.SHARDS).collect()}
    assert set(after) == set(before) == set(range(sharding.SLOTS))
    assert all(s == before[v][0] or s == sharding.SHARDS for v, s in after.items())
    assert sharding.placed(sharding.slotted(empty), sharding.slot_map(sharding.slotted(empty))).count() == 0


def test_shards_are_near_equal(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', cast(id % 90 AS int)) AS text")
    records = sharding.slotted(docs)
    sums = [r[1] for r in sharding.placed(records, sharding.slot_map(records)).groupBy("shard").sum("size").collect()]
    assert len(sums) == 16
    assert max(sums) - min(sums) <= 0.02 * max(sums)


def brute_components(rows, n, percent):
    sets = {}
    for i, r in enumerate(rows):
        w = [x.encode().lower() for x in WORD.findall(r[1] or "")]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in sets:
        groups[root(i)].append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(str((rows[i][0], len(sets[i]), least[root(i)])) for i in sets)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_op6_ngram_join(spark, docs, rows, n, percent):
    found = ngram_join.with_component_ids(ngram_join.linked(docs, n, percent))
    assert sorted(str(tuple(r)) for r in found.select("doc_id", "n_shingles", "component_id").collect()) == brute_components(rows, n, percent)


def test_op6_empty_and_one_of_each(spark, docs, empty):
    assert ngram_join.with_component_ids(ngram_join.linked(empty)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    left = Counter(r.text for r in kept.collect() if r.text and r.text.split())
    assert max(left.values()) == 1


@pytest.mark.parametrize("percent", [80, 90])
def test_signatures_miss_no_similar_pair(percent):
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 10, 19, 40, 120, 400):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = int(rng.integers(0, n // 8 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            common = np.unique(rng.choice(np.concatenate([a, b]), int(rng.integers(0, n))))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= percent * (len(a) + len(b) - inter) and inter < max(len(a), len(b)):
                signer = ngram_join.Signer(percent, common)
                assert set(signer(a).tolist()) & set(signer(b).tolist())


def test_sketches_miss_no_similar_pair(monkeypatch):
    """Of keys with few members and with many: whatever is similar is in one chain, and sets of half the elements aren't."""
    rng, percent = np.random.default_rng(11), 80
    for few in (ngram_join.FEW, 2):
        monkeypatch.setattr(ngram_join, "FEW", few)
        sets, keys = [], []
        for k in range(12):
            start = rng.integers(0, 2**64, int(rng.integers(2, 700)), dtype=np.uint64)
            for _ in range(int(rng.integers(1, 40))):
                some = rng.random(len(start)) < rng.choice([0.5, 0.8, 0.9, 0.97])
                sets.append(np.unique(np.append(start[some], rng.integers(0, 2**64, int(rng.integers(1, 1 + len(start) // 4 + 1)), dtype=np.uint64))))
                keys.append(k)
        keys, sizes = np.array(keys), np.array([len(x) for x in sets])
        a, b = ngram_join.chained(keys, ngram_join.Sketches(sizes, pa.array([ngram_join.sketch(x) for x in sets], pa.binary()), percent))
        assert (keys[a] == keys[b]).all()
        label = set_joins._united(np.arange(len(sets)), a, b)
        similar = 0
        for i in range(len(sets)):
            for j in range(i):
                overlap = len(np.intersect1d(sets[i], sets[j]))
                if keys[i] == keys[j] and 100 * overlap >= percent * (sizes[i] + sizes[j] - overlap):
                    similar += 1
                    assert label[i] == label[j]
        assert similar > 50
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            overlap = len(np.intersect1d(sets[i], sets[j]))
            assert overlap > 0.5 * min(sizes[i], sizes[j]) or min(sizes[i], sizes[j]) < 20


def test_shared_passages_chain_no_block(spark):
    """Each text shares half its words with the next: they share signatures, but none is similar to another, so none is looked at."""
    rng = np.random.default_rng(12)
    parts = [" ".join(words_of(rng, 60)) for _ in range(61)]
    texts = [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]
    texts.append(texts[7] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ngram_join.signed(docs, 5, 80)
    keys = Counter(k for r in rows.collect() for k in r.signatures)
    assert sum(n > 1 for n in keys.values()) > 60
    assert ngram_join.blocks(rows, 80).count() == 2
    found = {r.doc_id: r.component_id for r in ngram_join.with_component_ids(ngram_join.linked(docs, 5, 80)).collect()}
    assert found == {i: 7 if i == 60 else i for i in range(61)}


@pytest.mark.parametrize("percent", [80, 90])
def test_divide_skip_is_exact(percent):
    rng = np.random.default_rng(percent)
    core = rng.choice(10_000, 60, replace=False).astype(np.uint64)
    sets = []
    for _ in range(120):
        keep = core[rng.random(60) > rng.choice([0.02, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(20_000, 10**9, int(rng.integers(0, 8)), dtype=np.uint64)])))

    def closure(links):
        up = list(range(len(sets)))
        for a, b in links:
            ra, rb = up[a], up[b]
            up = [min(ra, rb) if x in (ra, rb) else x for x in up]
        return up

    def similar(a, b):
        n = len(np.intersect1d(sets[a], sets[b]))
        return 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)

    every = [(a, b) for a in range(len(sets)) for b in range(a) if similar(a, b)]
    assert closure(divide_skip(sets, percent)) == closure(every)
    side = np.arange(len(sets)) % 2 == 0
    assert closure(divide_skip(sets, percent, side)) == closure([(a, b) for a, b in every if side[a] != side[b]])


def test_cut_blocks_give_the_same_links(spark, monkeypatch):
    """Blocks cut into buckets and parts against all pairs, with sizes at the very bounds of similarity."""
    from sylva.llm import set_joins

    rng = np.random.default_rng(11)
    monkeypatch.setattr(set_joins, "PART_SETS", 6)
    sets = []
    for core in range(4):
        for _ in range(25):
            n = int(rng.integers(4, 90))
            kept = np.arange(n)[rng.random(n) > rng.choice([0, 0.05, 0.2])]
            sets.append(sorted({int(x) + 1000 * core for x in kept} | {int(rng.integers(10**6, 10**9)) for _ in range(int(rng.integers(0, 3)))}))
    sets += [list(range(5000, 5000 + n)) for n in (4, 5, 16, 20, 64, 80, 100, 125)]  # each two are alike by 0.8
    table = spark.createDataFrame([(i % 2 * 0, i, x) for i, x in enumerate(sets) if x], "block long, id long, elements array<long>")
    links = set_joins.jaccard_links(table, 80).collect()
    up = list(range(len(sets)))

    def joined(pairs):
        up = list(range(len(sets)))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [min(x, y) if z in (x, y) else z for z in up]
        return up

    every = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))]
    assert joined([(r.a, r.b) for r in links]) == joined(every) != up


def test_rounds_bound_the_copies(spark, monkeypatch):
    """A block that is cut into many parts is copied into many cells, but not at once; the links are those of one round."""
    from sylva.llm import set_joins

    monkeypatch.setattr(set_joins, "PART_SETS", 4)
    rng = np.random.default_rng(3)
    rows = [(0, i, sorted({i % 20 * 1000 + int(x) for x in rng.choice(52, 50, replace=False)})) for i in range(120)]
    table = spark.createDataFrame(rows, "block long, id long, elements array<long>")
    held = []
    dealt = set_joins.in_cells

    def seen(*args):
        out = dealt(*args)
        held.append(out.count())
        return out

    monkeypatch.setattr(set_joins, "in_cells", seen)
    links, sums = {}, {}
    for bound in (1000, 1.5):
        monkeypatch.setattr(set_joins, "ROUND", bound)
        held.clear()
        links[bound] = sorted(map(tuple, set_joins.jaccard_links(table, 80).collect()))
        sums[bound] = list(held)
    assert len(sums[1000]) == 1 and len(sums[1.5]) > 5
    assert sum(sums[1.5]) == sums[1000][0] > 10 * len(rows)  # every cell once
    assert max(sums[1.5]) < 4 * len(rows)
    assert set(links[1.5]) == set(links[1000]) and links[1000]


@pytest.mark.parametrize("all_pairs", [4, 48])
def test_span_links_are_exact(monkeypatch, all_pairs):
    monkeypatch.setattr(set_joins, "ALL_PAIRS", all_pairs)
    rng = np.random.default_rng(all_pairs)
    sets, cells = [], []
    for cell in range(12):
        base = rng.integers(-(1 << 31), 1 << 31, 60).astype(np.int32)
        for _ in range(rng.integers(1, 30)):
            at = rng.integers(0, 8)
            one = base[at : at + rng.integers(46, 52)].copy()
            one[rng.integers(0, len(one), rng.integers(0, 8))] = rng.integers(-(1 << 31), 1 << 31)
            one[: rng.choice([0, 0, 15])] = one[0]  # an element may come again
            sets.append(one)
            cells.append(cell)
    cells, sides = np.array(cells), rng.random(len(cells)) < 0.5
    crossing = cells % 2 == 1
    label, linked, lo, hi = set_joins.span_links(np.concatenate(sets), np.array(list(map(len, sets))), cells, sides, crossing, 80)
    meets = lambda a, b: cells[a] == cells[b] and not (crossing[a] and sides[a] == sides[b])
    similar = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if meets(a, b) and similar(a, b)]
    least = list(range(len(sets)))
    for a, b in pairs:
        least = [min(least[a], least[b]) if x in (least[a], least[b]) else x for x in least]
    assert label.tolist() == least and linked.tolist() == [any(a in p for p in pairs) for a in range(len(sets))]
    for a in np.flatnonzero(linked):
        spans = [np.flatnonzero(np.isin(sets[a], sets[sum(p) - a])) for p in pairs if a in p]
        assert min(x[0] for x in spans) <= lo[a] <= max(x[0] for x in spans) and min(x[-1] for x in spans) < hi[a] <= max(x[-1] for x in spans) + 1


def test_a_set_is_verified_once_among_many_similar_ones(monkeypatch):
    rng = np.random.default_rng(3)
    passage, n, verified = rng.integers(0, 1 << 31, 46), 1500, []
    sets = np.hstack([np.tile(passage, (n, 1)), rng.integers(0, 1 << 31, (n, 5))]).astype(np.int32)
    verify = set_joins.Sets.similar
    monkeypatch.setattr(set_joins.Sets, "similar", lambda self, a, b: (verified.append(len(a)), verify(self, a, b))[1])
    label, linked, lo, hi = set_joins.span_links(sets.ravel(), np.full(n, 51), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool), 80)
    assert linked.all() and not label.any() and not lo.any() and (hi == 46).all()
    assert sum(verified) < 2 * n


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op7_learns(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        w = [words[k] for k in rng.integers(0, 6, 60)]
        text = " ".join(x.upper() + "!!" if bad else x for x in w)
        rows.append((i, text, "spam" if bad and i % 2 else f"s{i % 4}", "en", len(text)))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), (999, "", "s1", None, 0)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(0, 400, 2)] + [(2, 1), (None, 0), (4, None)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    found = classifier.scored(docs, model).collect()
    assert len(found) == 402
    right = [(r.score >= classifier.THRESHOLD) == (r.doc_id % 5 != 0) for r in found if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 400]
    assert np.mean(right) > 0.97
    left = classifier.kept(docs, model)
    assert left.schema == docs.schema
    assert left.count() == sum(r.score >= classifier.THRESHOLD for r in found)
    assert classifier.fit(docs, labels.where("quality = 1")) == 1.0
    assert classifier.fit(docs, labels.limit(0)) == 0.5
    assert classifier.scored(docs.limit(0), 0.5).count() == 0
    assert classifier.scored(docs.select("doc_id", "text"), model).count() == 402


def test_op7_gains_from_co_training_or_leaves_it(spark):
    """On labels kept apart, the rounds leave the order of scores as good as it is without them."""
    folder = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    learned = labels.where("doc_id % 2 = 0")

    def ordered(rounds):
        found = [r for r in classifier.scored(docs, classifier.fit(docs, learned, rounds=rounds)).collect() if r.doc_id in truth and r.doc_id % 2]
        good, bad = ([r.score for r in found if truth[r.doc_id] == k] for k in (1, 0))
        return np.mean([(np.array(good) > b).mean() + (np.array(good) == b).mean() / 2 for b in bad])

    without = ordered(0)
    assert without > 0.95
    assert ordered(2) >= without - 0.005


def test_op7_rounds_teach_what_labels_do_not(spark):
    """The metadata says what kind a document is, and the text too. With few labels no view is confident enough to teach."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        bad = i % 3 == 0
        words = rng.choice(["loss", "gain", "free", "click"] if bad else ["river", "stone", "cloud", "tree"], 30)
        rows.append((i, " ".join(words), "feed" if bad else "book", "en"))
    docs = spark.createDataFrame([*rows, (1700, None, None, None), (None, "river stone", "book", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(900)], "doc_id long, quality int")
    taught = {v: set() for v in classifier.VIEWS}
    seen = []

    def certain(models, most):
        seen.append(classifier.most_certain(docs.where("doc_id >= 900").select("text", "source", "lang", common.text_hash().alias("text_hash")), models, most, taught))
        return seen[-1]

    model = classifier.fit(docs, labels)
    assert all((r.score >= 0.5) == (r.doc_id % 3 != 0) for r in classifier.scored(docs, model).collect() if r.doc_id is not None and r.doc_id < 1500)
    batch = [r for r in docs.where("doc_id < 900").collect()]
    x = {"text": np.array([classifier.text_features(r.text, common.WordHashes()) for r in batch]), "meta": np.array([classifier.metadata_features(r.source, r.lang) for r in batch])}
    classifier.co_train(x, np.array([float(r.doc_id % 3 != 0) for r in batch]), certain, rounds=2, per_round=30)
    for lessons in seen:
        for features, kinds in lessons.values():
            assert len(features) == len(kinds) <= 30
    assert sum(len(k) for lessons in seen for _, k in lessons.values()) == sum(map(len, taught.values())) > 0


def test_op8_line_dedup(spark, docs, rows, empty):
    first, expected = {}, []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for _, start, n in line_dedup.chunks(r[1] or ""):
            text = "\n".join((r[1] or "").split("\n")[start : start + n])
            place = (r[0] is None, r[0] or 0, r[1])
            first.setdefault(text, (place, start))
    for r in rows:
        lines = (r[1] or "").split("\n")
        gone = set()
        for _, start, n in line_dedup.chunks(r[1] or ""):
            place = (r[0] is None, r[0] or 0, r[1])
            if first["\n".join(lines[start : start + n])] != (place, start):
                gone |= set(range(start, start + n))
        left = None if r[1] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        expected.append(str((r[6], left, 0 if r[1] is None else len(lines), len(gone))))
    found = line_dedup.dedup_lines(docs)
    assert found.columns[: len(docs.columns)] == docs.columns
    assert sorted(str((r.row, r.text, r.n_lines, r.n_removed_lines)) for r in found.collect()) == sorted(expected)
    assert sum(r.n_removed_lines for r in found.collect()) > 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_op8_survives_columns_of_its_names(spark):
    run = "one line\nanother line\na third"
    rows = [(1, f"x\n{run}", 7, "n"), (2, f"{run}\ny", 8, "m"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_removed_lines string")
    found = {r.doc_id: r for r in line_dedup.deduped(docs).collect()}
    assert (found[2].text, found[2].n_lines, found[2].n_removed_lines, found[2]._sylva_counts.n_removed_lines) == ("y", 8, "m", 3)
    assert (found[1].text, found[3].text) == (rows[0][1], None)
    counted = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (counted[2].n_lines, counted[2].n_removed_lines, counted[3].n_lines) == (4, 3, 0)


def test_boundaries_survive_a_shift():
    lines = [f"line number {i * 7919 % 1000}" for i in range(60)]
    a, b = ({h for h, _, _ in line_dedup.chunks("\n".join(x))} for x in (lines, ["new", *lines]))
    assert len(a & b) >= len(a) - 1


def test_op8_leaves_no_repeated_run_of_lines(spark):
    rng = np.random.default_rng(6)
    line = iter(f"line {i} of its own" for i in range(10**6))
    texts = [[next(line) for _ in range(int(rng.integers(1, 12)))] for _ in range(60)]
    for k in range(2, 8):
        for i in range(10):
            run = texts[6 * i][:k]
            at = int(rng.integers(0, len(texts[6 * i + 1]) + 1))
            texts.append([*texts[6 * i + 1][:at], *run[:1], *[""] * (i % 2), *run[1:], next(line)])
            texts.append([next(line), *run[:1], *[""] * (i % 2), *run[1:], next(line)])
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    seen = set()
    for i, lines in enumerate(texts):
        filled = [k for k, x in enumerate(lines) if x]
        pairs = [(a, b, "\n".join(lines[a : b + 1])) for a, b in zip(filled, filled[1:], strict=False)]
        gone = {k for a, b, p in pairs if p in seen for k in range(a, b + 1)}
        seen |= {p for _, _, p in pairs}
        assert not gone & {k for k, x in enumerate(lines) if x and x in found[i].text.split("\n")}
        assert {x for k, x in enumerate(lines) if x and k not in gone} <= set(found[i].text.split("\n"))
    assert sum(r.n_removed_lines for r in found.values()) > 200


def test_op9_quality_rules(spark, docs, rows, empty, monkeypatch):
    def measure(text):
        w = WORD.findall(text)
        count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)

    with_line = [(*r[:1], None if r[1] is None else f"{r[1]}\nthe same footer under every text here", *r[2:]) for r in rows]
    table = spark.createDataFrame(with_line, docs.schema)
    for broadcast in (True, False):
        monkeypatch.setattr(quality_rules, "fits_broadcast", lambda *_, b=broadcast: b)
        found = quality_rules.apply_rules(table, limit=5).collect()
        assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in found) == sorted(str((r[0], *measure(r[1] or ""))) for r in with_line)
        hosts = Counter(r[2] for r in with_line if r[1] is not None)
        for r in found:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed and 100 * r.lost_words <= 50 * r.n_words)
        assert sum(r.lost_words > 0 for r in found) >= sum(n for n in hosts.values() if n > 5)
        kept = [r.row for r in quality_rules.cleaned(table, limit=5).collect()]
        verdicts = Counter((r.doc_id, r.text_hash) for r in found if r.kept)
        assert len(kept) == sum(verdicts.values())
        left = {r.row: r.text for r in quality_rules.cleaned(table, limit=5).collect()}
        for r in with_line:
            if r[6] in left and hosts[r[2]] > 5:
                assert left[r[6]] == "\n".join(x for x in r[1].split("\n") if "footer" not in x)
    assert quality_rules.apply_rules(empty).count() == 0


def jaccard(a, b):
    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("range_bytes", [8 << 20, 5000])
def test_op10_fingerprints(spark, docs, rows, empty, monkeypatch, range_bytes):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", range_bytes)
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    found = defaultdict(list)
    for r in fingerprints.with_next(docs).collect():
        found[r.doc_id, r.edited_sha256, r.n_chars].append(r)
    assert sum(map(len, found.values())) == len(rows)
    errors = []
    for (i, text), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        changed = fingerprints.edited(text, following)
        r = found[i, hashlib.sha256(changed.encode()).hexdigest(), len(text)].pop()
        errors.append(abs(r.near_edited - jaccard(text, changed)))
        assert abs(r.near_next - jaccard(text, following)) < 0.2
        assert (r.fingerprint == r.edited_fingerprint) == (text.split() == changed.split()) or r.near_edited == 1
    assert np.mean(errors) < 0.03
    assert fingerprints.with_next(empty).count() == 0
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect() if r.doc_id is not None}
    assert plain[24] == plain[25] == plain[0]
    assert plain[24] != plain[1]
    printer = fingerprints.Fingerprinter()
    values = printer.values(b"some words that make a few shingles")
    assert (fingerprints.unpacked(printer.packed(values)) == values).all()
