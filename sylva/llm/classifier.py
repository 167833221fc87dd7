"""A quality classifier by co-training.

Two views of a document: its text (how often each byte, hashed word and hashed pair of words occurs, and how its words and
lines repeat) and its metadata (source and language, by hashed indicators; nothing that the text says, its length included).
A logistic model of each view is calibrated on labelled documents kept apart. Round by round each view scores all unlabelled
documents, and of those of which it is confident (CONFIDENT, calibrated) the most certain ones teach the other view. A view
that has learned from them is kept only if its loss on further labelled documents kept apart falls by LEAST_GAIN: a view that
knows little passes on nothing, and none gets worse. At the end the calibrated scores are weighed by a last logistic model; it
scores every document.

The models are fitted on at most LABELLED labelled documents, picked by a hash of doc_id, so by the same rule at any size.
The search for confident documents reads every unlabelled one: each task hands on its most certain PER_ROUND of each view and
kind, different texts only, and of these the most certain of all are taken.

Nulls: a null text counts as empty, null metadata as a value of its own; a null doc_id can't be labelled but is scored.
Of several labels of a document the mean counts. With labels of one kind only, all documents get that kind's score,
without labels 0.5 and all are kept. Very long texts are scored whole. Rows that are repeated are scored alike; of equal
texts one is learned from; ties in certainty go by the text's hash. Other columns, whatever their names, are carried along
by `kept` and ignored by `scored`. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, documents, map_arrow, maybe_broadcast, shingle_hashes, text_hash, word_hashes, written

#: Labelled documents that the models are fitted on, at most.
LABELLED = 6000
#: Rounds, and documents that a view learns from in each, of both kinds as the labels have them.
ROUNDS, PER_ROUND = 2, 100
#: By how much a round must lower a view's loss.
LEAST_GAIN = 0.005
#: A view is confident of a document from this calibrated chance on, for or against.
CONFIDENT = 0.95
HASHED, WORD_BINS = 64, 128
#: Documents that score less are rejected. Both kinds weigh the same in the models, good ones are far more: the doubtful stay.
THRESHOLD = 0.3
METADATA = ("source", "lang")
VIEWS = ("text", "meta")


def text_features(text: str, known: WordHashes) -> np.ndarray:
    """Shares of the 256 bytes, of hashed words and pairs of words, then measures of repetition and of words and lines."""
    raw = text.encode()
    out = np.zeros(TEXT_FEATURES, dtype=np.float32)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:256] = np.sqrt(counts / len(raw))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    n = max(1, len(words))
    h = word_hashes(words, known)
    for k in (1, 2):
        bins = (shingle_hashes(h, k) % np.uint64(WORD_BINS)).astype(np.int64)
        out[128 + 128 * k : 256 + 128 * k] = np.sqrt(np.bincount(bins, minlength=WORD_BINS) / n)
    out[512:] = (
        len(np.unique(h)) / n,
        len(np.unique(shingle_hashes(h, 3))) / n,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(n) / 10,
        len(raw) / n / 20,
        counts[65:91].sum() / len(raw),
        counts[48:58].sum() / len(raw),
        counts[[33, 35, 36, 37, 38, 42, 60, 62, 63, 64, 94, 124, 126]].sum() / n,
        max(map(len, words), default=0) / 100,
        int((h[1:] == h[:-1]).sum()) / n,
    )
    return out


TEXT_FEATURES = 256 + 2 * WORD_BINS + 10


def metadata_features(source: str | None, lang: str | None) -> np.ndarray:
    """Hashed indicators of source, language and both."""
    out = np.zeros(META_FEATURES, dtype=np.float32)
    for kind, value in (("source", source), ("lang", lang), ("both", None if source is None else f"{source} {lang}")):
        out[xxhash.xxh3_64_intdigest(f"{kind}={value}".encode()) % HASHED] += 1
    return out


META_FEATURES = HASHED


@dataclass
class Logistic:
    """A logistic model with standardised inputs."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
        """Newton's method; both kinds weigh the same, y may be soft labels."""
        x = x.astype(np.float64)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        weigh = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = sigmoid(z @ w)
            gradient = z.T @ (weigh * (p - y)) + penalty * w
            curve = (z * (weigh * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, gradient)
            w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        return cls(w[:-1], float(w[-1]), mean, scale)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The calibrated scores of the text view, the metadata view and both."""
        a = self.text_scale.logits(self.text.logits(text)[:, None])
        b = self.meta_scale.logits(self.meta.logits(meta)[:, None])
        return sigmoid(a), sigmoid(b), sigmoid(self.both.logits(np.stack([a, b], axis=1)))


def _parts(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which documents the views learn from, judge a round by and are calibrated on: half and two quarters of each kind.

    Of a kind with few documents all serve for all three.
    """
    out = np.zeros((3, len(y)), dtype=bool)
    for kind in (0, 1):
        at = np.flatnonzero(y == kind)
        if len(at) < 8:
            out[:, at] = True
        else:
            for part, of in ((0, at[0::4]), (0, at[2::4]), (1, at[1::4]), (2, at[3::4])):
                out[part, of] = True
    return out[0], out[1], out[2]


def _loss(model: Logistic, x: np.ndarray, y: np.ndarray) -> float:
    """The log loss, both kinds weighing the same."""
    p = sigmoid(model.logits(x))
    each = -np.log(np.where(y > 0.5, p, 1 - p))
    return float(np.mean([each[y == kind].mean() for kind in (0, 1)]))


def co_train(x: dict[str, np.ndarray], y: np.ndarray, certain, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> CoTrained:
    """x: the features of labelled documents by view.

    certain(models, most) gives for each view, of the unlabelled documents of which its calibrated model is confident, the
    most certain good and bad ones, `most` of each kind: the features that the other view has of them, and their labels.
    """
    learn, judge, held = _parts(y)
    target = y.astype(np.float64)
    got = {v: ([x[v][learn]], [target[learn]]) for v in VIEWS}

    def calibrated(v: str) -> tuple[Logistic, Logistic]:
        model = Logistic.fit(np.vstack(got[v][0]), np.concatenate(got[v][1]))
        return model, Logistic.fit(model.logits(x[v][held])[:, None], target[held])

    models = {v: calibrated(v) for v in VIEWS}
    most = {0: max(1, round(per_round * (1 - y.mean()))), 1: max(1, round(per_round * y.mean()))}
    for _ in range(rounds):
        lessons = certain(models, most)
        if not any(len(labels) for _, labels in lessons.values()):
            break
        for v in VIEWS:
            features, labels = lessons[VIEWS[1 - VIEWS.index(v)]]
            if not len(labels):
                continue
            before, got[v] = got[v], ([*got[v][0], features], [*got[v][1], labels])
            now = calibrated(v)
            if _loss(now[0], x[v][judge], y[judge]) < _loss(models[v][0], x[v][judge], y[judge]) - LEAST_GAIN:
                models[v] = now
            else:
                got[v] = before
    (a, sa), (b, sb) = (models[v] for v in VIEWS)
    both = [scale.logits(model.logits(x[v][held])[:, None])[:, None] for v, (model, scale) in models.items()]
    return CoTrained(a, b, sa, sb, Logistic.fit(np.hstack(both), target[held]))


def _view_columns(docs: DataFrame, prefix: str = "") -> list[Column]:
    have = {c.lower() for c in docs.columns}
    columns = {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text")} | {c: (F.col(c) if c in have else F.lit(None)).cast("string") for c in METADATA}
    return [v.alias(f"{prefix}{k}") for k, v in columns.items()]


def _views(docs: DataFrame) -> DataFrame:
    """doc_id, text and the metadata; columns that docs doesn't have are null."""
    return docs.select(*_view_columns(docs))


def _features(batch: pa.RecordBatch, known: WordHashes) -> dict[str, np.ndarray]:
    n = batch.num_rows
    text, meta = np.zeros((n, TEXT_FEATURES), np.float32), np.zeros((n, META_FEATURES), np.float32)
    for i, (t, *m) in enumerate(zip(batch.column("text"), *(batch.column(c).to_pylist() for c in METADATA), strict=True)):
        text[i] = text_features(t.as_py() or "", known)
        meta[i] = metadata_features(*m)
    return {"text": text, "meta": meta}


def most_certain(rows: DataFrame, models: dict[str, tuple[Logistic, Logistic]], most: dict[int, int], taught: dict[str, set[int]], confident: float = CONFIDENT) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each view, what the other one has of the documents that it is most certain of, and their labels. Reads all rows.

    taught: the texts' hashes that a view has passed on before; they are passed over, and those found now added.
    """
    shared = rows.sparkSession.sparkContext.broadcast((models, taught))
    least = math.log(confident / (1 - confident))
    names = ["view", "kind", "certainty", "text_hash", "x"]

    def kernel(batches):
        known, best = WordHashes(), {(v, kind): {} for v in VIEWS for kind in (0, 1)}  # text hash: certainty, features of the other view
        now, before = shared.value
        for batch in batches:
            features = _features(batch, known)
            hashes = batch.column("text_hash").to_pylist()
            for v, (model, scale) in now.items():
                other = features[VIEWS[1 - VIEWS.index(v)]]
                logits = scale.logits(model.logits(features[v])[:, None])
                for kind, certainty in ((0, -logits), (1, logits)):
                    mine = best[v, kind]
                    for i in np.flatnonzero(certainty >= least).tolist():
                        if hashes[i] not in before[v]:
                            mine[hashes[i]] = (float(certainty[i]), other[i].tobytes())
                    if len(mine) > 4 * most[kind]:
                        best[v, kind] = dict(sorted(mine.items(), key=lambda x: (-x[1][0], x[0]))[: most[kind]])
        out = [(v, kind, *row) for (v, kind), mine in best.items() for row in sorted(((c, h, x) for h, (c, x) in mine.items()), key=lambda r: (-r[0], r[1]))[: most[kind]]]
        types = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names)

    found = written(map_arrow(rows, kernel, "view string, kind int, certainty double, text_hash long, x binary"), "certain")
    lessons = {}
    for v in VIEWS:
        features, labels = [], []
        for kind, n in most.items():
            mine = found.where((F.col("view") == v) & (F.col("kind") == kind)).dropDuplicates(["text_hash"])
            for row in mine.orderBy(F.desc("certainty"), "text_hash").limit(n).collect():
                features.append(np.frombuffer(row.x, np.float32))
                labels.append(float(kind))
                taught[v].add(row.text_hash)
        lessons[v] = (np.array(features), np.array(labels))
    return lessons


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, **how) -> CoTrained | float:
    """The models, or a constant where the labels don't tell two kinds apart."""
    rows = _views(docs)
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(label).alias("y"))
    present = rows.select("doc_id").where(F.col("doc_id").isNotNull())
    known = present.join(marks, "doc_id").distinct().orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id").limit(labelled)
    picked = docs.sparkSession.createDataFrame(known.collect(), "doc_id long, y double")

    def kernel(batches):
        words = WordHashes()
        for batch in batches:
            x = np.hstack(list(_features(batch, words).values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "y", "x"])

    found = map_arrow(rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", *METADATA, "y"), kernel, "doc_id long, y double, x binary")
    found = found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()
    y = np.array([float(r.y >= 0.5) for r in found])
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    x = np.array([np.frombuffer(r.x, np.float32) for r in found])
    unlabelled = rows.join(maybe_broadcast(marks.select("doc_id")), "doc_id", "left_anti").select("text", *METADATA, text_hash().alias("text_hash"))
    taught: dict[str, set[int]] = {v: set() for v in VIEWS}
    return co_train({"text": x[:, :TEXT_FEATURES], "meta": x[:, TEXT_FEATURES:]}, y, lambda models, most: most_certain(unlabelled, models, most, taught), **how)


def scored(docs: DataFrame, model: CoTrained | float) -> DataFrame:
    """doc_id, text_score, meta_score, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches):
        words = WordHashes()
        for batch in batches:
            if isinstance(shared.value, float):
                scores = [np.full(batch.num_rows, shared.value)] * 3
            else:
                scores = shared.value.scores(**_features(batch, words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s, pa.float64()) for s in scores)], ["doc_id", "text_score", "meta_score", "score"])

    return map_arrow(_views(docs), kernel, "doc_id long, text_score double, meta_score double, score double")


def kept(docs: DataFrame, model: CoTrained | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that reach the threshold, all columns as they are."""
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches):
        words = WordHashes()
        for batch in batches:
            own = batch.select(range(len(columns)))
            view = pa.RecordBatch.from_arrays(batch.columns[len(columns) :], ["doc_id", "text", *METADATA])
            score = np.full(batch.num_rows, shared.value) if isinstance(shared.value, float) else shared.value.scores(**_features(view, words))[2]
            yield own.filter(pa.array(score >= threshold))

    return map_arrow(docs.select("*", *_view_columns(docs, "_sylva_")), kernel, docs.schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).withColumn("kept", F.col("score") >= THRESHOLD)
