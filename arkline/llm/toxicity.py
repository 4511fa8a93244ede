"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of the hashed embeddings of the word and of its beginnings of
PREFIXES bytes, so inflections of a known word are near it. Filters of several widths run
over the whole text; each keeps its largest response, and a logistic unit scores these.
Training (Adam on the log loss) and scoring share one forward pass over many texts.

The driver fits the model on a sample of labelled rows: of each class the ids that come first
by a hash, with all their rows and whole texts, up to MAX_ROWS rows and MAX_BYTES bytes (an id
beyond that is passed over). The model has a fixed size (BUCKETS x WIDTH numbers and
the filters) and is broadcast. Scores calibrate on a part of these rows that training
doesn't see; thresholds are then calibrated by language on the same part. Scoring is a pass
over the rows without a shuffle. Inputs of a score are the words alone.

Defined results: a null or wordless text has no responses and scores as the bias says;
labels that are null, or without a document, are left out; a repeated label counts once, all
rows of its document do, and an id with both labels has both; an empty table has no rows and
leaves no labels; invalid UTF-8 counts as word bytes; with one class or none among the labels every score is that class's rate (0 without
labels). Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import _BYTE_VALUES, ALNUM, chunks, give_back, mix, scan_words, utf8_column

BUCKETS = 1 << 16
WIDTH = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (3, 4, 5)
MAX_ROWS = 3000
MAX_BYTES = 32 << 20
PREDICT_AT = 0.7
_U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x (1 + PREFIXES) bucket numbers of 16 bits, first word of each text)."""
    words = scan_words(data, offsets, ALNUM)
    mapped = ALNUM[data]
    size = words.ends - words.starts
    out = np.empty((len(size), 1 + len(PREFIXES)), np.uint16)
    out[:, 0] = (words.hashes % _U(BUCKETS)).astype(np.uint16)
    state = np.zeros(len(size), np.uint64)
    for k in range(max(PREFIXES)):
        inside = size > k
        at = np.minimum(words.starts + k, max(len(data) - 1, 0))
        state = np.where(inside, mix(state * _U(0x9E3779B97F4A7C15) + _BYTE_VALUES[mapped[at]]), state) if len(at) else state
        if k + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(k + 1)] = (mix(state + _U(k + 1)) % _U(BUCKETS)).astype(np.uint16)
    return out, words.first


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(draw(BUCKETS, WIDTH) / 10, [draw(w * WIDTH, FILTERS) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), draw(len(WIDTHS) * FILTERS), 0.0)

    def forward(self, buckets: np.ndarray, first: np.ndarray):
        """(responses of each text, where they came from, word vectors)."""
        n, docs = len(buckets), len(first) - 1
        vectors = self.embedding[buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            vectors = vectors + self.embedding[buckets[:, k]]
        pooled = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        source = np.full(pooled.shape, -1, np.int64)
        for i, w in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            span = first[1:] - first[:-1] - w + 1  # places the filter has in each text
            has = np.flatnonzero(span > 0)
            if not len(has):
                continue
            reply = vectors[: n - w + 1] @ self.filters[i][:WIDTH]
            for j in range(1, w):
                reply += vectors[j : n - w + 1 + j] @ self.filters[i][j * WIDTH : (j + 1) * WIDTH]
            if w > 1:  # places that reach into the next text
                valid = np.zeros(n - w + 1, bool)
                marks = np.zeros(n + 1, np.int64)
                np.add.at(marks, first[has], 1)
                np.add.at(marks, first[has] + span[has], -1)
                valid = np.cumsum(marks)[: n - w + 1] > 0
                reply[~valid] = -np.inf
            most = np.maximum.reduceat(reply, first[has], axis=0)
            self._trace(reply, first, has, span, most, source, cols, pooled)
        return pooled, source, vectors

    def _trace(self, reply, first, has, span, most, source, cols, pooled):
        value = most + self.bias[cols]
        pooled[has, cols] = np.maximum(value, 0)
        if self.training:
            for r, d in enumerate(has):
                part = reply[first[d] : first[d] + span[d]]
                at = part.argmax(0) + first[d]
                source[d, cols] = np.where(value[r] > 0, at, -1)

    training = False

    def raw(self, buckets, first) -> np.ndarray:
        return self.forward(buckets, first)[0] @ self.out + self.out_bias

    def score(self, buckets, first) -> np.ndarray:
        return _sigmoid(self.raw(buckets, first).astype(np.float64) * self.scale + self.shift)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class _Adam:
    def __init__(self, shape, rate):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, value, grad, rows=None):
        """rows: only these rows of value have a gradient."""
        self.t += 1
        pick = slice(None) if rows is None else rows
        self.m[pick] = 0.9 * self.m[pick] + 0.1 * grad
        self.v[pick] = 0.99 * self.v[pick] + 0.01 * grad * grad
        value[pick] -= self.rate * (self.m[pick] / (1 - 0.9**self.t)) / (np.sqrt(self.v[pick] / (1 - 0.99**self.t)) + 1e-8)


def train(texts: list[tuple[np.ndarray, int]], steps_least: int = 900, epochs_least: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """texts: (bucket numbers of the words, label). Few texts are gone over more often."""
    model = Model.new(seed)
    epochs = min(60, max(epochs_least, steps_least * batch // max(1, len(texts))))
    model.training = True
    rng = np.random.default_rng(seed)
    steps = {"e": _Adam(model.embedding.shape, rate), "b": _Adam(model.bias.shape, rate), "o": _Adam(model.out.shape, rate)} | {i: _Adam(f.shape, rate) for i, f in enumerate(model.filters)}
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), batch):
            some = [texts[k] for k in order[begin : begin + batch]]
            first = np.concatenate([[0], np.cumsum([len(t) for t, _ in some])])
            buckets = np.concatenate([t for t, _ in some])
            label = np.array([y for _, y in some], np.float32)
            pooled, source, vectors = model.forward(buckets, first)
            off = ((_sigmoid(pooled @ model.out + model.out_bias) - label) / len(some)).astype(np.float32)
            back = np.outer(off, model.out) * (source >= 0)
            grads, places = [], []
            steps["o"].step(model.out, pooled.T @ off + 1e-4 * model.out)
            model.out_bias -= float(rate * off.sum())
            steps["b"].step(model.bias, back.sum(0))
            for i, w in enumerate(WIDTHS):
                d, f = np.nonzero(source[:, i * FILTERS : (i + 1) * FILTERS] >= 0)
                at, g = source[d, i * FILTERS + f], back[d, i * FILTERS + f]
                grad = np.zeros_like(model.filters[i])
                which = (f[:, None] == np.arange(FILTERS)).astype(np.float32)
                for j in range(w):
                    part = slice(j * WIDTH, (j + 1) * WIDTH)
                    grad[part] = (g[:, None] * vectors[at + j]).T @ which
                    grads.append(g[:, None] * model.filters[i][part].T[f])
                    places.append(at + j)
                steps[i].step(model.filters[i], grad + 1e-4 * model.filters[i])
            if not sum(map(len, places)):
                continue
            # a word's gradient goes to all of its buckets: sums over runs of equal ones
            held = buckets[np.concatenate(places)]
            by_bucket = np.argsort(held, axis=None, kind="stable")
            sums = np.concatenate(grads)[by_bucket // held.shape[1]]
            touched, begin_at = np.unique(held.ravel()[by_bucket], return_index=True)
            steps["e"].step(model.embedding, np.add.reduceat(sums, begin_at, axis=0), touched)
    model.training = False
    return model


def calibrate(model: Model, texts: list[tuple[np.ndarray, int, str | None]], weights: tuple[float, float]) -> None:
    """Fits scale and shift of the logit (Platt), then by language the threshold of the best F1
    on these rows, within 0.3 to 0.9; the default threshold stands where a language has few."""
    raw = np.array([model.raw(t, np.array([0, len(t)]))[0] for t, _, _ in texts], np.float64)
    label = np.array([y for _, y, _ in texts], np.float64)
    weight = np.where(label > 0, weights[1], weights[0])
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method, with a prior that keeps the scale finite
        p = _sigmoid(a * raw + b)
        g = np.array([(weight * (p - label) * raw).sum() + 0.5 * (a - 1), (weight * (p - label)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * raw * raw).sum() + 0.5, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    model.scale, model.shift = float(max(a, 0.05)), float(b)
    score = _sigmoid(raw * model.scale + model.shift)
    for lang in {k for _, _, k in texts}:
        own = np.array([k == lang for _, _, k in texts])
        if label[own].sum() < 10 or (1 - label[own]).sum() < 10:
            continue

        def f1(t, own=own):
            hit = score[own] >= t
            good = (weight[own] * hit * label[own]).sum()
            return 2 * good / max((weight[own] * hit).sum() + (weight[own] * label[own]).sum(), 1e-9)

        model.thresholds[lang] = max((round(t, 2) for t in np.arange(0.3, 0.91, 0.05)), key=lambda t: (round(f1(t), 3), -abs(t - PREDICT_AT)))


def sample_labels(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, kept: Callable = bytes) -> tuple[list, tuple[float, float]]:
    """At most max_rows labelled rows and max_bytes of each class as (text, label, language), and
    how many labels each sampled row stands for. labels: doc_id and toxic; kept: what is held of a
    text's bytes, an array. The rows come in one job, not one for each partition."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").alias("_ark_id"), F.col("toxic").cast("int").alias("_ark_toxic")).distinct()
    totals = {r[0]: r[1] for r in known.groupBy("_ark_toxic").count().collect()}
    sizes = docs.select(F.col("doc_id").alias("_ark_doc"), F.octet_length(F.col("text").cast("binary")).alias("_n")).groupBy("_ark_doc").agg(F.count("*").alias("rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("bytes"))
    sized = known.join(sizes, F.col("_ark_doc") == F.col("_ark_id")).where((F.col("rows") <= max_rows) & (F.col("bytes") <= max_bytes))
    first = [sized.where(F.col("_ark_toxic") == k).withColumn("_h", F.xxhash64(F.col("_ark_id").cast("string"))).orderBy("_h", "_ark_id").limit(max_rows) for k in (0, 1)]
    upto = Window.partitionBy("_ark_toxic").orderBy("_h", "_ark_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over max_rows rows of each class
    both = first[0].unionByName(first[1]).select("_ark_id", "_ark_toxic", F.sum("rows").over(upto).alias("r"), F.sum("bytes").over(upto).alias("b"))
    both = both.where((F.col("r") <= max_rows) & (F.col("b") <= max_bytes)).select("_ark_id", "_ark_toxic")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select(F.col("doc_id").alias("_ark_doc"), F.col("text").cast("binary").alias("text"), lang.alias("lang"))
    rows = text.join(F.broadcast(both), F.col("_ark_doc") == F.col("_ark_id")).orderBy("_ark_id", "_ark_toxic", "text", "lang").select("text", "_ark_toxic", "lang")
    batches, got = rows.toArrow().to_batches()[::-1], []
    while batches:  # a batch goes when its texts are read
        batch = batches.pop()
        data, offsets = utf8_column(batch.column(0))
        got += [(kept(data[i:j]), y, k) for i, j, y, k in zip(offsets[:-1], offsets[1:], batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
    share = [max(1.0, totals.get(k, 0) / max(1, sum(y == k for _, y, _ in got))) for k in (0, 1)]
    return got, (share[0], share[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Of the sampled texts the driver holds the bucket numbers only, and returns their memory when the model is made."""
    try:
        return _fitted(*sample_labels(docs, labels, max_rows, kept=lambda text: features(text, np.array([0, len(text)]))[0]))
    finally:
        give_back()


def _fitted(ready: list, weights: tuple[float, float]) -> Model:
    if len({y for _, y, _ in ready}) < 2:
        model = Model.new()
        model.out[:] = 0
        model.shift = 60.0 if ready and ready[0][1] else -60.0
        return model
    held = [r for i, r in enumerate(ready) if i % 4 == 3]
    model = train([(t, y) for i, (t, y, _) in enumerate(ready) if i % 4 != 3])
    calibrate(model, held, weights)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and threshold, the calibrated one of the row's lang."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "threshold")]
    source = docs.select(*[docs[c] for c in kept], docs[text_col].cast("binary").alias("_ark_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = utf8_column(batch.column(batch.num_columns - 1))
            out = [np.zeros(0)]
            for i, j in chunks(offsets, 1 << 20):
                buckets, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out.append(model.score(buckets, first))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out), pa.float64())], names=schema.names)

    scored = source.mapInArrow(run, schema)
    if not model.thresholds or "lang" not in kept:
        return scored.withColumn("threshold", F.lit(PREDICT_AT))
    by_lang = F.create_map(*[F.lit(x) for k, v in sorted(model.thresholds.items(), key=str) if k is not None for x in (k, float(v))])
    return scored.withColumn("threshold", F.coalesce(F.try_element_at(by_lang, F.col("lang").cast("string")), F.lit(model.thresholds.get(None, PREDICT_AT))))


def held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def op10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    out = scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "threshold")
    return out
