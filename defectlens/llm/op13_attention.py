"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` consecutive words; only
the bag has a label.  Every passage of the whole text is described by the
shares of neighbouring byte classes and by word figures (length, repeats), and
encoded by a learned layer.  Gated attention, learned from the document labels
alone, weighs the passages (a = softmax of w . (tanh(V h) * sigmoid(U h)));
the weighted passage representation is scored by a logistic layer.  One bad
passage can so decide about a long document.

The model is fitted with numpy on a bounded sample of labelled documents: at
most ``SAMPLE_DOCS``, those with the least digests of their ids, and at most
``SAMPLE_PASSAGES`` evenly spread passages of each (fit only).  Scoring covers
every passage of every document, in one pass without a shuffle, each document
in its task; the model is some thousand numbers.

Labels are means over repeated rows of a doc_id; null labels and ids are left
out.  Without both classes there is no model and every score is the smoothed
share of label 1 (0.5 without labels).  A text without words (null: empty) is
one passage without words.  Repeated rows get equal scores; an empty table
gives no rows.  Further input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlens.llm.common import byte_words, doc_slices, in_arrow, prefix_hash, span_hash, staged, text_buffers, text_or_empty

PASSAGE_WORDS = 64

#: Bounds of the fitted sample: labelled documents, and passages of each.
SAMPLE_DOCS = 4000
SAMPLE_PASSAGES = 64

#: Texts beyond this many bytes are taken apart at white space while words are looked for.
PIECE_BYTES = 1 << 20

#: Score from which a document counts as label 1 (contract).
THRESHOLD = 0.7

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _byte_classes() -> np.ndarray:
    """Class of every byte: small, capital, digit, blank, line end, stop, mark, other ASCII sign, beyond ASCII, control."""
    c = np.full(256, 9, np.uint8)
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    c[[32, 9]], c[[10, 13]] = 3, 4
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    c[signs] = 7
    c[[ord(x) for x in ".,;:'\"-()"]] = 5
    c[[ord(x) for x in "!?"]] = 6
    c[128:] = 8
    return c


CLASSES = _byte_classes()
N_CLASSES = 10
N_FEATURES = N_CLASSES * N_CLASSES + 8


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and fingerprint of the words of one text, piece by piece."""
    starts, ends, marks, a = [], [], [], 0
    while a < len(data):
        b = a + PIECE_BYTES
        while b < len(data) and not _SPACE[data[b]]:  # a piece ends before a white space
            gap = np.flatnonzero(_SPACE[data[b:b + PIECE_BYTES]])
            b += int(gap[0]) if len(gap) else PIECE_BYTES
        piece = data[a:b]
        s, e, _ = byte_words(piece, np.array([0, len(piece)]), ~_SPACE)
        starts.append(s + a)
        ends.append(e + a)
        marks.append(span_hash(prefix_hash(piece), s, e))
        a = b
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(starts, np.int64), join(ends, np.int64), join(marks, np.uint64)


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def passage_features(data: np.ndarray, keep: int | None = None) -> np.ndarray:
    """Features of the passages of one text (bytes): one row a passage, at least one row.

    ``keep`` bounds the rows to evenly spread passages (fitting only).
    """
    start, end, mark = _words(data)
    if not len(start):
        return np.zeros((1, N_FEATURES), np.float32)
    head = np.arange(0, len(start), PASSAGE_WORDS)
    cut = np.append(start[head], len(data))
    cut[0] = 0
    length = (end - start).astype(np.float64)
    again = np.zeros(len(start))
    again[1:] = mark[1:] == mark[:-1]
    twice = np.zeros(len(start))
    if len(mark) > 2:  # windows of three words that occur elsewhere in the text
        twice[:-2] = _repeated(mark[:-2] * np.uint64(3) + mark[1:-1] * np.uint64(5) + mark[2:] * np.uint64(7))
    order = np.lexsort((mark, np.arange(len(mark)) // PASSAGE_WORDS))
    block, sorted_mark = order // PASSAGE_WORDS, mark[order]
    fresh = np.ones(len(mark))
    fresh[1:] = (block[1:] != block[:-1]) | (sorted_mark[1:] != sorted_mark[:-1])  # first of its kind in the passage
    n = np.diff(np.append(head, len(start))).astype(np.float64)
    mean = np.add.reduceat(length, head) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(length * length, head) / n - mean * mean, 0))
    chosen = np.arange(len(head))
    if keep is not None and len(chosen) > keep:
        chosen = np.unique(np.linspace(0, len(chosen) - 1, keep).astype(np.int64))
    out = np.zeros((len(chosen), N_FEATURES), np.float32)
    step = max(1, PIECE_BYTES // (PASSAGE_WORDS * 8))
    for lo in range(0, len(chosen), step):  # a bounded number of passages together
        part = chosen[lo:lo + step]
        a, z = int(cut[part[0]]), int(cut[part[-1] + 1])
        for x in range(a, z, PIECE_BYTES):  # and of bytes, where one word is long
            classes = CLASSES[data[x:min(x + PIECE_BYTES, z) + 1]].astype(np.int64)
            if len(classes) < 2:
                continue
            row = np.searchsorted(cut[part], np.arange(x, x + len(classes) - 1), "right") - 1
            pairs = np.bincount(row * N_CLASSES ** 2 + classes[:-1] * N_CLASSES + classes[1:], minlength=len(part) * N_CLASSES ** 2)
            out[lo:lo + len(part), :N_CLASSES ** 2] += pairs.reshape(len(part), -1)
    size = np.maximum(cut[chosen + 1] - cut[chosen], 1)[:, None]
    out[:, :N_CLASSES ** 2] = np.sqrt(out[:, :N_CLASSES ** 2] / size)
    out[:, N_CLASSES ** 2:] = np.stack([
        np.log1p(mean), np.log1p(spread), np.add.reduceat(fresh, head) / n, np.add.reduceat(again, head) / n,
        np.add.reduceat(twice, head) / n, n / PASSAGE_WORDS, np.log1p(np.maximum.reduceat(length, head)),
        np.full(len(head), np.log1p(len(head)) / 10)], 1)[chosen]
    return out


def batch_features(column: pa.Array, keep: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Passage rows of a column of texts, and the first row of each text."""
    data, offsets = text_buffers(column)
    rows = [passage_features(data[a:b], keep) for a, b in zip(offsets[:-1], offsets[1:])]
    first = np.cumsum([0, *map(len, rows)])
    return (np.concatenate(rows) if rows else np.zeros((0, N_FEATURES), np.float32)), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of the encoder (W, b), gated attention (V, U, w) and classifier (c, d), and the features' scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -6, 6)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _forward(self.weights, self.scaled(x), first)["score"]

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Weight of each passage in its document; a document's weights sum to 1."""
        return _forward(self.weights, self.scaled(x), first)["a"]


def _forward(p: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """One pass over bags: rows ``first[i]:first[i + 1]`` of x are bag i (one row at least)."""
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    top = np.maximum.reduceat(e, first[:-1])
    e = np.exp(e - top[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}


def _gradients(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted log loss of the bags."""
    f = _forward(p, x, first)
    bag, h, t, g, a, z = (f[k] for k in ("bag", "h", "t", "g", "a", "z"))
    dlogit = (f["score"] - y) * weight / weight.sum()
    dz = dlogit[:, None] * p["c"]
    da = (h * dz[bag]).sum(1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
    dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dlogit, "d": dlogit.sum()}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, encoded: int = 24, gate: int = 12, epochs: int = 60, batch: int = 256,
        rate: float = 0.005, decay: float = 1e-3, seed: int = 5) -> Model:
    """Adam over batches of bags; both classes weigh alike.  The same input gives the same model."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), 1 / np.maximum(x.std(0), 0.02)
    model = Model(mean, scale, {})
    x, y = model.scaled(x).astype(np.float64), y.astype(np.float64)
    n, f = len(y), x.shape[1]
    p = {"W": rng.normal(0, f ** -0.5, (f, encoded)), "b": np.zeros(encoded), "V": rng.normal(0, encoded ** -0.5, (encoded, gate)),
         "U": rng.normal(0, encoded ** -0.5, (encoded, gate)), "w": rng.normal(0, gate ** -0.5, gate),
         "c": rng.normal(0, encoded ** -0.5, encoded), "d": np.zeros(())}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    share = y.mean()
    weight = np.where(y >= 0.5, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, round(n / batch))):
            sizes = first[part + 1] - first[part]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.arange(starts[-1]) + np.repeat(first[part] - starts[:-1], sizes)
            grads = _gradients(p, x[rows], starts, y[part], weight[part])
            step += 1
            for k, g in grads.items():
                g = g + decay * p[k] if k != "d" else g
                m, v = moment[k]
                m = 0.9 * m + 0.1 * g
                v = 0.999 * v + 0.001 * g * g
                moment[k] = (m, v)
                p[k] = p[k] - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model.weights = p
    return model


def _sample_batches(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, first = batch_features(b.column("text"), keep)
        yield pa.record_batch([b.column("doc_id"), b.column("label"),
                               pa.array([rows[a:z].tobytes() for a, z in zip(first[:-1], first[1:])], pa.binary())],
                              names=["doc_id", "label", "rows"])


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None,
                   sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> Model | float:
    """A model of the labelled documents that ``train`` (over doc_id) admits, or the smoothed share of label 1.

    Of a repeated doc_id one text is taken, the one with the least digest.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if train is not None:
        known = known.filter(train)
    known = known.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("label"))
    key = F.sha2(F.col("doc_id").cast("string"), 256)
    known = known.withColumn("_key", key).orderBy("_key").limit(sample_docs)
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.sha2(F.col("text"), 256)).alias("text"))
    got = in_arrow(texts, partial(_sample_batches, keep=sample_passages), "doc_id long, label double, rows binary").toArrow()
    got = got.sort_by("doc_id")
    y = got.column("label").to_numpy()
    hard = (y >= 0.5).astype(np.float64)
    if not 0 < hard.sum() < len(hard):
        return float((hard.sum() + 1) / (len(hard) + 2))
    rows = [np.frombuffer(r, np.float32).reshape(-1, N_FEATURES) for r in got.column("rows").to_pylist()]
    return fit(np.concatenate(rows), np.cumsum([0, *map(len, rows)]), y)


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model | float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, text = b.column("doc_id"), b.column("text")
        if isinstance(model, float):
            yield pa.record_batch([ids, pa.array([model] * len(ids), pa.float64()), pa.array([1] * len(ids), pa.int64())],
                                  names=["doc_id", "score", "passages"])
            continue
        sizes = np.diff(text_buffers(text)[1])
        for a, z in doc_slices(np.concatenate([[0], np.cumsum(sizes)])):
            rows, first = batch_features(text.slice(a, z - a))
            yield pa.record_batch([ids.slice(a, z - a), pa.array(model.score(rows, first), pa.float64()),
                                   pa.array(np.diff(first), pa.int64())], names=["doc_id", "score", "passages"])


def score_documents(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and number of passages of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return in_arrow(rows, partial(_score_batches, model=model), "doc_id long, score double, passages long")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from the fit (contract); a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns, and the number of passages."""
    model = fit_classifier(docs, labels, "quality", ~held_out(F.col("doc_id")))
    rows = score_documents(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
