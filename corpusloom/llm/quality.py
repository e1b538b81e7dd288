"""Quality classifier: attention-based multiple-instance learning over the passages of whole texts.

A text is cut into passages of about PASSAGE bytes. Each passage is described by the shares of byte classes and of pairs of
coarser classes, encoded by one tanh layer, weighted by gated attention (softmax over the text's passages of
w . (tanh(V h) * sigmoid(U h))), and the weighted mean is scored by a logistic unit. All layers are trained jointly, in
numpy, from labels of documents only.

Training takes a bounded sample: ROWS labelled documents of each class, the first by a hash of the id, with TRAIN_PASSAGES passages
together at most. Where they have more, each gives so many passages, spread evenly over its whole text, as keep the bound, so
no long text can push another out. Scoring takes whole texts, whose passages are described in steps of bounded size.

Edge cases: a null or empty text has no passage and is scored by the zero representation; without rows of both classes the
score of every text is the share of label 1 (0.5 without any). Null ids or labels don't train; an id with several rows
trains with one of them, with several labels as good. Repeated rows and ties have equal scores. An empty table gives
an empty result. A column named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import chunks, column_of
from .samples import labelled, level, remainder, texts_of
from .sparkutil import without

PASSAGE = 512
ROWS = 3000
TRAIN_PASSAGES = 80_000
HIDDEN = 24
ATTENTION = 12
EPOCHS = 40
SEED = 5
#: Passages that are described together.
_STEP = 2048

#: Byte classes: each small letter and each mark of its own; capitals, digits, ends of lines, controls, lead and continuation bytes.
_FINE = np.zeros(256, dtype=np.int64)
_MARKS = b" .,;:!?'\"()[]{}<>|/\\-_=+*&%$#@~^`"
for _k in range(256):
    _FINE[_k] = _k - 97 if 97 <= _k < 123 else 26 if 65 <= _k < 91 else 27 if 48 <= _k < 58 else 28 if _k == 10 else 30 if _k >= 192 else 31 if _k >= 128 else 32 + _MARKS.index(_k) if _k in _MARKS else 29
_N_FINE = 32 + len(_MARKS)
_COARSE = np.where(_FINE < 26, 0, np.where(_FINE == 26, 1, np.where(_FINE == 27, 2, np.where((_FINE == 28) | (np.arange(256) == 32), 3, np.where((_FINE == 30) | (_FINE == 31), 4, 5)))))
_N_COARSE = 6
WIDTH = _N_FINE + _N_COARSE**2


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of the passages, number of passages of each text)."""
    size = np.diff(offsets)
    n = -(-size // PASSAGE)
    text = np.repeat(np.arange(len(size)), n)
    if not len(text):
        return np.zeros((0, WIDTH), dtype=np.float32), n
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = offsets[text] + k * size[text] // n[text]
    length = np.diff(np.concatenate([begin, [offsets[-1]]]))
    return np.concatenate([_described(data, begin[at : at + _STEP], length[at : at + _STEP]) for at in range(0, len(text), _STEP)]), n


def _described(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Features of consecutive passages."""
    owner = np.repeat(np.arange(len(begin)), length)
    part = data[begin[0] : begin[-1] + length[-1]]
    fine = np.bincount(owner * _N_FINE + _FINE[part], minlength=len(begin) * _N_FINE).reshape(len(begin), _N_FINE)
    coarse = _COARSE[part]
    same = owner[1:] == owner[:-1]
    pair = np.bincount((owner[1:] * _N_COARSE**2 + coarse[:-1] * _N_COARSE + coarse[1:])[same], minlength=len(begin) * _N_COARSE**2).reshape(len(begin), -1)
    return np.sqrt(np.concatenate([fine, pair], axis=1) / length[:, None]).astype(np.float32)


class AttentionModel:
    """Parameters of the network, its forward pass and its training."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"E": draw(len(mean), HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple:
        """x: passages of consecutive texts, n: how many each text has."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        tanh, gate = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (tanh * gate) @ p["w"]
        some = np.flatnonzero(n)
        at = (np.cumsum(n) - n)[some]
        z = np.zeros((len(n), h.shape[1]), dtype=np.float64)
        weight = a
        if len(some):
            a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), n[some]))
            weight = a / np.repeat(np.add.reduceat(a, at), n[some])
            z[some] = np.add.reduceat(weight[:, None] * h, at, axis=0)
        logit = np.clip(z @ p["c"] + p["b"][0], -40, 40)
        return x, h, tanh, gate, weight, z, 1 / (1 + np.exp(-logit))

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.forward(x, n)[-1]

    def train(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        first = np.cumsum(n) - n
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(n))
            for at in range(0, len(n), batch):
                some = order[at : at + batch]
                rows = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in some])
                for k, g in self._gradient(x[rows], n[some], y[some]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    t = step + 1
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
                step += 1

    def _gradient(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, tanh, gate, weight, z, s = self.forward(x, n)
        d = (s - y) / len(n)
        text = np.repeat(np.arange(len(n)), n)
        dz = d[:, None] * p["c"]
        dh = weight[:, None] * dz[text]
        da = weight * ((h - z[text]) * dz[text]).sum(axis=1)
        du, dv = da[:, None] * p["w"] * tanh * gate * (1 - gate), da[:, None] * p["w"] * gate * (1 - tanh**2)
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (da[:, None] * tanh * gate).sum(axis=0), "c": z.T @ d, "b": np.array([d.sum()])}


class Constant:
    """The share of label 1, where only one class or none is known."""

    def __init__(self, value: float) -> None:
        self.value = value

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.full(len(n), self.value)


def is_held_out(doc_id: str = "doc_id") -> Column:
    return remainder(doc_id, 5) == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, rows: int = ROWS, limit: int = TRAIN_PASSAGES, seed: int = SEED) -> AttentionModel | Constant:
    """A model from the labelled rows that fulfil train (those not held out). Passages are encoded on the executors; the
    driver gets features of at most limit passages."""
    sample = labelled(labels, label, rows, ~is_held_out() if train is None else train)
    found = texts_of(sample, docs)
    # One number for each of at most 2 * rows ids.
    sizes = found.groupBy("doc_id").agg(F.max(F.ceil(F.octet_length("text") / PASSAGE)).alias("n")).select("n").toArrow().column("n").to_numpy()
    most = level(sizes, limit)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(column_of(batch, "text")):
                x, n = passages(data, offsets)
                blobs = []
                for e, k in zip(np.cumsum(n).tolist(), n.tolist()):
                    some = np.arange(k) if k <= most else (2 * np.arange(most) + 1) * k // (2 * most)
                    blobs.append(x[e - k + some].tobytes())
                yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id").slice(a, b - a), column_of(batch, "label").slice(a, b - a), pa.array(blobs, pa.binary())], ["doc_id", "label", "x"])

    schema = T.StructType([found.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])
    encoded = found.select("doc_id", "label", "text").mapInArrow(encode, schema)
    # Rows that repeat an id are aggregated where they are.
    got = encoded.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).toArrow().sort_by([("doc_id", "ascending")])
    y = got.column("label").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    parts = [np.frombuffer(x, dtype=np.float32).reshape(-1, WIDTH) for x in got.column("x").to_pylist()]
    x, n = np.concatenate(parts), np.array([len(k) for k in parts])
    model = AttentionModel(x.mean(axis=0), np.maximum(x.std(axis=0), 0.02), seed)
    model.train(x, n, y)
    return model


def scored(docs: DataFrame, model: AttentionModel | Constant, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the score of label 1."""
    docs = without(docs, (to,))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(column_of(batch, text)):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shared.value.score(*passages(data, offsets)).astype(float))], [*rows.schema.names, to])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))
