"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams of NGRAMS characters, with marks at both ends, and of its whole spelling (WHOLE times); each
of these, hashed to one of BUCKETS, has a vector; a word is the mean of its bag's vectors, a passage of about PASSAGE words the mean of its
words' (repeated ones once), and two linear units with a softmax score it. A misspelling shares most n-grams with its word.
Embeddings and softmax are learnt together from labels of documents: at first each passage has its document's label;
then the passages that the model itself finds worst stand for their document. A document's score pools its passages: the
worst one's logit (a few words are not diluted by a long text), the mean of all, and their number, weighted by a logistic
regression on rows of the sample that were set aside.

N-grams that are in fewer than LEAST_TEXTS toxic training texts, or not LEAST_RATIO times commoner in toxic ones than in others, keep the
zero vector. The floor is a count and not a share, so a language with few toxic rows is learnt like one with many.

Training takes a bounded sample: ROWS labelled documents of each class, the first by a hash of the id, with about 8 * TRAIN_WORDS bytes
at most. Where the whole texts are more, each gives its excerpt (windows spread evenly over all of it) of the largest size that keeps
the bound, so no long text can push another out. Scoring takes whole texts; one of more than PIECE characters is cut into
passages piece by piece, at white space, in bounded memory.

Edge cases: a null or empty text, or one without words, has the score of an empty passage; without rows of both classes
every score is the share of label 1 (0.5 without any). Null ids or labels don't train; an id with several rows trains with one
of them, with several labels as toxic. Repeated rows and ties have equal scores. An empty table gives an empty
result. A column named like the score is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import column_of, mix
from .samples import excerpts, labelled, remainder, texts_of
from .sparkutil import without

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 20
#: Times that a word's whole spelling counts in its bag, beside its n-grams.
WHOLE = 4
DIM = 8
PASSAGE = 40
ROWS = 1500
TRAIN_WORDS = 1_200_000
EPOCHS = 8
SEED = 6
#: Averages are multiplied by this before the softmax: one word in a passage of PASSAGE has to be able to decide.
SCALE = 40.0
#: Toxic training texts that an n-gram has to be in, and how much commoner it has to be there; share by which parameters shrink at each step.
LEAST_TEXTS, LEAST_RATIO = 3, 3.0
DECAY = 2e-3
#: Weight of the toxic class in training.
TOXIC_SHARE = 0.2
#: A passage counts as having so many distinct words at least.
LEAST_WORDS = 12
#: Share of the sample that is kept for calibration, and the weight of its clean rows there.
CALIBRATION = 0.2
CLEAN_WEIGHT = 0.4
#: Steps of training at least, whatever the number of epochs.
STEPS = 600
#: How pooled values (worst passage, mean, length, 1) count without calibration; ridge of the calibration.
PRIOR = np.array([1.0, 0.0, 0.0, 0.0])
RIDGE = np.array([0.1, 0.1, 0.1, 0.01])
CHUNK = 1 << 18
#: Characters of a longer text that are cut into passages together.
PIECE = 1 << 16

_BLANK = re.compile(r"\s")
_CORE = np.zeros(128, dtype=bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = True


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, hash of its spelling, word of each n-gram, bucket of each n-gram)."""
    joined = "\n\n" + "\n\n".join(t.lower() for t in texts) + "\n\n"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    core = np.ones(len(chars), dtype=bool)
    plain = chars < 128
    core[plain] = _CORE[chars[plain]]
    # A mark between two letters belongs to the word: misspellings put them there.
    mark = plain & ~core & (chars > 32)
    inside = core.copy()
    inside[1:-1] |= mark[1:-1] & core[:-2] & core[2:]
    codes = np.where(inside, chars, 0).astype(np.uint64)
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    word = np.cumsum(np.concatenate([[False], inside[1:] & ~inside[:-1]])) - 1
    lengths = np.array([len(t.lower()) + 2 for t in texts], dtype=np.int64)
    text = np.searchsorted(np.cumsum(lengths) + 2, first, side="right")
    place = np.arange(len(codes)) - (first[np.maximum(word, 0)] if len(first) else 0)
    letters = np.where(inside, mix(codes * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), np.uint64(0))
    spelled = np.add.reduceat(letters, first) if len(first) else np.zeros(0, dtype=np.uint64)
    words, buckets = [], []
    for n in NGRAMS:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
        whole = np.ones(len(h), dtype=bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : k + len(h)]
            if 0 < k < n - 1:
                whole &= inside[k : k + len(h)]
        at = np.flatnonzero(whole)
        words.append(word[at + 1])
        buckets.append((mix(h[at] + np.uint64(n)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    whole_word = (mix(spelled + np.uint64(1)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
    words += [np.arange(len(first))] * WHOLE
    buckets += [whole_word] * WHOLE
    return text, spelled, np.concatenate(words), np.concatenate(buckets)


def cut_passages(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage of each word, text of each passage); each text of n words has ceil(n / PASSAGE) passages of like length."""
    n = np.bincount(text, minlength=n_texts)
    parts = -(-n // PASSAGE)
    k = np.arange(len(text)) - (np.cumsum(n) - n)[text]
    return (np.cumsum(parts) - parts)[text] + k * parts[text] // np.maximum(n[text], 1), np.repeat(np.arange(n_texts), parts)


def passages(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(distinct words of each passage, LEAST_WORDS at least, text of each passage, passage of each distinct word, word of each n-gram, bucket of each n-gram).

    A word that a passage repeats counts once there, so that a text which says one harmless word all over is no more
    than that word.
    """
    text, spelled, word, bucket = bags(texts)
    passage, owner = cut_passages(text, len(texts))
    _, kept = np.unique(mix(spelled + passage.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    kept.sort()
    number = np.full(len(text), -1, dtype=np.int64)
    number[kept] = np.arange(len(kept))
    some = number[word] >= 0
    return np.maximum(np.bincount(passage[kept], minlength=len(owner)), LEAST_WORDS), owner, passage[kept], number[word[some]], bucket[some]


def pieces(text: str, most: int = PIECE) -> list[str]:
    """The whole text in parts of about most characters, cut at the next white space (or after most more without any)."""
    out, at = [], 0
    while len(text) - at > most:
        space = _BLANK.search(text, at + most, at + 2 * most)
        end = space.end() if space else min(len(text), at + 2 * most)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


class SubwordModel:
    """weights: what each n-gram adds, that is its embedding times the difference of the two softmax units."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias
        self.pooling = PRIOR.copy()

    def passage_means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean of the words' weights, text) of each passage."""
        size, owner, passage, word, bucket = passages(texts)
        per_word = np.bincount(word, weights=self.weights[bucket], minlength=len(passage)) / np.maximum(np.bincount(word, minlength=len(passage)), 1)
        return np.bincount(passage, weights=per_word, minlength=len(owner)) / size, owner

    def pooled(self, texts: list[str]) -> np.ndarray:
        """(texts, 4): the logit of each text's worst passage, the mean of its passages' logits, the log of their number, and 1."""
        cut = [(k, part) for k, t in enumerate(texts) for part in pieces(t)]
        best, total, n = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros(len(texts))
        first = 0
        while first < len(cut):
            end, chars = first + 1, len(cut[first][1])
            while end < len(cut) and chars + len(cut[end][1]) <= CHUNK:
                chars += len(cut[end][1])
                end += 1
            own = np.array([k for k, _ in cut[first:end]])
            each, part = self.passage_means([t for _, t in cut[first:end]])
            if len(part):
                np.maximum.at(best, own[part], each)
                np.add.at(total, own[part], each)
                np.add.at(n, own[part], 1)
            first = end
        best[n == 0] = 0.0
        mean = total / np.maximum(n, 1)
        return np.stack([np.clip(SCALE * best + self.bias, -30, 30), np.clip(SCALE * mean + self.bias, -30, 30), np.log1p(n), np.ones(len(texts))], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(texts) @ self.pooling, -40, 40)))

    def calibrate(self, texts: list[str], labels: np.ndarray, clean_weight: float = CLEAN_WEIGHT) -> None:
        """Fits how worst passage, mean and length count, by a ridge logistic regression on texts that were not trained on."""
        x = np.concatenate([self.pooled(texts[k : k + 64]) for k in range(0, len(texts), 64)])
        centre, spread = x.mean(axis=0) * [1, 1, 1, 0], np.where(np.arange(4) < 3, np.maximum(x.std(axis=0), 0.1), 1.0)
        a = (x - centre) / spread
        w = np.where(labels == 1, 1.0, clean_weight)
        loss = lambda c: (w * np.logaddexp(0, np.where(labels == 1, -1, 1) * (a @ c))).sum() + (RIDGE * c * c).sum() / 2
        c = np.zeros(4)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ c, -40, 40)))
            step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(RIDGE), a.T @ (w * (p - labels)) + RIDGE * c)
            rate = 1.0
            while rate > 1e-6 and loss(c - rate * step) > loss(c):
                rate /= 2
            c = c - rate * step
            if np.abs(step).max() < 1e-8 or rate <= 1e-6:
                break
        self.pooling = c / spread
        self.pooling[3] = c[3] - (c / spread * centre)[:3].sum()


class Constant:
    def __init__(self, value: float) -> None:
        self.value = value

    def score(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.value)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, seed: int = SEED) -> SubwordModel | Constant:
    labels = np.asarray(labels, dtype=float)
    if len(set(labels.tolist())) < 2:
        return Constant(float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    kept_out = [k for k in range(len(texts)) if k % round(1 / CALIBRATION) == 0]
    aside = [texts[k] for k in kept_out], labels[kept_out]
    if len(set(aside[1].tolist())) == 2:
        used = [k for k in range(len(texts)) if k % round(1 / CALIBRATION)]
        texts, labels = [texts[k] for k in used], labels[used]
        if len(set(labels.tolist())) < 2:
            return Constant(float(labels.mean()))
    parts = []
    for at in range(0, len(texts), 64):
        size, owner, passage, word, bucket = passages(texts[at : at + 64])
        parts.append((size, owner + at, passage, word, bucket))
    # N-grams of few toxic texts, or not much commoner there, would be learnt by heart: their vectors stay zero, like those of unseen ones.
    seen = np.zeros((2, BUCKETS), dtype=np.int64)
    for _, owner, passage, word, bucket in parts:
        if len(word):
            pairs = np.unique(owner[passage[word]].astype(np.int64) * BUCKETS + bucket)
            for y in (0, 1):
                seen[y] += np.bincount(pairs[labels[pairs // BUCKETS] == y] % BUCKETS, minlength=BUCKETS)
    n_toxic = labels.sum()
    usual = np.flatnonzero((seen[1] >= LEAST_TEXTS) & ((seen[1] + 0.5) / (n_toxic + 1) >= LEAST_RATIO * (seen[0] + 0.5) / (len(labels) - n_toxic + 1)))
    # Only those are trained; row 0 stands for all others and stays zero.
    row = np.zeros(BUCKETS, dtype=np.int32)
    row[usual] = np.arange(1, len(usual) + 1)
    parts = [(size, owner, passage, word, row[bucket]) for size, owner, passage, word, bucket in parts]
    learnt = (np.arange(len(usual) + 1) > 0)[:, None]
    epochs = max(epochs, -(-STEPS // max(1, len(parts))))
    embedding = (rng.standard_normal((len(learnt), DIM)) * 0.05 * learnt).astype(np.float32)
    softmax = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    squares = [np.full_like(x, 1e-6) for x in (embedding, softmax, bias)]
    for epoch in range(epochs):
        for k in rng.permutation(len(parts)).tolist():
            size, owner, passage, word, bucket = parts[k]
            if not len(passage):
                continue
            n_words = len(passage)
            grams = np.bincount(word, minlength=n_words)
            sums = np.stack([np.bincount(word, weights=embedding[bucket, d], minlength=n_words) for d in range(DIM)], axis=1)
            vectors = sums / np.maximum(grams, 1)[:, None]
            mean = np.stack([np.bincount(passage, weights=vectors[:, d], minlength=len(owner)) for d in range(DIM)], axis=1) / size[:, None]
            logits = SCALE * mean @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            y = labels[owner]
            use = np.ones(len(owner))
            if epoch >= 2:
                # A text is its worst passages: half of a toxic one's (the others may be harmless), a few of a clean one's.
                order = np.lexsort((-p[:, 1], owner))
                n = np.bincount(owner - owner.min())
                rank = np.empty(len(owner), dtype=np.int64)
                rank[order] = np.arange(len(owner)) - (np.cumsum(n) - n)[owner[order] - owner.min()]
                use[rank >= np.maximum(1, n[owner - owner.min()] // np.where(y == 1, 2, 40))] = 0
            share = np.where(y == 1, TOXIC_SHARE / max(1.0, use[y == 1].sum()), (1 - TOXIC_SHARE) / max(1.0, use[y == 0].sum())) * use
            d = (p - np.stack([1 - y, y], axis=1)) * share[:, None]
            d_mean = SCALE * d @ softmax.T
            d_word = (d_mean / size[:, None])[passage] / np.maximum(grams, 1)[:, None]
            d_embedding = np.stack([np.bincount(bucket, weights=d_word[word, k2], minlength=len(learnt)) for k2 in range(DIM)], axis=1) * learnt
            for x, s, g in zip((embedding, softmax, bias), squares, (d_embedding, SCALE * mean.T @ d, d.sum(axis=0))):
                s *= 0.98
                s += 0.02 * g * g
                x *= 1 - DECAY
                x -= (rate * (1 - epoch / epochs) * g / (np.sqrt(s) + 1e-5)).astype(np.float32)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[usual] = (embedding @ (softmax[:, 1] - softmax[:, 0]))[1:]
    model = SubwordModel(weights, float(bias[1] - bias[0]))
    if len(set(aside[1].tolist())) == 2:
        model.calibrate(*aside)
    return model


def is_held_out(doc_id: str = "doc_id") -> Column:
    return remainder(doc_id, 3) == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: Column | None = None, rows: int = ROWS, words: int = TRAIN_WORDS, seed: int = SEED) -> SubwordModel | Constant:
    """A model from the labelled rows that fulfil train_rows (those not held out); the driver gets texts of about words words
    (8 bytes each) at most."""
    sample = labelled(labels, label, rows, ~is_held_out() if train_rows is None else train_rows)
    got = excerpts(texts_of(sample, docs), 8 * words).toArrow()
    rows_ = sorted(zip(got.column("doc_id").to_pylist(), got.column("label").to_pylist(), got.column("text").to_pylist()))
    order = np.random.default_rng(seed).permutation(len(rows_)).tolist()
    return train([rows_[k][2] for k in order], np.array([rows_[k][1] for k in order]), seed=seed)


def scored(docs: DataFrame, model: SubwordModel | Constant, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the score of label 1."""
    docs = without(docs, (to,))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            column = column_of(batch, text)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            while first < batch.num_rows:
                end, total = first + 1, sizes[first]
                while end < batch.num_rows and total + sizes[end] <= CHUNK:
                    total += sizes[end]
                    end += 1
                texts = [t or "" for t in column.slice(first, end - first).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, pa.array(shared.value.score(texts))], [*batch.schema.names, to])
                first = end

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))
