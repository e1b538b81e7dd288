"""Named entities: a sequence model over tokens, and a gazetteer, each of which can be replaced.

The sequence model scores each token's tags (begin or go on with one of LABELS, or none) by hashed features of its form and neighbours, and each pair of
neighbouring tags; the best sequence is found by Viterbi decoding. Weights are those of an averaged perceptron, trained in rounds: in each, every partition of
the labelled sentences goes on from the common weights by itself, and the mean of what they come to is the next. Tables of weights are of a fixed size (BUCKETS by
tags), whatever the number of sentences. SENTENCES are what the default model is trained on.

The gazetteer finds the phrases of a table as whole words, all in one pass over the text (Aho-Corasick). Of overlapping mentions the first begins earlier, then is
longer; a gazetteer's mention goes before a model's. The automaton is broadcast, so a gazetteer has GAZETTEER_MOST characters at most; a larger one is refused.

Edge cases: a null or empty text has no entities; of long texts the first PREFIX characters are read, as defined. Mentions are given once for each label, in
the order of the text, trimmed. A null phrase or label, and one without a letter or digit, names nothing; a phrase with two labels is both.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Entity labels.
LABELS = ("PERSON", "ORG", "GPE", "LOC", "DATE", "MONEY", "PRODUCT")
TAGS = ("O", *(f"{p}-{x}" for x in LABELS for p in "BI"))
BUCKETS = 1 << 14
PREFIX, ROUNDS, GAZETTEER_MOST = 5000, 6, 32 << 20
_TOKEN = re.compile(r"\w+|[^\w\s]")
_END = re.compile(r"[.!?]")

# Sentences with marked mentions that the default model is trained on: templates, and words for each label.
SENTENCES = (
    "[PERSON] visited [GPE] .", "[PERSON] met [PERSON] in [GPE] on [DATE] .", "[PERSON] works for [ORG] in [GPE] .", "[ORG] paid [MONEY] to [ORG] .", "The [PRODUCT] costs [MONEY] .", "[ORG] launched the [PRODUCT] in [DATE] .",
    "In [DATE] [PERSON] joined [ORG] .", "[ORG] is based in [GPE] .", "They crossed the [LOC] and reached [GPE] .", "The [LOC] lies north of [GPE] .", "[PERSON] was born on [DATE] in [GPE] .", "Shares of [ORG] fell by [MONEY] .",
    "[PERSON] , who lives in [GPE] , bought a [PRODUCT] for [MONEY] .", "On [DATE] the company [ORG] moved to [GPE] .", "We climbed the [LOC] with [PERSON] .", "According to [PERSON] , the price was [MONEY] .",
    "The weather was cold and the river was high .", "It rained all day , and nobody came .", "He said that the house was old .", "She wrote a long letter about the town .", "This is a plain sentence without any names .",
    "President [PERSON] spoke in [GPE] .", "The head of [ORG] , [PERSON] , flew to [GPE] on [DATE] .", "Customers of [ORG] like the new [PRODUCT] .", "From [GPE] to [GPE] it is far .", "Ships sail on the [LOC] to [GPE] .", "Dr [PERSON] left [ORG] in [DATE] .",
)
WORDS = {
    "PERSON": ("Maria Lopez", "John Smith", "Anna Schmidt", "Peter Brown", "Li Wei", "Fatima Khan", "James Carter", "Elena Rossi", "Paul Martin", "Sofia Novak", "Omar Haddad", "Grace Miller"),
    "ORG": ("Acme Corp", "Northern Bank", "Globex Inc", "University of Leeds", "Baker Ltd", "Vector Systems GmbH", "Red Cross", "Stone Institute", "Harbor Group", "Delta Airlines"),
    "GPE": ("Berlin", "France", "Madrid", "New York", "Canada", "Lisbon", "Tokyo", "South Korea", "Chicago", "Vienna", "Brazil", "Oslo"),
    "LOC": ("Alps", "Black Sea", "Rhine", "Sahara", "Lake Geneva", "Pacific Ocean", "Mount Etna", "Andes"),
    "DATE": ("2019-04-02", "3 May 2020", "January 2021", "12 March 1998", "1987", "July 4 , 1976", "2005"),
    "MONEY": ("$ 500", "€ 20", "30 dollars", "1,200 euros", "$ 3 million", "£ 15", "75 USD"),
    "PRODUCT": ("Model X", "Phone 7", "Widget Pro", "Galaxy Tab", "Turbo 3000", "Surface Book"),
}


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def shape(word: str) -> str:
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in word[:12])
    return re.sub(r"(.)\1+", r"\1+", kinds)


def features(words: list[str]) -> list[list[int]]:
    """The buckets of each token's features."""
    out = []
    shapes = [shape(w) for w in words]
    lower = [w.lower() for w in words]
    for k, w in enumerate(words):
        before, after = (lower[k - 1] if k else "^"), (lower[k + 1] if k + 1 < len(words) else "$")
        first = k == 0 or bool(_END.fullmatch(words[k - 1]))
        given = (
            "b", f"w={lower[k]}", f"s={shapes[k]}{first}", f"p={lower[k][:3]}", f"e={lower[k][-3:]}", f"<{before}", f">{after}", f"<s{shapes[k - 1] if k else '^'}|{shapes[k]}", f">s{shapes[k]}|{shapes[k + 1] if k + 1 < len(words) else '$'}",
            f"<<{lower[k - 2] if k > 1 else '^'}|{before}", f"<w{before}|{shapes[k]}",
        )
        out.append([zlib.crc32(g.encode()) % BUCKETS for g in given])
    return out


def viterbi(emission: np.ndarray, transition: np.ndarray) -> list[int]:
    """The best sequence of tags: emission (tokens, tags) and transition (tags before and the start, tags). Of equal ones that of the lower last tags."""
    if not len(emission):
        return []
    score, back = emission[0] + transition[-1], []
    for e in emission[1:]:
        every = score[:, None] + transition[:-1]
        back.append(every.argmax(axis=0))
        score = every.max(axis=0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _allowed() -> np.ndarray:
    """What a tag sequence may have: a mention goes on only after one of its label."""
    out = np.zeros((len(TAGS) + 1, len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag.startswith("I-"):
            for i in range(len(TAGS) + 1):
                if i == len(TAGS) or TAGS[i][2:] != tag[2:]:
                    out[i, j] = -1e9
    return out


class Model:
    """Weights of features by tag, and of pairs of tags."""

    def __init__(self, weights: np.ndarray | None = None, pairs: np.ndarray | None = None) -> None:
        self.weights = np.zeros((BUCKETS, len(TAGS))) if weights is None else weights
        self.pairs = np.zeros((len(TAGS) + 1, len(TAGS))) if pairs is None else pairs
        self.allowed = _allowed()

    def tags(self, words: list[str], found: list[list[int]] | None = None) -> list[int]:
        found = features(words) if found is None else found
        emission = np.array([self.weights[f].sum(axis=0) for f in found]).reshape(len(words), len(TAGS))
        return viterbi(emission, self.pairs + self.allowed)

    def learn(self, sentences: list[tuple[list[str], list[int]]]) -> Model:
        """The average of the weights over one pass of the perceptron, from these on."""
        now = Model(self.weights.copy(), self.pairs.copy())
        # Sums of updates weighted by their step give the average at the end.
        late_w, late_p = np.zeros_like(now.weights), np.zeros_like(now.pairs)
        step = 0
        for words, gold in sentences:
            found = features(words)
            guess = now.tags(words, found)
            if guess != gold:
                for sign, tags in ((1.0, gold), (-1.0, guess)):
                    for f, t in zip(found, tags):
                        now.weights[f, t] += sign
                        late_w[f, t] += sign * step
                    for i, j in pairwise([len(TAGS), *tags]):
                        now.pairs[i, j] += sign
                        late_p[i, j] += sign * step
            step += 1
        return Model(now.weights - late_w / max(step, 1), now.pairs - late_p / max(step, 1))

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, label), sentence by sentence."""
        spans = tokens(text)
        out: list[tuple[int, int, str]] = []
        begin = 0
        for k in range(len(spans)):
            if k + 1 == len(spans) or k - begin >= 199 or _END.fullmatch(text[slice(*spans[k])]):
                own = spans[begin : k + 1]
                begin = k + 1
                for (a, b), t in zip(own, self.tags([text[a:b] for a, b in own])):
                    tag = TAGS[t]
                    if tag[0] == "B":
                        out.append((a, b, tag[2:]))
                    elif tag[0] == "I":
                        out[-1] = (out[-1][0], b, tag[2:])
        return out


def marked(sentences=SENTENCES, words=WORDS, each: int = 12) -> list[tuple[list[str], list[str]]]:
    """(tokens, tags) of templates, filled `each` times with words by turns."""
    rows, at = [], dict.fromkeys(words, 0)
    for n in range(each):
        for sentence in sentences:
            out, tags = [], []
            for part in sentence.split():
                if part[0] == "[" and part[1:-1] in words:
                    label = part[1:-1]
                    own = words[label][(at[label] + n) % len(words[label])].split()
                    at[label] += 1
                    own = [t for w in own for t in _TOKEN.findall(w)]
                    out += own
                    tags += [f"{'I' if k else 'B'}-{label}" for k in range(len(own))]
                else:
                    out.append(part)
                    tags.append("O")
            rows.append((out, tags))
    return rows


def train(labelled: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of labelled(tokens, tags). Sentences stay in their partitions; a round's weights are the mean over partitions, added up in Spark by bucket."""
    spark = labelled.sparkSession
    rows = labelled.select("tokens", "tags").persist()
    model = Model()
    index = {t: k for k, t in enumerate(TAGS)}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.weights, model.pairs))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            old = Model(*shared.value)
            new, seen = old, 0
            for frame in frames:
                own = [(list(w), [index[t] for t in g]) for w, g in zip(frame["tokens"], frame["tags"]) if w is not None and g is not None and len(w) == len(g) > 0 and all(t in index for t in g)]
                if own:
                    new, seen = new.learn(own), seen + len(own)
            if seen:
                every = np.vstack([new.weights - old.weights, new.pairs - old.pairs])
                at, tag = np.nonzero(every)
                yield pd.DataFrame({"at": np.append(at, -1), "tag": np.append(tag, -1), "by": np.append(every[at, tag], 1.0)})

        moved = rows.mapInPandas(run, "at int, tag int, by double").groupBy("at", "tag").agg(F.sum("by").alias("by")).collect()  # BUCKETS by tags at most
        total = {(r["at"], r["tag"]): r["by"] for r in moved}
        parts = total.pop((-1, -1), 1.0)
        weights, pairs = model.weights.copy(), model.pairs.copy()
        for (at, tag), by in total.items():
            if at < BUCKETS:
                weights[at, tag] += by / parts
            else:
                pairs[at - BUCKETS, tag] += by / parts
        model = Model(weights, pairs)
    rows.unpersist()
    return model


def default_model(spark: SparkSession) -> Model:
    """The model of SENTENCES."""
    return train(spark.createDataFrame(marked(), "tokens array<string>, tags array<string>").coalesce(1))


class Gazetteer:
    """Phrases with labels, matched as whole words."""

    def __init__(self, phrases: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.held = ahocorasick.Automaton()
        known: dict[str, list[str]] = {}
        for label, phrase in sorted(phrases):
            known.setdefault(phrase, []).append(label)
        for phrase, labels in known.items():
            self.held.add_word(phrase, (len(phrase), labels))
        self.any = bool(known)
        if self.any:
            self.held.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """All mentions (start, end, label), overlapping ones included, by place and label."""
        out = []
        for last, (size, labels) in self.held.iter(text) if self.any and text else ():
            a, b = last - size + 1, last + 1
            if not (a and _word(text[a - 1]) and _word(text[a])) and not (b < len(text) and _word(text[b]) and _word(text[b - 1])):
                out += [(a, b, label) for label in labels]
        return sorted(out)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def gazetteer(phrases: DataFrame, label: str = "label", phrase: str = "phrase", most: int = GAZETTEER_MOST) -> Gazetteer:
    """The gazetteer of a table; one of more than `most` characters is an error, as it is sent to every task."""
    rows = phrases.select(F.col(label).alias("label"), F.trim(phrase).alias("phrase")).where(r"label IS NOT NULL AND phrase RLIKE '[\\p{L}\\p{N}]'").distinct()
    size = rows.agg(F.coalesce(F.sum(F.char_length("phrase")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"a gazetteer of {size} characters is too large to be sent to every task; its limit is {most}")
    return Gazetteer([(r["label"], r["phrase"]) for r in rows.collect()])


def gazetteer_hits(docs: DataFrame, held: Gazetteer, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., label, phrase, start, end) of all mentions in whole texts, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("array<struct<label: string, phrase: string, start: int, end: int>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[(label, t[a:b], a, b) for a, b, label in shared.value.hits(t)] if t else [] for t in texts])

    return docs.select(*keep, F.explode(found(F.col(text))).alias("_h")).select(*keep, "_h.*")


def chosen(mentions: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str]]:
    """Of (start, end, label, rank) those that stay: lower ranks first, then earlier and longer ones; equal spans of one rank stay together."""
    out: list[tuple[int, int, str, int]] = []
    for a, b, label, rank in sorted(mentions, key=lambda m: (m[3], m[0], -m[1], m[2])):
        if all(b <= x or a >= y or (a, b, rank) == (x, y, r) for x, y, _, r in out):
            out.append((a, b, label, rank))
    return sorted(m[:3] for m in out)


def recogniser(spark: SparkSession, model: Model | None = None, held: Gazetteer | None = None) -> Callable[[Column], Column]:
    """A function of the shape that extract() takes as its ner: map of label to ordered distinct mentions; labels without any are left out."""
    shared = spark.sparkContext.broadcast((model, held))

    @F.pandas_udf("map<string, array<string>>")
    def run(texts: pd.Series) -> pd.Series:
        own_model, own_held = shared.value
        out = []
        for text in texts:
            head = (text or "")[:PREFIX]
            found = [(*m, 0) for m in own_held.hits(head)] if own_held else []
            found += [(*m, 1) for m in own_model.mentions(head)] if own_model else []
            by_label: dict[str, list[str]] = {}
            for a, b, label in chosen(found):
                mention = head[a:b].strip()
                if mention and mention not in by_label.setdefault(label, []):
                    by_label[label].append(mention)
            out.append(by_label)
        return pd.Series(out)

    return run
