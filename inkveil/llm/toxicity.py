"""Toxicity by a character n-gram linear classifier with naive Bayes scaling (operator 4).

The features of a text are the character n-grams, of 3 to 5 characters with marks
at both ends, of its words in lower case; a feature is present or not.  Each
is scaled by its log-count ratio between the classes, and a logistic regression
with an L2 penalty is fitted to the scaled features.  Then n-grams whose weight times
ratio is under ``LEAST_EFFECT`` are left out, and the constant is fitted again.

Counts and weights come from a bounded sample of labelled rows (``SAMPLE`` of each
class), weighted by the classes' counts in the whole table.  Null and empty texts have
no feature and get the score of the constant.  Without labelled rows of both classes
scores are the share there is, or 0.5.  A row's score depends on its text alone, so
repeated rows score alike.  Empty tables give no rows.  Scores are a column, so other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import only_cache, release_memory
from inkveil.llm.labelled import labelled_documents

SAMPLE = 2000
SIZES = (3, 4, 5)
LEAST_DOCS, VOCABULARY, LEAST_EFFECT = 4, 40_000, 2e-3
SMOOTH, PENALTY, STEPS, RATE = 0.5, 2e-3, 150, 0.05
#: Bytes of remembered words, and what a word takes besides its characters.
CACHE_BYTES, WORD_BYTES = 64 << 20, 160
WORDS = re.compile(r"[^\W\d_]+").findall


def distinct_words(text: str | None) -> set[str]:
    return set(WORDS((text or "").lower()))


def grams(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[k : k + n] for n in SIZES for k in range(len(marked) - n + 1)}


class GramModel:
    """Weights of n-grams and a constant; remembers what words hold, within bounds."""

    def __init__(self, weights: dict[str, float], constant: float):
        self.weights, self.constant = weights, constant
        self.own = {g: g for g in weights}  # one string an n-gram, whoever remembers it
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, tuple[str, ...]] = {}
        self.size = 0

    def __getstate__(self):
        return {"weights": self.weights, "constant": self.constant}

    def __setstate__(self, state):
        self.__init__(**state)

    def _held(self, word: str) -> tuple[str, ...]:
        if self.size > CACHE_BYTES:
            self.forget()
        self.cache[word] = found = tuple(self.own[g] for g in grams(word) if g in self.own)
        self.size += len(word) + 8 * len(found) + WORD_BYTES
        return found

    def score(self, text: str | None) -> float:
        present: set[str] = set()
        get = self.cache.get
        for w in distinct_words(text):
            held = get(w)
            present.update(self._held(w) if held is None else held)
        total = self.constant + sum(map(self.weights.__getitem__, sorted(present)))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit(words: list[list[str]], y: np.ndarray, weight: np.ndarray | None = None) -> GramModel:
    """words: the distinct words of each document; y: 1 for toxic; weight: of documents."""
    w = np.ones(len(y)) if weight is None or not len(y) else weight / weight.mean()
    share = float((w * y).mean()) if len(y) else 0.5
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len(np.unique(y)) < 2:
        return GramModel({}, prior)
    gram_ids: dict[str, int] = {}
    held: dict[str, np.ndarray] = {}
    rows = []
    for doc in words:
        for word in doc:
            if word not in held:
                held[word] = np.array([gram_ids.setdefault(g, len(gram_ids)) for g in sorted(grams(word))], np.int32)
        rows.append(np.unique(np.concatenate([held[word] for word in doc])) if doc else np.empty(0, np.int32))
    del held
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    col = np.concatenate(rows)
    toxic = y[row] > 0
    p = np.bincount(col[toxic], minlength=len(gram_ids)) + SMOOTH
    q = np.bincount(col[~toxic], minlength=len(gram_ids)) + SMOOTH
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    ratio = np.log(p / (n1 + 2 * SMOOTH)) - np.log(q / (n0 + 2 * SMOOTH))
    use = np.where(p + q - 2 * SMOOTH >= LEAST_DOCS, np.abs(ratio) * np.sqrt(p + q), 0)
    keep = np.sort(np.argsort(-use, kind="stable")[: min(VOCABULARY, int((use > 0).sum()))])
    number = np.full(len(gram_ids), -1, np.int32)
    number[keep] = np.arange(len(keep))
    every = list(gram_ids)
    names, ratio = [every[k] for k in keep], ratio[keep]
    del gram_ids, every
    known = number[col] >= 0
    row, col = row[known], number[col[known]]
    scaled = ratio[col]
    beta, bias = np.zeros(len(names)), prior
    m1, m2 = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):  # Adam over the whole sample
        f = bias + np.bincount(row, beta[col] * scaled, len(rows))
        e = w * (1 / (1 + np.exp(-np.clip(f, -40, 40))) - y)
        g = np.r_[np.bincount(col, e[row] * scaled, len(names)) / len(y) + PENALTY * beta, e.mean()]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        d = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        beta, bias = beta - d[:-1], bias - d[-1]
    effect = beta * ratio
    top = np.flatnonzero(np.abs(effect) >= LEAST_EFFECT)
    f = np.bincount(row, np.where(np.abs(effect) >= LEAST_EFFECT, effect, 0)[col], len(rows))
    for _ in range(20):  # Newton's method on the constant alone
        e = 1 / (1 + np.exp(-np.clip(bias + f, -40, 40)))
        bias -= (w * (e - y)).sum() / max((w * e * (1 - e)).sum(), 1.0)
    return GramModel({names[k]: float(effect[k]) for k in top}, float(bias))


def fit_on_labels(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", sample: int = SAMPLE) -> GramModel:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"words": [sorted(distinct_words(t)) for t in pdf["text"]], "label": pdf["label"], "doc_id": pdf["doc_id"], "weight": pdf["weight"]})
        release_memory()

    rows = labelled_documents(docs, labels, label_col, usable, {0: sample, 1: sample})
    found = rows.mapInPandas(run, "words array<string>, label int, doc_id long, weight double").toPandas()
    found = found.assign(n=found["words"].map(len)).sort_values(["doc_id", "label", "n"])
    return fit([list(w) for w in found["words"]], found["label"].to_numpy().astype(float), found["weight"].to_numpy())


def score(text: Column, model: GramModel) -> Column:
    """0 to 1, higher: likelier toxic."""

    @F.pandas_udf("double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            only_cache(model)
            yield pd.Series([model.score(t) for t in texts.tolist()], dtype=float)
        model.forget()
        release_memory()

    return run(text)
