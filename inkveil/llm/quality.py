"""Quality scores by a generalised additive model with pairwise interactions (operator 2).

Features are counts and ratios of a whole text.  Each is cut into bins at sample
quantiles.  Training is cyclic boosting: in every round each feature in turn gets a
shallow tree on its bins, fitted to the gradient of the log loss and added to the
feature's lookup table at a small rate; then the pairs with the largest gain on the
residuals get tables of their own, by trees with one cut on each axis.  A score is
the logistic function of a sum of table entries, looked up for whole arrays.

Labels are read from a bounded sample (``SAMPLE`` documents of each class), weighted
by the classes' counts in the whole table.  Null and empty texts have a score as any
other.  Without labelled rows of both classes every score is the share of the class
there is, or 0.5 (``AdditiveModel.learned`` is False).  A row's score depends on its
text alone, so repeated rows score alike.  Empty tables give no rows.  Scores are a
column, so other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import release_memory
from inkveil.llm.labelled import labelled_documents

KEEP = 0.7
SAMPLE = 4000
BINS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES, PAIRS = 32, 60, 30, 0.15, 4, 8
#: Regularisation: least sum of second derivatives in a leaf, and its penalty.
LEAST, RIDGE = 2.0, 1.0

FEATURES = (
    "log_bytes", "word_bytes", "upper", "symbols", "digits", "blanks", "high_bytes", "distinct_words", "same_as_before",
    "top_word", "distinct_pairs", "no_letter", "odd_end", "distinct_lines", "line_words", "line_stop", "upper_words", "top_byte",
)
_kind = np.zeros(256, np.int64)
_kind[[*range(65, 91)]] = 1
_kind[[*range(97, 123)]] = 2
_kind[[*range(48, 58)]] = 3
_kind[[32, *range(9, 14)]] = 4
_kind[128:] = 5
_PLAIN_END = frozenset(".,;:!?\"')")


def features(text: str | None) -> list[float]:
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    n, m = len(data) or 1, len(words) or 1
    by_byte = np.bincount(data, minlength=256)
    kinds = np.bincount(_kind, weights=by_byte, minlength=6)
    letters = kinds[1] + kinds[2] + kinds[5] or 1
    counts = Counter(words)
    pairs = set(zip(words, words[1:]))
    same = sum(map(operator.eq, words, words[1:]))
    ends = Counter(w[-1] for w in words)
    odd = sum(c for e, c in ends.items() if not e.isalnum() and e not in _PLAIN_END)
    lines = [x for x in text.split("\n") if x.strip()]
    k = len(lines) or 1
    distinct = counts.items()
    return [
        math.log1p(len(data)), (n - kinds[4]) / m, kinds[1] / letters, kinds[0] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n,
        len(counts) / m, same / m, max(counts.values(), default=0) / m, len(pairs) / m,
        sum(c for w, c in distinct if not any(map(str.isalpha, w))) / m, odd / m, len(set(lines)) / k, len(words) / k,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / k, sum(c for w, c in distinct if w.isupper()) / m, by_byte[33:].max(initial=0) / n,
    ]


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values of each bin: the best cuts of the bins into at most so many runs."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, z in zip(cuts[:-1], cuts[1:]):
            if z - a < 2:
                continue
            k = np.arange(a + 1, z)
            gl, hl, gr, hr = cg[k] - cg[a], ch[k] - ch[a], cg[z] - cg[k], ch[z] - ch[k]
            gain = _gain(gl, hl) + _gain(gr, hr) - _gain(cg[z] - cg[a], ch[z] - ch[a])
            gain[(hl < LEAST) | (hr < LEAST)] = 0
            if gain.max() > best:
                best, where = gain.max(), int(k[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.empty(len(g))
    for a, z in zip(cuts[:-1], cuts[1:]):
        out[a:z] = _leaf(cg[z] - cg[a], ch[z] - ch[a])
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree with one cut on each axis of a grid of bins, and its gain."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a = c[1:-1, 1:-1]
        top, left, all_ = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [a, top - a, left - a, all_ - top - left + a]

    qg, qh = quarters(cg), quarters(ch)
    gain = sum(_gain(x, y) for x, y in zip(qg, qh)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    for (rows, cols), x, y in zip(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))), qg, qh):
        out[rows, cols] = _leaf(x[i, j], y[i, j])
    return out, float(gain[i, j])


class AdditiveModel:
    """Bin edges, a table for each feature, tables for some pairs, and a constant."""

    def __init__(self, edges: list[np.ndarray], constant: float):
        self.edges, self.constant = edges, constant
        self.learned = False
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]) if len(x) else np.empty((0, len(self.edges)), int)

    def raw(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.constant)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for (i, j), t in self.pairs.items():
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> AdditiveModel:
    w = np.ones(len(y)) if weight is None else weight
    share = float((w * y).sum() / w.sum()) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.empty(0) for k in range(x.shape[1])]
    model = AdditiveModel(edges, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len(np.unique(y)) < 2:
        return model
    model.learned = True
    b = model.bins(x)
    f = model.raw(b)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return w * (y - p), w * np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)))
            t += step
            f += step[b[:, k]]
    g, h = slopes()
    ranked = []
    for i in range(len(edges)):
        for j in range(i + 1, len(edges)):
            shape = (len(model.tables[i]), len(model.tables[j]))
            if min(shape) > 1:
                flat = b[:, i] * shape[1] + b[:, j]
                gain = pair_tree(np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape))[1]
                ranked.append((gain, i, j))
    for _, i, j in sorted(ranked, reverse=True)[:PAIRS]:
        model.pairs[i, j] = np.zeros((len(model.tables[i]), len(model.tables[j])))
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in model.pairs.items():
            g, h = slopes()
            flat = b[:, i] * t.shape[1] + b[:, j]
            step = RATE * pair_tree(np.bincount(flat, g, t.size).reshape(t.shape), np.bincount(flat, h, t.size).reshape(t.shape))[0]
            t += step
            f += step[b[:, i], b[:, j]]
    return model


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))


def fit_on_labels(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", sample: int = SAMPLE) -> AdditiveModel:
    """Fits on a bounded sample of labelled documents; its features are computed on the executors."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"x": list(_matrix(pdf["text"].tolist())), "label": pdf["label"], "doc_id": pdf["doc_id"], "weight": pdf["weight"]})
        release_memory()

    rows = labelled_documents(docs, labels, label_col, usable, {0: sample, 1: sample})
    found = rows.mapInPandas(run, "x array<double>, label int, doc_id long, weight double").toPandas()
    found = found.assign(first=[float(v[0]) for v in found["x"]]).sort_values(["doc_id", "label", "first"])
    x = np.vstack(found["x"].tolist()) if len(found) else np.empty((0, len(FEATURES)))
    return fit(x, found["label"].to_numpy().astype(float), found["weight"].to_numpy() / max(1.0, found["weight"].mean()) if len(found) else None)


def score(text: Column, model: AdditiveModel) -> Column:
    """0 to 1, higher: likelier of good quality."""

    @F.pandas_udf("double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series(model.score(_matrix(texts.tolist())))
        release_memory()

    return run(text)
