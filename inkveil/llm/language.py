"""Language by a linear-chain conditional random field over words (operator 10).

A line's words form a chain whose states are languages.  A word's features are its
affixes, its character n-grams and, for frequent words, the word itself as a
lexicon entry; with learned transitions between states they give every word's
marginal probabilities by the forward-backward algorithm, so a text that switches
language is labelled word by word.  A document's language is the one with the most
marginal mass, its score that mass over the number of words.

Training chains are cut from a bounded sample of documents (``SAMPLE``, with
``SEGMENTS`` stretches of ``STRETCH`` words from all over each); half of them join
stretches of two documents, so that transitions are learned on switched text too.
Scoring reads whole texts.  Words are runs of letters (general category L); texts that
are null or have no letter get ``und`` with score 0, as do all when nothing could be
learned.  Ties go to the first language in alphabetical order.  A row's result depends
on its text alone, so repeated rows have like results.  Empty tables give no rows.
Results are a column, so other columns, whatever their names, are left alone.  The
languages are the states of the model, so their number is bounded by what a model of
``languages ** 2`` transitions can be.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import only_cache, release_memory

SAMPLE, SEGMENTS, STRETCH = 3000, 6, 16
FEATURES, LEXICON, LEAST = 1 << 16, 5000, 5
STEPS, BATCH, RATE, PENALTY = 250, 512, 0.05, 1e-6
#: Least documents of a language in the sample, however many languages there are.
LEAST_SAMPLE = 50
#: Words whose scores a worker remembers, feature strings of a kind, and the longest chain.
CACHE, STRINGS, LONGEST = 250_000, 30_000, 256
UNKNOWN = "und"
_runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters; the class above also takes numbers such as a half, which are cut out."""
    found = _runs(text)
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


class _Numbers(dict):
    """Feature numbers of strings of one kind, worked out once."""

    def __init__(self, kind: str):
        self.kind = kind

    def __missing__(self, key: str) -> int:
        if len(self) > STRINGS:
            self.clear()
        self[key] = found = zlib.crc32((self.kind + key).encode("utf-8", "surrogatepass")) % FEATURES
        return found


_prefix, _suffix, _gram = map(_Numbers, "psg")


def word_features(word: str, lexicon: set[str]) -> list[int]:
    marked = f"<{word}>"
    n = len(marked)
    found = {_prefix[word[:1]], _prefix[word[:2]], _prefix[word[:3]], _suffix[word[-1:]], _suffix[word[-2:]], _suffix[word[-3:]]}
    found.update([_gram[marked[k : k + 2]] for k in range(n - 1)])
    found.update([_gram[marked[k : k + 3]] for k in range(n - 2)])
    if word in lexicon:
        found.add(zlib.crc32(f"w{word}".encode("utf-8", "surrogatepass")) % FEATURES)
    return sorted(found)


def forward_backward(e: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of chains e[chain, place, state] (log scores; longest chains first).

    Also the pair marginals summed over all places, for the transitions' gradient.
    """
    n, t, k = e.shape
    m, top = np.exp(move), e.max(axis=2, keepdims=True)
    x = np.exp(e - top)
    alpha, beta = np.zeros_like(x), np.zeros_like(x)
    live = [int(np.searchsorted(-length, -p, side="left")) for p in range(t + 1)]  # chains longer than p
    a = x[:, 0] * np.exp(start)
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for p in range(1, t):
        c = live[p]
        a = (alpha[:c, p - 1] @ m) * x[:c, p]
        alpha[:c, p] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    last = length - 1
    beta[np.arange(n), last] = 1
    for p in range(t - 2, -1, -1):
        c = live[p + 1]
        y = x[:c, p + 1] * beta[:c, p + 1]
        b = y @ m.T
        beta[:c, p] = b / b.sum(1, keepdims=True)
        joint = np.einsum("ci,cj->cij", alpha[:c, p], y) * m
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    both = alpha * beta
    total = both.sum(2, keepdims=True)
    return both / np.where(total > 0, total, 1), pairs


def marginals(e: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """As above for scoring, without the pair marginals."""
    n, t, k = e.shape
    m = np.exp(move)
    x = np.exp(e - e.max(axis=2, keepdims=True))
    alpha, beta = np.zeros_like(x), np.zeros_like(x)
    live = np.searchsorted(-length, -np.arange(t + 1), side="left")
    a = x[:, 0] * np.exp(start)
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for p in range(1, t):
        c = live[p]
        a = (alpha[:c, p - 1] @ m) * x[:c, p]
        alpha[:c, p] = a / a.sum(1, keepdims=True)
    beta[:, t - 1] = 1
    for p in range(t - 2, -1, -1):
        c = live[p + 1]
        b = (x[:c, p + 1] * beta[:c, p + 1]) @ m.T
        beta[:c, p] = b / b.sum(1, keepdims=True)
        beta[c : live[p], p] = 1
    both = alpha * beta
    total = both.sum(2, keepdims=True)
    return both / np.where(total > 0, total, 1)


class ChainModel:
    def __init__(self, languages: list[str], weights: np.ndarray, start: np.ndarray, move: np.ndarray, lexicon: set[str]):
        self.languages, self.weights, self.start, self.move, self.lexicon = languages, weights, start, move, lexicon
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.empty((1024, max(1, len(self.languages))), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "scores")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = sorted(set(words) - self.number.keys())
        if len(self.number) + len(new) > CACHE and self.number:
            self.forget()
            new = sorted(set(words))
        if new:
            at = len(self.number)
            self.number.update(zip(new, range(at, at + len(new))))
            features = [word_features(w, self.lexicon) for w in new]
            sizes = np.fromiter(map(len, features), np.int64, len(features))
            flat = np.fromiter(itertools.chain.from_iterable(features), np.int64, int(sizes.sum()))
            while at + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[at : at + len(new)] = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        words: list[str] = []
        owner, length = [], []
        for d, text in enumerate(texts):
            for line in (text or "").lower().split("\n"):
                found = words_of(line)
                words += found
                for k in range(0, len(found), LONGEST):
                    owner.append(d)
                    length.append(min(LONGEST, len(found) - k))
        mass = np.zeros((len(texts), len(self.languages)))
        size, whose = np.array(length, np.int64), np.array(owner, np.int64)
        begin = np.cumsum(size) - size
        ids = self._numbers(words)
        order = np.argsort(-size, kind="stable")
        at = 0
        while at < len(order):  # chains of like length together, so that little is padded
            t = int(size[order[at]])
            part = order[at : at + max(64, 32_768 // t)]
            part = part[size[part] * 2 >= t]
            at += len(part)
            places = begin[part, None] + np.minimum(np.arange(t), size[part, None] - 1)
            p = marginals(self.scores[ids[places]].astype(np.float64), size[part], self.start, self.move)
            p *= (np.arange(t) < size[part, None])[:, :, None]
            np.add.at(mass, whose[part], p.sum(1))
        count = mass.sum(1)
        best = mass.argmax(1)
        return [(self.languages[b], float(min(1.0, m[b] / c))) if c > 0.5 else (UNKNOWN, 0.0) for m, c, b in zip(mass, count, best)]


def fit(stretches: list[tuple[str, list[str]]]) -> ChainModel:
    """stretches: (language, words) cut from documents, in a fixed order."""
    languages = sorted({s[0] for s in stretches})
    k = len(languages)
    if not k:
        return ChainModel([], np.zeros((FEATURES, 1)), np.zeros(1), np.zeros((1, 1)), set())
    state = {x: i for i, x in enumerate(languages)}
    seen = Counter(w for _, ws in stretches for w in ws)
    lexicon = {w for w, c in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if c >= LEAST}
    names = sorted(seen)
    number = {w: i for i, w in enumerate(names)}
    feats = [word_features(w, lexicon) for w in names]
    sizes = np.array([len(f) for f in feats])
    flat, base = np.concatenate(feats), np.cumsum(sizes) - sizes
    rng = np.random.default_rng(17)
    weights, start, move = np.zeros((FEATURES, k)), np.zeros(k), np.zeros((k, k))
    moments = [np.zeros_like(p) for p in (weights, start, move) for _ in (0, 1)]
    for step in range(1, STEPS + 1):
        chains = []
        for i in rng.integers(0, len(stretches), BATCH):
            parts = [stretches[i]] + ([stretches[j] for j in rng.integers(0, len(stretches), 1)] if rng.random() < 0.5 else [])
            chains.append(([number[w] for _, ws in parts for w in ws], [state[s] for s, ws in parts for _ in ws]))
        chains.sort(key=lambda c: -len(c[0]))
        length = np.array([len(c[0]) for c in chains])
        t = int(length[0])
        ids = np.array([c[0] + [0] * (t - len(c[0])) for c in chains])
        gold = np.array([c[1] + [0] * (t - len(c[1])) for c in chains])
        mask = np.arange(t) < length[:, None]
        used, inverse = np.unique(ids[mask], return_inverse=True)
        own = np.concatenate([np.arange(base[w], base[w] + sizes[w]) for w in used])
        of = np.repeat(np.arange(len(used)), sizes[used])
        score = np.zeros((len(used), k))
        np.add.at(score, of, weights[flat[own]])
        e = np.zeros((*ids.shape, k))
        e[mask] = score[inverse]
        p, pairs = forward_backward(e, length, start, move)
        diff = p[mask]
        diff[np.arange(len(diff)), gold[mask]] -= 1
        by_word = np.zeros((len(used), k))
        np.add.at(by_word, inverse, diff)
        n = mask.sum()
        g_weights = np.zeros_like(weights)
        np.add.at(g_weights, flat[own], by_word[of])
        true = np.zeros((k, k))
        ok = mask[:, 1:]
        np.add.at(true, (gold[:, :-1][ok], gold[:, 1:][ok]), 1)
        g_start = p[:, 0].sum(0) - np.bincount(gold[:, 0], minlength=k)
        for q, (param, g) in enumerate(((weights, g_weights / n + PENALTY * weights), (start, g_start / n), (move, (pairs - true) / n))):
            m1, m2 = moments[2 * q], moments[2 * q + 1]
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            param -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return ChainModel(languages, weights, start, move, lexicon)


def fit_on_documents(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ChainModel:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).filter(usable)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([])
    scale, wanted = 1 << 30, max(LEAST_SAMPLE, sample / len(counts))
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, wanted / n) * scale))])
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(47)), F.lit(scale)) < F.element_at(shares, F.col("lang")))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                words = words_of(text.lower())
                for k, a in enumerate(np.unique(np.linspace(0, max(0, len(words) - STRETCH), SEGMENTS).astype(int))):
                    if words:
                        out.append((i, k, lang, words[a : a + STRETCH]))
            yield pd.DataFrame(out, columns=["doc_id", "k", "lang", "words"])
        release_memory()

    found = picked.mapInPandas(run, "doc_id long, k int, lang string, words array<string>").toPandas()
    found = found.assign(key=found["words"].map(lambda w: " ".join(w))).sort_values(["doc_id", "k", "lang", "key"])
    return fit([(lang, list(words)) for lang, words in zip(found["lang"], found["words"])])


def predict(text: Column, model: ChainModel) -> Column:
    """struct<lang: string, score: double> of each text."""

    def batch(texts: pd.Series) -> pd.DataFrame:
        said: list[tuple[str, float]] = []
        held, size = [], 0
        for t in texts.tolist():
            held.append(t)
            size += len(t or "")
            if size > 1 << 20:
                said += model.predict(held)
                held, size = [], 0
        said += model.predict(held) if held else []
        return pd.DataFrame(said, columns=["lang", "score"])

    @F.pandas_udf("lang string, score double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            only_cache(model)
            yield batch(texts)
        model.forget()
        for strings in (_prefix, _suffix, _gram):
            strings.clear()
        release_memory()

    return run(text)
