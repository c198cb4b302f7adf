"""Byte-pair encoding and decoding by batched merge rounds (operator 1).

Distinct words of a batch are laid out as byte symbols in one flat array.  Each
round looks every adjacent pair up by binary search in the sorted array of pair
keys, takes the lowest rank of each word and merges all its occurrences from
the left; finished words leave the array.  A worker keeps the ids of words it
has seen in a dictionary of bounded size.

Columns: ``encode`` and ``decode`` are column functions, so other columns of a
table, whatever their names, are left alone.  Null and empty texts encode to no
ids; null or empty ids decode to an empty text.  Special tokens of the
vocabulary are recognised in the text, as the tokenizers library does by
default.  A word of any length is merged whole.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.llm.common import only_cache, release_memory

#: Split of byte-level vocabularies (fixed values of the public format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters and ids that a worker remembers, in bytes: two generations of at most so many each.
CACHE_BYTES = 40 << 20
#: What a remembered word takes besides its characters and ids.
WORD_BYTES = 180
#: The same split for texts of Latin characters, where the standard library's classes do, and is faster.
LETTERS, NUMBERS, BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_SPLIT = rf""" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"""
#: Finds what is no Latin text; information separators are left to the general split.
not_latin = re.compile("[^\x00-\x1b\x20-\u024f]").search
NO_RANK = np.int64(1) << np.int64(40)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class WordCache:
    """Ids of words seen lately; bounded in bytes, and the words in use survive."""

    def __init__(self, learn, bound: int = CACHE_BYTES):
        self.learn, self.bound = learn, bound
        self.forget()

    def forget(self) -> None:
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0

    def need(self, words: set[str]) -> dict[str, bytes]:
        """A dictionary that holds all these words."""
        only_cache(self)
        missing = words - self.now.keys()
        if self.size > self.bound and missing:
            self.before, self.now, self.size, missing = self.now, {}, 0, words
        known = missing & self.before.keys() if self.before else ()
        for w in known:
            self.now[w] = ids = self.before[w]
            self.size += len(w) + len(ids) + WORD_BYTES
        new = list(missing - known if known else missing)
        for k in range(0, len(new), 16_384):
            part = new[k : k + 16_384]
            learned = self.learn(part)
            self.size += sum(map(len, part)) + sum(map(len, learned)) + WORD_BYTES * len(part)
            self.now.update(zip(part, learned))
        return self.now


class BytePairModel:
    """Tables of one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {s: b for b, s in enumerate(symbols)}
        size = 1 + max([*vocab.values(), *added.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *added.items()]:
            known = all(c in back for c in token)
            self.token_bytes[i] = bytes(back[c] for c in token) if known else token.encode()
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.find_added = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.any_words, self.latin_words = regex.compile(SPLIT).findall, re.compile(LATIN_SPLIT).findall
        self.cache = WordCache(lambda words: self.merge_rounds([w.encode("utf-8", "surrogatepass") for w in words]))

    def words(self, text: str) -> list[str]:
        return self.any_words(text) if not_latin(text) else self.latin_words(text)

    def merge_rounds(self, words: list[bytes]) -> list[bytes]:
        """The ids of non-empty words, each as little-endian 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        pair, rank, made = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        fresh = np.arange(len(ids))  # places whose pair is yet to be looked up
        done_ids, done_owner = [], []
        while len(ids):
            after = np.minimum(fresh + 1, len(ids) - 1)
            key = (ids[fresh] << 32) | ids[after]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (owner[fresh] == owner[after]) & (after > fresh)
            pair[fresh], made[fresh] = key, self.made[at]
            rank[fresh] = np.where(known, self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(best, np.diff(np.r_[starts, len(ids)]))
            gone = lowest == NO_RANK
            if gone.any():
                done_ids.append(ids[gone])
                done_owner.append(owner[gone])
            # of overlapping pairs of one symbol every second goes, from the left
            hit = np.flatnonzero((rank == lowest) & ~gone)
            if len(hit):
                run = np.r_[True, np.diff(hit) != 1]
                first = hit[np.flatnonzero(run)][np.cumsum(run) - 1]
                same = np.r_[False, pair[hit[1:]] == pair[hit[:-1]]] | run
                hit = hit[~(((hit - first) % 2 == 1) & same)]
            ids[hit] = made[hit]
            gone[hit + 1] = True
            keep = ~gone
            moved = np.cumsum(keep) - 1
            ids, owner, pair, rank, made = ids[keep], owner[keep], pair[keep], rank[keep], made[keep]
            fresh = moved[hit]
            fresh = np.unique(np.r_[fresh, fresh[fresh > 0] - 1])
        flat, by = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(by, kind="stable")
        data = flat[order].astype("<u4").tobytes()
        cut = np.r_[0, np.cumsum(np.bincount(by, minlength=len(words)))] * 4
        return [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0

        def flush() -> None:
            get = self.cache.need(set().union(*group)).__getitem__
            out.extend(b"".join(map(get, words)) for words in group)
            group.clear()

        for text in texts:
            if self.find_added and self.find_added.search(text):
                if group:
                    flush()
                    size = 0
                out.append(self._encode_with_added(text))
                continue
            group.append(self.words(text))
            size += len(text)
            if size > 1 << 21:
                flush()
                size = 0
        if group:
            flush()
        return out

    def _encode_with_added(self, text: str) -> bytes:
        parts, at = [], 0
        for m in self.find_added.finditer(text):
            parts += [*self.encode_plain(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*parts, *self.encode_plain(text[at:])])

    def encode_plain(self, text: str) -> list[bytes]:
        words = self.words(text)
        return list(map(self.cache.need(set(words)).__getitem__, words))

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        """Texts of id sequences; bytes that are no UTF-8 become U+FFFD."""
        get = self.token_bytes.__getitem__
        return [b"".join(map(get, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in ids]


@functools.lru_cache(maxsize=4)
def model(path: str) -> BytePairModel:
    return BytePairModel(path)


def encode(text: Column, vocabulary: str) -> Column:
    """Ids of a text column as binary: little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series(model(vocabulary).encode_batch(texts.fillna("").tolist()), dtype=object)
        release_memory()

    return run(text)


def decode(ids: Column, vocabulary: str) -> Column:
    """Texts of a column that :func:`encode` made."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in it:
            yield pd.Series(model(vocabulary).decode_batch([x or b"" for x in column.tolist()]), dtype=object)

    return run(ids)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
