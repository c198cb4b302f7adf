"""Token ids as binary shards that are sorted string tables (operator 3).

``write_shards`` tokenises whole texts with the tokenizers library, range-parts
the documents by identifier and writes one table a partition; ``ShardSet`` looks
documents up; ``read_back`` reads every shard as a DataFrame.  Every attempt of a task writes a file of its own
name and reports it, so a task that is run again after a loss overwrites nothing;
the driver lists the reported files in a manifest and removes all others.

Null and empty texts hold only the end id.  A null identifier sorts first.  Rows
that repeat an identifier are kept, in order of a hash of their text, and may stand
in several shards.  An empty table gives
no shard with entries and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.bpe import BLANKS, LETTERS, NUMBERS, WordCache, not_latin
from inkveil.llm.common import fresh_path, open_fs, release_memory
from inkveil.llm.sstable import Reader, Writer, id_key, key_id

#: Words of this vocabulary's texts in lower case (fixed values of the public format).
SPLIT = r"\p{L}+|\p{N}|'s|'t|'re|'ve|'m|'ll|'d|[^\s\p{L}\p{N}]+"
MANIFEST = "MANIFEST.json"
LATIN_SPLIT = rf"[{LETTERS}]+|[{NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^{BLANKS}{LETTERS}{NUMBERS}]+"
#: Characters beyond the basic plane that all tables class alike, as neither letter nor number.
PICTOGRAPHS = (0x1F300, 0x1F64F)


def _unsettled() -> str:
    """A character class of what tables of different age may class differently.

    That is all but Latin letters, Unicode 3.2's characters of the basic plane and the
    pictographs, for which tests hold the split against the library's, one by one.
    """
    new = [c for c in range(0x250, 0x10000) if unicodedata.ucd_3_2_0.category(chr(c)) == "Cn"]
    cut = [k for k in range(1, len(new)) if new[k] != new[k - 1] + 1]
    runs = [(new[a], new[z - 1]) for a, z in zip([0, *cut], [*cut, len(new)])]
    runs += [(0x10000, PICTOGRAPHS[0] - 1), (PICTOGRAPHS[1] + 1, 0x10FFFF)]
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in runs)


class WordTokenizer:
    """The library's tokenizer, asked once for each distinct word.

    A text that is normalised already, lower-cases letter by letter and has no character
    that tables may class differently is cut into words here; any other goes to the
    library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.cache = WordCache(self._words)
        self.any_words, self.latin_words = regex.compile(SPLIT).findall, re.compile(LATIN_SPLIT).findall
        # added tokens; and sigma has two small forms, and a dotted I becomes two characters
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()], "\u03a3\u0130"
        self.unsettled = re.compile(f"[{_unsettled()}]").search
        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Whether an id ends a word; None where the vocabulary does not mark that.
        self.ends = None
        if suffix and not any(re.search(r"\s", t) for t in self.special[0]):
            self.ends = np.zeros(1 + max(vocab.values()), bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, which the library gets as one text: a call a word costs more than its merges."""
        if self.ends is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(words) > 0 and cut[-1] == len(ids):
                data, at = ids.tobytes(), (np.r_[0, cut] * ids.itemsize).tolist()
                return [data[a:z] for a, z in zip(at, at[1:])]
        return self._library(words)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def _for_library(self, text: str) -> bool:
        marks, letters = self.special
        if any(m in text for m in marks):
            return True
        if text.isascii():
            return False
        return any(c in text for c in letters) or not unicodedata.is_normalized("NFC", text) or bool(not_latin(text) and self.unsettled(text))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            if self._for_library(text):
                out[k] = self._library([text])[0]
            else:
                low = text.lower()
                cut.append((k, self.any_words(low) if not_latin(low) else self.latin_words(low)))
        get = self.cache.need(set().union(*(w for _, w in cut))).__getitem__
        for k, words in cut:
            out[k] = b"".join(map(get, words))
        return out


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _blocks(it: Iterator[pd.DataFrame], chars: int = 1 << 22) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for pdf in it:
        for i, text in zip(pdf["id"].tolist(), pdf["text"].fillna("").tolist()):
            ids.append(None if i is None or i != i else int(i))
            texts.append(text)
            size += len(text)
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_shards(df: DataFrame, out: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> list[tuple[str, int, int]]:
    """Writes the shards; returns (file, documents, ids) of each, in order of identifiers."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], t.kind).tobytes()
        width = struct.pack("B", t.kind.itemsize)
        fs, folder = open_fs(out)
        fs.create_dir(folder, recursive=True)
        name = f"shard-{part:06d}-{uuid.uuid4().hex}.sst"
        last, ordinal, docs, total = object(), 0, 0, 0
        with fs.open_output_stream(f"{folder}/{name}") as stream:
            table = Writer(stream)
            for ids, texts in _blocks(it):
                for i, value in zip(ids, t.encode_batch(texts)):
                    ordinal = ordinal + 1 if i == last else 0
                    n = (len(value) + len(end)) // t.kind.itemsize
                    table.add(id_key(i, ordinal), width + value + end, n)
                    last, docs, total = i, docs + 1, total + n
            table.close()
        release_memory()
        if docs:
            yield pd.DataFrame({"part": [part], "path": [name], "docs": [docs], "ids": [total]})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    made = rows.mapInPandas(run, "part int, path string, docs long, ids long").collect()  # a row a shard
    shards = [(r["path"], r["docs"], r["ids"]) for r in sorted(made, key=lambda r: r["part"])]
    fs, folder = open_fs(out)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/{MANIFEST}") as stream:
        stream.write(json.dumps(shards).encode())
    known = {name for name, _, _ in shards}
    for f in fs.get_file_info(FileSelector(folder)):
        if f.base_name.endswith(".sst") and f.base_name not in known:  # of attempts that were lost
            fs.delete_file(f.path)
    return shards


def manifest(out: str) -> list[tuple[str, int, int]]:
    """(file, documents, ids) of the shards of a folder, in order."""
    fs, folder = open_fs(out)
    with fs.open_input_file(f"{folder}/{MANIFEST}") as file:
        return [tuple(x) for x in json.loads(file.read())]


class ShardSet:
    """Lookup by identifier over the shards of a folder."""

    def __init__(self, out: str, shards: list[tuple[str, int, int]] | None = None):
        fs, folder = open_fs(out)
        self.tables = [Reader(fs.open_input_file(f"{folder}/{name}")) for name, _, _ in (manifest(out) if shards is None else shards)]

    def get(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        """The ids of a document; rows that repeat an identifier are counted over all shards."""
        for t in self.tables:
            if t.keys and t.keys[0] <= id_key(doc_id, ordinal):
                value = t.get(id_key(doc_id, ordinal))
                if value is not None:
                    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")
                while ordinal and t.get(id_key(doc_id)) is not None:  # as many as this shard has are passed
                    low, high = 1, ordinal
                    while low < high:
                        mid = (low + high) // 2
                        low, high = (low, mid) if t.get(id_key(doc_id, mid)) is None else (mid + 1, high)
                    ordinal -= low
                    break
        return None


def read_back(spark: SparkSession, out: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids of every stored document."""
    starts = np.r_[0, np.cumsum([n for _, _, n in shards])].tolist()
    places = [(name, start) for (name, _, _), start in zip(shards, starts)]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = open_fs(out)
        for pdf in it:
            for k in pdf["id"].tolist():
                name, start = places[k]
                rows, held = [], 0
                with fs.open_input_file(f"{folder}/{name}") as file:
                    for key, value in Reader(file):
                        ids = np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4").tobytes()
                        rows.append((key_id(key), start, len(ids) // 4, ids))
                        start, held = start + len(ids) // 4, held + len(ids)
                        if held > 1 << 23:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)
        release_memory()

    n = len(places)
    return spark.range(0, n, 1, max(1, n)).mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    return pdf


def shard_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "token-shards")
