"""Removal of repeated byte strings through hash-compared suffix sorting (operator 5).

Every byte that lies in a string of ``WINDOW`` bytes which also starts earlier, in
the order of identifiers and offsets, is removed; all is judged on the input.

Any two equal windows have, at the same offset, an anchor: the smallest hash among
the window's grams.  So windows are compared only around anchors whose gram occurs
more than once:

1. The documents are stored once in chunk files.  Each chunk reports the distinct
   grams at its anchors; a window over (gram, chunk) keeps the repeated ones.
2. Each chunk reports its first anchor of each (gram, context), the context being
   all bytes that windows over the anchor can reach.  An anchor with an equal
   context earlier makes all its windows repeats.
3. First anchors whose gram has several contexts are compared as suffixes.  They
   are grouped by a core, the bytes that all windows of a range of offsets share;
   groups above ``HOT`` members are split into narrower ranges until a range is one
   window, so no task gets an unbounded group.  In a group the texts after the
   anchors are merge-sorted, comparing two suffixes by binary search for their
   common extension over prefix polynomial hashes; adjacent extensions give the
   classes of windows, with the hash of the bytes before the anchor.  Windows found
   equal are compared byte by byte, so a collision removes nothing.  What is removed
   without that, contexts that are equal as a whole and single windows of large groups,
   is told equal by a cryptographic hash of its bytes (128 bits for windows; for
   contexts 64 bits beside the 64 of the polynomial).
4. Each chunk takes the spans that concern it and cuts its documents.

Counts between the steps travel as narrow rows; texts are never shuffled.

Rows that repeat an identifier are ordered by a hash of their text and, where that
is equal too, by their place in the stored copy; null identifiers come last.  Null
texts are empty.  Texts shorter than a window lose nothing.  An empty table gives no
rows.  Other columns are kept by ``without_repeats`` and ignored by ``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm import rolling
from inkveil.llm.common import fresh_path, materialize, open_fs, part_files, release_memory

WINDOW, GRAM = 100, 32
REACH = WINDOW - GRAM  # bytes before an anchor that its windows reach
#: Members of a group of suffixes that one task sorts; larger ones are split.
HOT = 1000
#: Contexts that a task sorts together: whole groups.
POOL_ROWS = 10_000
BATCH_BYTES = 1 << 18
#: Documents of a chunk file at most, and bytes of text that it has on average at most.
CHUNK_ROWS, CHUNK_BYTES = 5_000, 32 << 20
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(f: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """f over every run of `width` neighbours."""
    step = 1
    while step * 2 <= width:
        a = f(a[:-step], a[step:])
        step *= 2
    rest = width - step
    return f(a[:-rest], a[rest:]) if rest else a


class Batch:
    """Some documents laid end to end."""

    def __init__(self, first_row: int, data: np.ndarray, cuts: np.ndarray):
        """data: bytes; cuts: where documents start in it, and the end."""
        self.first_row, self.data = first_row, data
        self.starts, self.ends = cuts[:-1].astype(np.int64), cuts[1:].astype(np.int64)
        self._prefix = None

    @classmethod
    def of(cls, texts: list[bytes]) -> Batch:
        return cls(0, np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)])

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = rolling.prefix(self.data)
        return self._prefix

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the anchors, their documents in the batch, and their gram hashes."""
        n = len(self.data)
        if n < WINDOW:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.arange(n - GRAM + 1)
        grams = rolling.mix(rolling.spans(self.prefix, at, at + GRAM))
        to_end = np.repeat(self.ends, self.ends - self.starts) - np.arange(n)
        grams[to_end[: len(grams)] < GRAM] = TOP
        lowest = _slide(np.minimum, grams, REACH + 1)
        lowest[to_end[: len(lowest)] < WINDOW] = 0
        edge = np.zeros(REACH, np.uint64)
        found = np.flatnonzero(_slide(np.maximum, np.r_[edge, lowest, edge], REACH + 1) == grams)
        return found, np.searchsorted(self.ends, found, side="right"), grams[found]


def _texts(column) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column]


def read_batches(path: str, columns: list[str]) -> Iterator[tuple[int, list]]:
    """(first row, columns) of a chunk file, in runs of about BATCH_BYTES of text."""
    import pyarrow.parquet as pq

    fs, name = open_fs(path)
    row = 0
    with fs.open_input_file(name) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=512, columns=columns):
            held = [c.to_pylist() for c in batch.columns]
            yield row, held
            row += batch.num_rows


def batches(path: str, text_col: str) -> Iterator[Batch]:
    """The documents of a chunk file in batches of about BATCH_BYTES, off Arrow's buffers."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    fs, name = open_fs(path)
    row = 0
    with fs.open_input_file(name) as f:
        for records in pq.ParquetFile(f).iter_batches(batch_size=512, columns=[text_col]):
            texts = records.column(0).cast(pa.large_binary()).fill_null(b"")
            _, places, data = texts.buffers()
            cuts = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            part = (cuts[1:] - cuts[0] - 1) // BATCH_BYTES
            edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for a, z in zip(edge[:-1], edge[1:]):
                if z > a:
                    yield Batch(row + a, flat[cuts[a] : cuts[z]], cuts[a : z + 1] - cuts[a])
            row += len(texts)


# -- suffix sorting ------------------------------------------------------------------


class Suffixes:
    """Contexts in a pool, each with an anchor; groups are consecutive."""

    def __init__(self, contexts: list[bytes], left: np.ndarray, group: np.ndarray):
        self.data = np.frombuffer(b"".join(contexts), np.uint8)
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        self.anchor = np.cumsum(sizes) - sizes + left
        self.left, self.right = left, sizes - left
        self.prefix = rolling.prefix(self.data)
        self.group = group
        self.n = len(contexts)
        new = np.r_[True, group[1:] != group[:-1]]
        first = np.flatnonzero(new)
        self.group_start = first[np.cumsum(new) - 1]
        self.group_end = np.r_[first[1:], self.n][np.cumsum(new) - 1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes, by binary search over hashes."""
        a, b = self.anchor[i], self.anchor[j]
        high = np.minimum(self.right[i], self.right[j])
        low = np.zeros_like(high)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            same = rolling.spans(self.prefix, a, a + mid) == rolling.spans(self.prefix, b, b + mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j (or with it)."""
        n = self.common(i, j)
        i_over, j_over = n == self.right[i], n == self.right[j]
        last = len(self.data) - 1
        x = self.data[np.minimum(self.anchor[i] + n, last)].astype(np.int16)
        y = self.data[np.minimum(self.anchor[j] + n, last)].astype(np.int16)
        return np.where(i_over & j_over, or_equal, np.where(i_over, True, np.where(j_over, False, x < y)))

    def sort(self) -> np.ndarray:
        """Members in suffix order within their groups: a merge sort of all groups at once."""
        order = np.arange(self.n)
        place = np.arange(self.n) - self.group_start
        size = self.group_end - self.group_start
        width = 1
        while (size > width).any():
            block = place // width
            mate = self.group_start + (block ^ 1) * width
            low = np.minimum(mate, self.group_end)
            end = np.minimum(mate + width, self.group_end)
            base, high = low.copy(), end
            from_right = (block & 1) == 1
            live = np.flatnonzero(low < high)
            while len(live):
                mid = (low[live] + high[live]) >> 1
                # a left element passes right ones that sort before it, a right one also equal left ones
                passes = self.before(order[mid], order[live], from_right[live])
                low[live] = np.where(passes, mid + 1, low[live])
                high[live] = np.where(passes, high[live], mid)
                live = live[low[live] < high[live]]
            target = self.group_start + (block // 2) * 2 * width + (place - block * width) + (low - base)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order


def repeated_windows(contexts: list[bytes], left: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, offset) of windows that an earlier member of the group has too.

    Members of a group come in order of their place in the corpus.  The window of
    offset l starts l bytes before the anchor; a member's offsets are low..high.
    """
    s = Suffixes(contexts, left, group)
    order = s.sort()
    step = np.zeros(s.n, np.int64)
    if s.n > 1:
        step[1:] = s.common(order[:-1], order[1:])
    step[s.group_start == np.arange(s.n)] = -1  # sorted places are within groups, so these start one
    # the longest extension that a member shares with another: narrower ones are alone with their windows
    most = np.empty(s.n, np.int64)
    most[order] = np.maximum(step, np.r_[step[1:], -1])
    low, high = np.maximum(low, WINDOW - most), np.minimum(high, s.left)
    live = np.flatnonzero(low <= high)
    if len(live) < 2:
        return EMPTY
    rank = np.empty(s.n, np.int64)
    rank[order] = np.arange(s.n)
    bytes_at = np.lib.stride_tricks.sliding_window_view(s.data, WINDOW)  # rows of it are copied whole; WINDOW is a multiple of 4
    members, offsets = [], []
    for offset in range(int(low[live].min()), int(high[live].max()) + 1):
        m = live[(low[live] <= offset) & (offset <= high[live])]
        if len(m) < 2:
            continue
        kind = np.cumsum(step < WINDOW - offset)[rank[m]]
        before = rolling.spans(s.prefix, s.anchor[m] - offset, s.anchor[m])
        key = rolling.mix(before + rolling.mix(kind.astype(np.uint64)))
        by = np.argsort(key, kind="stable")
        run = np.r_[True, key[by][1:] != key[by][:-1]]
        first = by[np.flatnonzero(run)][np.cumsum(run) - 1]
        again, origin = m[by[~run]], m[first[~run]]
        if not len(again):
            continue
        a, o = s.anchor[again] - offset, s.anchor[origin] - offset
        equal = np.concatenate([(bytes_at[a[k : k + 8192]].view(np.uint32) == bytes_at[o[k : k + 8192]].view(np.uint32)).all(axis=1) for k in range(0, len(a), 8192)])
        if not equal.all():
            equal = _by_bytes(s, m[by], offset, run)
        members.append(again[equal])
        offsets.append(np.full(int(equal.sum()), offset))
    if not members:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(members), np.concatenate(offsets)


def _by_bytes(s: Suffixes, m: np.ndarray, offset: int, run: np.ndarray) -> np.ndarray:
    """After a collision: the same decision from the windows' bytes themselves."""
    seen: set[tuple[int, bytes]] = set()
    out = np.zeros(len(m), bool)
    for k in np.lexsort((m,)):
        at = s.anchor[m[k]] - offset
        window = (int(s.group[m[k]]), s.data[at : at + WINDOW].tobytes())
        out[k] = window in seen
        seen.add(window)
    return out[~run]


def _intervals(member: np.ndarray, offset: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of adjacent windows of a member as (member, start, end) of bytes."""
    order = np.lexsort((offset, member))
    m, o = member[order], offset[order]
    new = np.r_[True, (m[1:] != m[:-1]) | (o[1:] != o[:-1] + 1)] if len(m) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(m)] - 1 if len(first) else first
    return m[first], place[m[first]] - o[last], place[m[first]] - o[first] + WINDOW


# -- the distributed steps -------------------------------------------------------------


class Corpus:
    """The stored copy: chunk files, the order of its rows, and how places are packed."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str):
        self.spark: SparkSession = df.sparkSession
        self.text_col, self.id_col = text_col, id_col
        path = fresh_path(self.spark, "repeat-texts")
        size = F.octet_length(text_col).cast("long")
        mean = df.agg((F.sum(size) / F.greatest(F.count("*"), F.lit(1))).alias("m")).first()["m"] or 1
        df.write.option("maxRecordsPerFile", max(1, min(CHUNK_ROWS, int(CHUNK_BYTES / mean)))).parquet(path)
        self.files = part_files(self.spark, path)
        self.schema = df.schema
        stored = self.spark.read.schema(df.schema).parquet(path)
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        numbers = {f.rsplit("/", 1)[1]: k for k, f in enumerate(self.files)}  # one entry a file
        chunk_of = self.spark.createDataFrame([(f, k) for f, k in numbers.items()], "file string, chunk int")
        rows = stored.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("tie"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size"), name.alias("file"), F.col("_metadata.row_index").alias("row"))
        rows = rows.join(F.broadcast(chunk_of), "file").drop("file")
        by = [F.col("i").asc_nulls_last(), "tie", "chunk", "row"]
        rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
        low = F.lit((1 << 33) - 1)
        rows = materialize(rows.select("chunk", "row", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(low).alias("at")), "row-order")
        parts = {r["part"]: (r["n"], r["m"]) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.max("size").alias("m")).collect()}
        base, total = {}, 0
        for p in sorted(parts):
            base[p], total = total, total + parts[p][0]
        self.place_bits = max([1, *(m.bit_length() + 1 for _, m in parts.values())])
        if total.bit_length() + self.place_bits > 62:
            raise ValueError("places of this corpus do not fit 62 bits")
        bases = self.spark.createDataFrame(list(base.items()) or [(0, 0)], "part int, base long")
        # (chunk, kind, x, y): kind 1 says that row x of the chunk is document y of the order
        self.rows = materialize(rows.join(F.broadcast(bases), "part").select("chunk", F.lit(1).alias("kind"), F.col("row").alias("x"), (F.col("base") + F.col("at")).alias("y")), "row-numbers")

    def over_chunks(self, notes: list[DataFrame], work: Callable, schema: str) -> DataFrame:
        """Runs work(chunk, notes by kind) for every chunk that has rows."""
        incoming = self.rows
        for n in notes:
            incoming = incoming.unionByName(n)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            by = {k: (g["x"].to_numpy(), g["y"].to_numpy()) for k, g in pdf.groupby("kind")}
            row, number = by[1]
            order = np.empty(len(row), np.int64)
            order[row] = number
            out = work(int(pdf["chunk"].iloc[0]), order, by)
            release_memory()
            return out

        return incoming.repartition(max(1, len(self.files)), "chunk").groupBy("chunk").applyInPandas(run, schema)


EMPTY = (np.empty(0, np.int64), np.empty(0, np.int64))


def _repeated_grams(corpus: Corpus) -> DataFrame:
    files, text_col = corpus.files, corpus.text_col

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for chunk in pdf["id"].tolist():
                grams = [b.anchors()[2] for b in batches(files[chunk], text_col)]
                if grams:
                    key, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pd.DataFrame({"gram": key.view(np.int64), "chunk": np.int32(chunk), "many": n > 1})
        release_memory()

    n = max(1, len(files))
    # a gram has a row for each chunk at most
    by_gram = Window.partitionBy("gram")
    seen = corpus.spark.range(0, len(files), 1, n).mapInPandas(run, "gram long, chunk int, many boolean")
    seen = seen.withColumn("n", F.sum(F.when(F.col("many"), 2).otherwise(1)).over(by_gram)).filter("n > 1")
    return materialize(seen.select("chunk", F.lit(0).alias("kind"), F.col("gram").alias("x"), F.lit(0).cast("long").alias("y")), "repeated-grams")


def _contexts(b: Batch, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each anchor's context: a polynomial, and a cryptographic one that confirms it."""
    low = np.maximum(at - REACH, b.starts[doc])
    high = np.minimum(at + WINDOW, b.ends[doc])
    shape = rolling.mix(((at - low) * 256 + (high - at)).astype(np.uint64))
    view = memoryview(np.ascontiguousarray(b.data))
    proof = b"".join([hashlib.blake2b(view[a:z], digest_size=8).digest() for a, z in zip(low.tolist(), high.tolist())])
    return rolling.mix(rolling.spans(b.prefix, low, high) + shape), np.frombuffer(proof, np.int64)


def _anchors(corpus: Corpus, grams: DataFrame) -> DataFrame:
    """The chunks' first anchors of each gram and context, and all later ones."""
    files, bits, text_col = corpus.files, corpus.place_bits, corpus.text_col

    def work(chunk: int, order: np.ndarray, notes: dict) -> pd.DataFrame:
        wanted = np.sort(notes.get(0, EMPTY)[0].view(np.uint64))
        found = []
        for b in batches(files[chunk], text_col) if len(wanted) else ():
            at, doc, gram = b.anchors()
            hit = wanted[np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)] == gram
            at, doc, gram = at[hit], doc[hit], gram[hit]
            place = (order[b.first_row + doc] << bits) | (at - b.starts[doc])
            context, proof = _contexts(b, at, doc)
            found.append((gram.view(np.int64), context.view(np.int64), proof, place))
        if not found:
            return pd.DataFrame({"gram": [], "context": [], "proof": [], "place": [], "chunk": [], "first": []})
        gram, context, proof, place = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((place, proof, context, gram))
        gram, context, proof, place = gram[by], context[by], proof[by], place[by]
        first = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]) | (proof[1:] != proof[:-1])] if len(gram) else np.empty(0, bool)
        return pd.DataFrame({"gram": gram, "context": context, "proof": proof, "place": place, "chunk": np.int32(chunk), "first": first})

    anchors = corpus.over_chunks([grams], work, "gram long, context long, proof long, place long, chunk int, first boolean")
    return materialize(anchors, "anchors")


def _note(df: DataFrame, kind: int, x: str, y: str) -> DataFrame:
    return df.select("chunk", F.lit(kind).alias("kind"), F.col(x).alias("x"), F.col(y).alias("y"))


class _Fetch:
    """Contexts around noted places of a chunk."""

    def __init__(self, path: str, text_col: str, order: np.ndarray, bits: int, place: np.ndarray):
        by_number = np.argsort(order, kind="stable")
        rows = by_number[np.searchsorted(order, place >> bits, sorter=by_number)]
        within = (place & ((1 << bits) - 1)).tolist()
        self.left, self.contexts = np.zeros(len(place), np.int64), [b""] * len(place)
        by = np.argsort(rows, kind="stable")
        sorted_rows = rows[by]
        for b in batches(path, text_col):
            a, z = np.searchsorted(sorted_rows, [b.first_row, b.first_row + len(b.starts)])
            flat = b.data.tobytes() if z > a else b""
            for k in by[a:z].tolist():
                doc, at = rows[k] - b.first_row, within[k]
                start, low = b.starts[doc], max(0, at - REACH)
                self.left[k] = at - low
                self.contexts[k] = flat[start + low : min(start + at + WINDOW, b.ends[doc])]

    def cores(self, k: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the places k those whose windows of a range fit, with two numbers of what these share.

        The core of a wider range is hashed once: contexts that meet by a collision are
        told apart when windows are compared.  A single window is hashed to 128 bits.
        """
        kept, one, two = [], [], []
        salt = rolling.mix(np.array([low * 256 + high + 1], np.uint64))
        for part in (k[j : j + 4096] for j in range(0, len(k), 4096)):
            texts = [self.contexts[j] for j in part.tolist()]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            base = np.cumsum(size) - size
            start, end = self.left[part] - low, self.left[part] + WINDOW - high
            ok = (start >= 0) & (end <= size)
            start, end = (base + start)[ok], (base + end)[ok]
            kept.append(part[ok])
            data = b"".join(texts)
            if low == high:
                pairs = [hashlib.blake2b(data[a:z], digest_size=16, salt=bytes([low])).digest() for a, z in zip(start.tolist(), end.tolist())]
                numbers = np.frombuffer(b"".join(pairs), np.int64).reshape(-1, 2)
                one.append(numbers[:, 0])
                two.append(numbers[:, 1])
            else:
                prefix = rolling.prefix(np.frombuffer(data, np.uint8))
                one.append(rolling.mix(rolling.spans(prefix, start, end) ^ salt).view(np.int64))
                two.append(np.zeros(len(start), np.int64))
        return (np.concatenate(kept), np.concatenate(one), np.concatenate(two)) if kept else (k, EMPTY[0], EMPTY[0])


def _split(low: int, high: int, ways: int) -> list[tuple[int, int]]:
    cuts = np.unique(np.linspace(low, high + 1, ways + 1).astype(int))
    return [(int(a), int(b) - 1) for a, b in zip(cuts[:-1], cuts[1:])]


def _cores(corpus: Corpus, members: DataFrame, ways: int) -> DataFrame:
    """(chunk, place, low, high, core): members (chunk, place, range) in narrower ranges."""
    files, bits, text_col = corpus.files, corpus.place_bits, corpus.text_col
    shape = "chunk int, place long, low int, high int, core long, tail long"

    def work(chunk: int, order: np.ndarray, notes: dict) -> pd.DataFrame:
        place, reach = notes.get(2, EMPTY)
        if not len(place):
            return pd.DataFrame({c: [] for c in ("chunk", "place", "low", "high", "core", "tail")})
        fetch = _Fetch(files[chunk], text_col, order, bits, place)
        out = []
        for r in np.unique(reach).tolist():
            own = np.flatnonzero(reach == r)
            for a, b in _split(r >> 8, r & 255, ways):
                k, core, tail = fetch.cores(own, a, b)
                out.append(pd.DataFrame({"chunk": np.int32(chunk), "place": place[k], "low": np.int32(a), "high": np.int32(b), "core": core, "tail": tail}))
        return pd.concat(out)

    return materialize(corpus.over_chunks([_note(members, 2, "place", "range")], work, shape), "cores")


def _compared(corpus: Corpus, members: DataFrame) -> DataFrame:
    """(chunk, number, start, end) of repeats among first anchors with several contexts."""
    spark, files, bits, text_col = corpus.spark, corpus.files, corpus.place_bits, corpus.text_col
    whole = F.lit(0 << 8 | REACH).cast("long")
    waiting, ways, small, found = members.select("chunk", "place", whole.alias("range")), 2, [], []
    while True:
        cores = _cores(corpus, waiting, ways)
        keys = ["core", "tail"]
        counts = materialize(cores.groupBy(*keys).agg(F.count("*").alias("n"), F.min("place").alias("p0"), F.max("place").alias("p1")).filter("n > 1 and p0 <> p1"), "core-counts")
        cores = materialize(cores.join(counts.select(*keys, "n", "p0"), keys), "shared-cores")
        single = F.col("low") == F.col("high")
        # a range of one window: the core is the window, and all but the first are repeats
        place = F.col("place").bitwiseAND(F.lit((1 << bits) - 1))
        found.append(cores.filter(single & (F.col("n") > HOT) & (F.col("place") > F.col("p0"))).select("chunk", F.shiftright("place", bits).alias("number"), (place - F.col("low")).alias("start"), (place - F.col("low") + WINDOW).alias("end")))
        small.append(cores.filter(F.col("n") <= HOT).select("chunk", "place", "low", "high", *keys))
        hot = cores.filter((F.col("n") > HOT) & ~single)
        if hot.isEmpty():
            break
        waiting, ways = hot.select("chunk", "place", (F.col("low") * 256 + F.col("high")).cast("long").alias("range")), 6
    groups = small[0]
    for s in small[1:]:
        groups = groups.unionByName(s)
    notes = groups.select("chunk", F.lit(3).alias("kind"), F.col("place").alias("x"), (F.col("low") * 256 + F.col("high")).cast("long").alias("y")).distinct()

    def fetch(chunk: int, order: np.ndarray, notes: dict) -> pd.DataFrame:
        place, reach = notes.get(3, EMPTY)
        if not len(place):
            return pd.DataFrame({c: [] for c in ("chunk", "place", "low", "high", "core", "tail", "left", "context")})
        got = _Fetch(files[chunk], text_col, order, bits, place)
        out = []
        for r in np.unique(reach).tolist():
            a, b = r >> 8, r & 255
            k, core, tail = got.cores(np.flatnonzero(reach == r), a, b)
            low = np.maximum(0, got.left[k] - b)
            texts = [got.contexts[j][c : e + WINDOW - a] for j, c, e in zip(k.tolist(), low.tolist(), got.left[k].tolist())]
            out.append(pd.DataFrame({"chunk": np.int32(chunk), "place": place[k], "low": np.int32(a), "high": np.int32(b), "core": core, "tail": tail, "left": (got.left[k] - low).astype(np.int32), "context": texts}))
        return pd.concat(out)

    pool = corpus.over_chunks([notes], fetch, "chunk int, place long, low int, high int, core long, tail long, left int, context binary")

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in it:
            held.append(pdf)
            if sum(map(len, held)) < POOL_ROWS:
                continue
            pdf, held = pd.concat(held, ignore_index=True), []
            core, tail = pdf["core"].to_numpy(), pdf["tail"].to_numpy()
            cut = np.flatnonzero((core[1:] != core[:-1]) | (tail[1:] != tail[:-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            held.append(pdf.iloc[cut:])
            if cut:
                yield _solve(pdf.iloc[:cut], bits)
        if sum(map(len, held)):
            yield _solve(pd.concat(held, ignore_index=True), bits)
        release_memory()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    solved = pool.repartition(parts, "core", "tail").sortWithinPartitions("core", "tail", "place").mapInPandas(solve, "chunk int, number long, start long, end long")
    found.append(solved)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _solve(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    core, tail = pdf["core"].to_numpy(), pdf["tail"].to_numpy()
    group = np.cumsum(np.r_[True, (core[1:] != core[:-1]) | (tail[1:] != tail[:-1])])
    place = pdf["place"].to_numpy()
    m, o = repeated_windows(pdf["context"].tolist(), pdf["left"].to_numpy().astype(np.int64), group, pdf["low"].to_numpy(), pdf["high"].to_numpy())
    m, start, end = _intervals(m, o, place & ((1 << bits) - 1))
    return pd.DataFrame({"chunk": pdf["chunk"].to_numpy()[m], "number": place[m] >> bits, "start": start, "end": end})


def _spans(corpus: Corpus) -> DataFrame:
    """Notes for the chunks: repeated spans (kind 6) and anchors repeated with their context (kind 4)."""
    bits = corpus.place_bits
    anchors = _anchors(corpus, _repeated_grams(corpus))
    by_class = Window.partitionBy("gram", "context", "proof")  # a row for each chunk at most
    firsts = materialize(anchors.filter("first").withColumn("p0", F.min("place").over(by_class)), "first-anchors")
    later = anchors.filter("not first").select("chunk", "place").unionByName(firsts.filter("place > p0").select("chunk", "place"))
    origin = firsts.filter("place = p0")
    several = materialize(origin.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "several-contexts")
    members = materialize(origin.join(several, "gram").select("chunk", "place"), "members")
    compared = _compared(corpus, members)
    spans = compared.select("chunk", F.lit(6).alias("kind"), F.shiftleft("number", bits).bitwiseOR(F.col("start")).alias("x"), (F.col("end") - F.col("start")).alias("y"))
    return spans.unionByName(later.select("chunk", F.lit(4).alias("kind"), F.col("place").alias("x"), F.lit(0).cast("long").alias("y")))


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    if not len(starts):
        return [], text
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    gone = np.cumsum(step[:-1]) > 0
    edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
    spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
    return spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _cut_chunks(corpus: Corpus, columns: list[str], schema: str, emit: Callable) -> DataFrame:
    files, bits, text_col = corpus.files, corpus.place_bits, corpus.text_col
    text_at = columns.index(text_col)

    def work(chunk: int, order: np.ndarray, notes: dict) -> pd.DataFrame:
        mask = (1 << bits) - 1
        places, sizes = notes.get(6, EMPTY)
        anchors = notes.get(4, EMPTY)[0]
        number = np.r_[places >> bits, anchors >> bits]
        start = np.r_[places & mask, np.maximum(0, (anchors & mask) - REACH)]
        end = np.r_[(places & mask) + sizes, (anchors & mask) + WINDOW]
        whole = np.r_[np.ones(len(places), bool), np.zeros(len(anchors), bool)]
        by = np.argsort(number, kind="stable")
        number, start, end, whole = number[by], start[by], end[by], whole[by]
        out = []
        for first, held in read_batches(files[chunk], columns):
            for k, text in enumerate(_texts(held[text_at])):
                a, z = np.searchsorted(number, [order[first + k], order[first + k] + 1])
                e = np.minimum(end[a:z], len(text))
                s = start[a:z]
                ok = whole[a:z] | (e - s >= WINDOW)
                spans, kept = _cut(text, s[ok], e[ok])
                out.append(emit([c[k] for c in held], text, spans, kept))
        return out

    return corpus.over_chunks([_spans(corpus)], lambda chunk, order, notes: _frame(work(chunk, order, notes), schema), schema)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end), kept (binary) of every document."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary"

    def emit(row: list, text: bytes, spans: list, kept: bytes) -> tuple:
        return row[0], len(text), len(text) - len(kept), [list(s) for s in spans], kept

    return _cut_chunks(Corpus(rows, "doc_id", "text"), ["doc_id", "text"], schema, emit)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with repeated bytes taken out of its texts; texts that lose all go.

    Where a cut goes through a character, what is left of it is no UTF-8 and goes too.
    """
    names = df.columns
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    i, t = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", gone boolean"
    at = names.index(text_col)

    def emit(row: list, text: bytes, spans: list, kept: bytes) -> tuple:
        if spans:
            row[at] = kept.decode("utf-8", "ignore")
        return (*row, bool(spans) and not row[at].strip())

    out = _cut_chunks(Corpus(plain, i, t), plain.columns, schema, emit)
    return out.filter("not gone").drop("gone").toDF(*names)
