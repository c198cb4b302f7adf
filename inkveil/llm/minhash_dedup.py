"""Near-duplicate documents by MinHash with odd sketches (operator 8).

A document's set is its distinct shingles of ``words`` words.  Documents with
equal sets form a class at once.  Classes meet in buckets of MinHash bands, where
they are first compared with one pivot of the bucket: what links to it is in its
component.  Then members of different components of a bucket are held against
each other in tiles of bounded size.  So every two documents that share a bucket
are either compared or known to be connected, and a group of copies costs one
comparison a member.  Candidates must first look alike by their odd sketches,
parity bitmaps of the MinHash samples whose XOR counts the samples that differ;
then the whole sets are compared.

Sets are of 64-bit hashes of shingles.  Equal sets are told by 128 bits of a
cryptographic hash over the whole sorted set, and the links of others are confirmed on
whole sets, where two different shingles of a pair of documents with n shingles hash
alike with a probability under n * n / 2**64.

With 48 bands of 6 samples two sets of similarity 0.8 share no bucket with
probability 5e-7; the sketch bound lets such a pair go with less than 1e-6.

Words are split at ASCII blanks after lower-casing A to Z.  A text with fewer
words than a shingle has is one shingle; null, empty and blank texts have an empty
set and link with nothing, and so do rows with a null identifier, whose component
is null and which are kept.  Rows that repeat an identifier are one node.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm import rolling
from inkveil.llm.bloom import bloom_split
from inkveil.llm.common import materialize, release_memory
from inkveil.llm.components import connected_components, forest

BANDS, ROWS = 48, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Differing sketch bits at similarity 0.8: 93 expected, standard deviation 12.
SKETCH_SIGMAS, SAFETY = 12.0, 5.25
#: Members of a bucket on one side of a comparison; buckets up to SMALL go pair by pair.
TILE, SMALL = 1024, 32
#: Bytes of the longest word that is hashed as a polynomial.
LONG_WORD = 24
#: Shingles of a tile that are counted at once.
COLUMNS = 1 << 13

_random = np.random.default_rng(88)
MULTIPLY = (_random.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1))[:, None]
ADD = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]
PLACE = _random.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_blank = np.zeros(256, bool)
_blank[[32, *range(9, 14)]] = True


def _word_hashes(flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Short words by a polynomial over random byte values; long ones, on which polynomials
    modulo a power of two have known collisions, by a cryptographic hash of their bytes."""
    word = rolling.mix(rolling.spans(rolling.prefix(flat), start, stop) + (stop - start).astype(np.uint64))
    long = np.flatnonzero(stop - start > LONG_WORD)
    if len(long):
        view = memoryview(np.ascontiguousarray(flat))
        hashed = [hashlib.blake2b(view[a:z], digest_size=8).digest() for a, z in zip(start[long].tolist(), stop[long].tolist())]
        word[long] = np.frombuffer(b"".join(hashed), np.uint64)
    return word


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = [b" " if t is None else t.encode("utf-8", "surrogatepass").lower() + b" " for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum([len(d) for d in data])
    blank = _blank[flat]
    edge = np.diff(np.r_[True, blank].astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = _word_hashes(flat, start, stop)
    owner = np.searchsorted(ends, start, side="right")
    counts = np.bincount(owner, minlength=len(texts)) if len(texts) else np.empty(0, int)
    at = np.r_[0, np.cumsum(counts)]
    shingle = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        shingle = rolling.mix(shingle * np.uint64(31) + word[k : len(word) - words + 1 + k])
    out = []
    for k in range(len(texts)):
        a, n = at[k], counts[k]
        if n >= words:
            out.append(np.unique(shingle[a : a + n - words + 1]))
        elif n:
            h = np.zeros(1, np.uint64)
            for w in word[a : a + n]:
                h = rolling.mix(h * np.uint64(31) + w)
            out.append(rolling.mix(h + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set."""
    low = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 2048):
        low = np.minimum(low, (x[None, k : k + 2048] * MULTIPLY + ADD).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = rolling.mix(h * np.uint64(0x9E3779B1) + rows[:, k])
    return h.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit integers."""
    at = rolling.mix(PLACE + low.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_limit(similarity: float) -> int:
    """Differing bits that a pair of this similarity stays within."""
    differ = SAMPLES * (1 - similarity)
    expected = SKETCH_BITS / 2 * (1 - np.exp(-4 * differ / SKETCH_BITS))
    return int(np.ceil(expected + SAFETY * SKETCH_SIGMAS))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits of a cryptographic hash of the set: no two sets of a corpus share them by chance."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _batches(it: Iterator[pd.DataFrame], chars: int = 1 << 20) -> Iterator[pd.DataFrame]:
    for pdf in it:
        cut = (pdf["text"].fillna("").str.len().cumsum() // chars).to_numpy()
        for k in np.unique(cut):
            yield pdf[cut == k]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _batches(it):
            rows = []
            for i, s in zip(pdf["doc_id"].astype("Int64"), shingle_sets(pdf["text"].tolist(), words)):
                low = samples(s) if len(s) else None
                rows.append((i, len(s), *((set_key(s), band_keys(low), odd_sketch(low)) if len(s) else (None, None, None))))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "cid", "bands", "sketch"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
        release_memory()

    return docs.mapInPandas(run, "doc_id long, n_shingles long, cid binary, bands array<long>, sketch array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cid, shingles) of the wanted classes, from the texts of their representatives."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _batches(it):
            found = [(c, s.tobytes()) for c, s in zip(pdf["cid"], shingle_sets(pdf["text"].tolist(), words)) if len(s) and set_key(s) == c]
            yield pd.DataFrame(found, columns=["cid", "shingles"])
        release_memory()

    # the texts of most documents are not wanted: they are told by a few bits, and only the others are shuffled
    wanted = materialize(wanted, "wanted-classes")
    some, _ = bloom_split(docs, "doc_id", wanted, "rep")
    rows = some.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id")
    return rows.select("cid", "text").mapInPandas(run, "cid binary, shingles binary").dropDuplicates(["cid"])


def _mixed(buckets: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component."""
    mixed = buckets.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).filter("lo <> hi")
    mixed = materialize(mixed.select("bucket", "members"), "mixed-buckets")
    return materialize(buckets.join(mixed, "bucket"), "mixed-members")


def _ordered(a: str, b: str, ra: str, rb: str) -> list:
    first = F.col(a) < F.col(b)
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(first, F.col(ra)).otherwise(F.col(rb)).alias("r1"), F.when(first, F.col(rb)).otherwise(F.col(ra)).alias("r2")]


def _with_pivots(active: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """Candidate pairs (a, b, r1, r2) of every member with its bucket's pivot."""
    # the member that meets most others, so the original among its copies, and the same one in like buckets
    met = materialize(active.groupBy("cid").agg(F.sum("members").alias("met")), "met")
    rank = F.struct((-F.col("met")).alias("met"), F.xxhash64("cid").alias("h"), F.col("cid"), F.col("rep"))
    pivots = materialize(active.join(met, "cid").groupBy("bucket").agg(F.min(rank).alias("p")).select("bucket", F.col("p.cid").alias("pivot"), F.col("p.rep").alias("pivot_rep")), "pivots")
    pairs = active.join(pivots, "bucket").filter("pivot <> cid and pivot_rep <> comp").select(*_ordered("pivot", "cid", "pivot_rep", "rep")).distinct()
    pairs = pairs.join(sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("ka")), "a").join(sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("kb")), "b")
    apart = sum((F.bit_count(F.col("ka")[k].bitwiseXOR(F.col("kb")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    return pairs.filter(apart <= limit).select("a", "b", "r1", "r2")


def _by_tile(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs work on the rows of each tile; a tile is bounded, a partition is streamed."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in it:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            marks = pdf[keys].to_numpy()
            cut = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            if len(cut):
                yield pd.concat([work(pdf.iloc[a:z]) for a, z in zip(np.r_[0, cut[:-1]], cut)])
            rest = pdf.iloc[cut[-1] :] if len(cut) else pdf
        if rest is not None and len(rest):
            yield work(rest)
        release_memory()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _alike(left: pd.DataFrame, right: pd.DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs of different components whose sketches are near enough."""
    a, b = (np.vstack(side["sketch"].tolist()).view(np.uint64) for side in (left, right))
    x, y = left["comp"].to_numpy(), right["comp"].to_numpy()
    rows, columns = [], []
    for k in range(0, len(a), 64):  # a few rows against all, so that little is held at once
        i, j = np.nonzero(x[k : k + 64, None] != y[None, :])
        near = np.bitwise_count(a[k + i] ^ b[j]).sum(axis=1) <= limit
        rows.append(k + i[near])
        columns.append(j[near])
    return np.concatenate(rows), np.concatenate(columns)


def _across_components(active: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """Candidate pairs between components of small buckets."""
    rows = active.filter(F.col("members") <= SMALL).join(sketches, "cid").select("bucket", "cid", "rep", "comp", "sketch")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = _alike(pdf, pdf, limit)
        cid, rep = pdf["cid"].to_numpy(), pdf["rep"].to_numpy()
        return pd.DataFrame({"cx": cid[i], "cy": cid[j], "rx": rep[i], "ry": rep[j]})

    found = _by_tile(rows, ["bucket"], compare, "cx binary, cy binary, rx long, ry long")
    return found.select(*_ordered("cx", "cy", "rx", "ry")).distinct()


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each left set shares with each right one, by products of incidence blocks."""
    out = np.zeros((len(left), len(right)), np.float32)
    sizes = [len(x) for x in left], [len(x) for x in right]
    owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
    flat = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    places = []
    for f in flat:
        at = np.searchsorted(shared, f)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == f[hit]
        places.append((at, hit))
    for k in range(0, len(shared), COLUMNS):
        wide = min(COLUMNS, len(shared) - k)
        block = []
        for (at, hit), who, n in zip(places, owner, (len(left), len(right))):
            own = hit & (at >= k) & (at < k + wide)
            x = np.zeros((n, wide), np.float32)
            x[who[own], at[own] - k] = 1
            block.append(x)
        out += block[0] @ block[1].T  # counts stay exact: no set has 2**24 shingles in common
    return out


def _linked_in_tiles(active: DataFrame, sketches: DataFrame, sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links of large buckets: tiles hold the whole sets, and return what connects their members."""
    ways = F.ceil(F.col("members") / TILE).cast("int")
    rows = active.filter(F.col("members") > SMALL).join(sketches, "cid").join(sets, "cid")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("cid", F.lit(5)), ways).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), ways - 1)))
    rows = rows.withColumn("ta", F.least("tile", "other")).withColumn("tb", F.greatest("tile", "other"))
    rows = rows.select("bucket", "ta", "tb", "tile", "rep", "comp", "sketch", "shingles")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["tile"] == pdf["ta"]], pdf[pdf["tile"] == pdf["tb"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        i, j = _alike(left, right, limit)
        if not len(i):
            return pd.DataFrame({"a": [], "b": []})
        rows_, columns = np.unique(i), np.unique(j)
        x, y = ([np.frombuffer(s, np.uint64) for s in side["shingles"].iloc[at]] for side, at in ((left, rows_), (right, columns)))
        both = common_shingles(x, y)
        n = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
        linked = 100 * both.astype(np.float64) >= percent * n.astype(np.float64)
        p, q = np.searchsorted(rows_, i), np.searchsorted(columns, j)
        ok = linked[p, q]
        a, b = left["rep"].to_numpy()[i[ok]], right["rep"].to_numpy()[j[ok]]
        return pd.DataFrame(dict(zip("ab", forest(a, b))))

    return _by_tile(rows, ["bucket", "ta", "tb"], compare, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of representatives whose whole sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            low, high = sorted((len(p), len(q)))
            both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * low >= percent * high else 0
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    pairs = materialize(pairs, "candidates")
    left = pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
    return materialize(both.filter(similar("sa", "sb")).select(F.col("r1").alias("a"), F.col("r2").alias("b")), "confirmed")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = materialize(signatures(docs, words), "signatures")
    known = marks.filter("cid is not null and doc_id is not null")
    classes = known.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "set-classes")
    buckets = classes.select(F.explode("bands").alias("bucket"), "cid", "rep", F.col("rep").alias("comp"))
    limit, tree = sketch_limit(percent / 100), None
    active = _mixed(buckets)
    if not active.isEmpty():
        sets = materialize(_full_sets(docs, active.select("cid", "rep").distinct(), words), "shingle-sets")
        sketches = classes.select("cid", "sketch")
        links = _confirmed(_with_pivots(active, sketches, limit), sets, percent)
        tree = connected_components(links)
        moved = active.drop("comp").join(tree.withColumnRenamed("node", "rep"), "rep", "left")
        active = _mixed(moved.select("bucket", "cid", "rep", F.coalesce("component", "rep").alias("comp")))
        links = links.unionByName(_confirmed(_across_components(active, sketches, limit), sets, percent))
        links = links.unionByName(materialize(_linked_in_tiles(active, sketches, sets, limit, percent), "tile-links"))
        tree = connected_components(links)
    named = classes.select("cid", "rep")
    if tree is None:
        named = named.withColumn("component_id", F.col("rep"))
    else:
        named = named.join(tree.withColumnRenamed("node", "rep"), "rep", "left").select("cid", F.coalesce("component", "rep").alias("component_id"))
    named = materialize(named.select("cid", "component_id"), "class-components")
    out = marks.select("doc_id", "n_shingles", "cid").join(named, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
