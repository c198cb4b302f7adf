"""Near-duplicate vectors through an inverted multi-index (operator 6).

Two codebooks, one for each half of the normalised vectors, are fitted on a
bounded sample; their product is a grid of cells.  Every vector is filed under its
home cell and visits cells in ascending distance by multi-sequence traversal,
until its distance passes that of the nearest cell by a margin.  The grid grows with
the rows of a label, so cells keep their size.  The margin is
measured: a bounded set of queries is held against all rows by brute force, and
the margin is what the target recall needs of the pairs of every one of them, and
of pairs made at the threshold around sampled rows.  Cells are
compared as tiles of base rows and visitors, so a cell of any size is spread over
tasks; a tile returns counts and a spanning forest of its links, not pairs.

Only rows with equal, non-null labels are compared.  Vectors that are null,
empty, zero, or hold null or non-finite components, and rows with a null
identifier or label, link with nothing.  Equal vectors are compared once and
counted each.  Rows that repeat an identifier are one node of a component.
Vectors of different widths do not link.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import materialize, release_memory
from inkveil.llm.components import connected_components
from inkveil.llm.vectors import usable

#: Vectors that codebooks are fitted on; queries that measure recall; its target.
SAMPLE, QUERIES, TARGET = 8192, 1024, 0.9995
#: Rows that a cell is to hold, rows of a tile's side, sampled vectors that a codeword is fitted on.
CELL_ROWS, TILE, WORD_ROWS = 16, 128, 32
BINS, SPAN = 512, 4.0
#: Share that is put on top of the measured margin.
SLACK = 0.25


def _unit(column) -> np.ndarray:
    x = np.vstack(column).astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x /= np.where(top > 0, top, 1)  # no overflow of squares
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def fit_codebook(x: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from a spread, deterministic start."""
    book = x[np.linspace(0, len(x) - 1, min(words, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _square(x, book).argmin(1)
        sums, counts = np.zeros_like(book), np.bincount(near, minlength=len(book))
        np.add.at(sums, near, x)
        book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
    return book


class MultiIndex:
    """Two codebooks and the traversal of their grid."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.margin = first, second, np.inf

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return _square(x[:, :h], self.first), _square(x[:, h:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def excess(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How much farther than its nearest cell each query row finds the cells."""
        a, b = self.halves(q)
        i, j = np.divmod(cells, len(self.second))
        return (a - a.min(1, keepdims=True))[:, i] + (b - b.min(1, keepdims=True))[:, j]

    def apart(self, q: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The margin at which one of two rows visits the other's home; that finds their link."""
        return np.minimum(self.excess(q, self.home(u)), self.excess(u, self.home(q)).T)

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """Cells of each row in ascending distance, up to the margin (multi-sequence).

        The halves' distances are two sorted sequences a row; all rows step through the
        first together, each step taking the run of the second that is still near enough.
        """
        a, b = self.halves(x)
        oa, ob = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        da, db = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
        limit = da[:, 0] + db[:, 0] + self.margin
        db = db[:, : int((db <= (limit - da[:, 0])[:, None]).sum(1).max(initial=1))]
        owner, cells, far = [], [], []
        live = np.arange(len(x))
        for i in range(da.shape[1]):
            live = live[da[live, i] + db[live, 0] <= limit[live]]
            if not len(live):
                break
            row, j = np.nonzero(da[live, i, None] + db[live] <= limit[live, None])
            row = live[row]
            owner.append(row)
            cells.append(oa[row, i] * len(self.second) + ob[row, j])
            far.append(da[row, i] + db[row, j])
        owner, cells, far = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (owner, cells, far))
        by = np.lexsort((far, owner))
        return np.split(cells[by], np.searchsorted(owner[by], np.arange(1, len(x)))) if len(x) else []


def _bins(excess: np.ndarray) -> np.ndarray:
    return np.minimum(excess / SPAN * BINS, BINS - 1).astype(int)


def _sample(classes: DataFrame, n: int, most: int, salt: int) -> pd.DataFrame:
    part = min(1.0, most / max(1, n))
    picked = classes.filter(F.pmod(F.xxhash64("rep", "vh", F.lit(salt)), F.lit(1 << 30)) < int(part * (1 << 30)))
    return picked.select("label", "rep", "vh", "v").limit(2 * most).toPandas()


def build_index(classes: DataFrame, n: int, mates: float, width: int, threshold: float) -> MultiIndex:
    """Fits the codebooks and measures the margin for vectors of one width.

    ``mates`` is how many rows have the label of a row on average; the grid grows with
    it, so that cells keep their size, and the sample grows with the square root of it.
    """
    same = classes.filter(F.size("v") == width)
    words = max(1, round((mates / CELL_ROWS) ** 0.5))
    sample = _sample(same, n, max(SAMPLE, WORD_ROWS * words), 1)
    x = _unit(sample["v"].tolist())
    half = width // 2
    index = MultiIndex(fit_codebook(x[:, :half], words), fit_codebook(x[:, half:], words))
    queries = _sample(same, n, QUERIES, 2)
    by_label, first = {}, 0
    for k, g in queries.groupby("label"):
        by_label[k] = (first, _unit(g["v"].tolist()))
        first += len(g)
    sent = classes.sparkSession.sparkContext.broadcast((index, by_label))

    def measure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, by_label = sent.value
        histogram = np.zeros((sum(len(q) for _, q in by_label.values()), BINS), np.int64)
        for pdf in it:
            for label, g in pdf.groupby("label"):
                first, q = by_label.get(label, (0, None))
                if q is not None:
                    for k in range(0, len(g), 4096):
                        u = _unit(g["v"].iloc[k : k + 4096].tolist())
                        linked = (q @ u.T >= threshold) & (q @ u.T < 1 - 1e-12)
                        if linked.any():
                            i, j = np.nonzero(linked)
                            np.add.at(histogram, (first + i, _bins(index.apart(q, u)[linked])), 1)
        i, j = np.nonzero(histogram)
        yield pd.DataFrame({"query": i, "bin": j, "n": histogram[i, j]})

    found = same.select("label", "v").mapInPandas(measure, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
    # every query by itself, so that the many links of one group do not stand for those of others
    each = found.groupBy("query").agg(F.percentile("bin", TARGET, F.col("n")).alias("bin"))
    reach = each.agg(F.max("bin")).first()[0] or 0
    if len(x):
        # groups that no query is of: pairs made at the threshold, every home cell by the same weight
        rng = np.random.default_rng(5)
        w = rng.standard_normal(x.shape)
        w -= (w * x).sum(1, keepdims=True) * x
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
        u = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * w
        home, seen = index.home(x), np.zeros(BINS)
        weight = 1 / np.bincount(home)[home]
        for k in range(0, len(x), 1024):
            e = np.diagonal(index.apart(x[k : k + 1024], u[k : k + 1024]))
            seen += np.bincount(_bins(e), weight[k : k + 1024], BINS)
        reach = max(reach, np.searchsorted(np.cumsum(seen), TARGET * seen.sum()))
    reach = np.ceil(reach) + 1
    index.margin = float(reach * SPAN / BINS * (1 + SLACK))
    sent.destroy()
    return index


def _forest(linked: np.ndarray, q: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the matrix links: a node and its group's smallest."""
    nodes = np.unique(np.r_[q, u])
    a, b = np.searchsorted(nodes, q), np.searchsorted(nodes, u)
    i, j = np.nonzero(linked)
    label = np.arange(len(nodes))
    x, y = a[i], b[j]
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    spark = df.sparkSession
    fine = usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    classes = rows.filter("fine").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("cnt"))
    classes = materialize(classes.withColumn("vh", F.xxhash64("v")), "vector-classes")
    n = F.col("n")
    shapes = classes.groupBy(F.size("v").alias("w"), "label").agg(F.count("*").alias("n")).groupBy("w").agg(F.sum(n).alias("n"), (F.sum(n.cast("double") * n) / F.sum(n)).alias("mates")).collect()
    found = None
    for s in shapes:
        part = _links(classes.filter(F.size("v") == s["w"]), build_index(classes, s["n"], s["mates"], s["w"], threshold), threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "rep long, vh long, n long, root long")
    found = materialize(found, "vector-links")
    counts = found.filter("n > 0").groupBy("rep", "vh").agg(F.sum("n").alias("n"))
    tree = connected_components(found.filter("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, ["rep", "vh"], "left").join(tree.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    mine = rows.filter("fine").select("vec_id", "label", "v").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def held_out_recall(df: DataFrame, found: DataFrame, threshold: float = 0.93, most: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> float:
    """The share of links that ``found`` has of sampled rows, which no margin was set by, held against all rows."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    fine = rows.filter(usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    n = max(1, fine.count())
    queries = fine.filter(F.pmod(F.xxhash64("vec_id", F.lit(77)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))).limit(2 * most).toPandas()
    groups = {(k, w): (g["vec_id"].to_numpy(), _unit(g["v"].tolist())) for (k, w), g in queries.groupby(["label", queries["v"].map(len)])}
    sent = df.sparkSession.sparkContext.broadcast(groups)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for (label, wide), g in pdf.groupby(["label", pdf["v"].map(len)]):
                ids, q = sent.value.get((label, wide), (None, None))
                if q is not None:
                    for k in range(0, len(g), 4096):
                        part = g.iloc[k : k + 4096]
                        links = (q @ _unit(part["v"].tolist()).T >= threshold) & (ids[:, None] != part["vec_id"].to_numpy()[None, :])
                        yield pd.DataFrame({"vec_id": ids, "n": links.sum(1)})

    want = fine.select("vec_id", "label", "v").mapInPandas(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    row = want.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("n", "n_links")).alias("got"), F.sum("n").alias("n")).first()
    sent.destroy()
    return row["got"] / row["n"] if row["n"] else 1.0


def _links(classes: DataFrame, index: MultiIndex, threshold: float) -> DataFrame:
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(index)  # codebooks, of the square root of the rows

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k in range(0, len(pdf), 1024):
                part = pdf.iloc[k : k + 1024].copy()
                part["visits"] = sent.value.visits(_unit(part["v"].tolist()))
                part["home"] = [p[0] for p in part["visits"]]
                yield part
        release_memory()

    plain = classes.select("label", "rep", "vh", "cnt", "v")
    filed = plain.mapInPandas(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", visits array<long>, home long")
    filed = materialize(filed, "vector-cells")
    # which visits meet anyone is settled on narrow rows; vectors travel once a visit that does
    narrow = filed.select("label", "rep", "vh", "home", F.explode("visits").alias("cell"))
    homes = filed.groupBy("label", F.col("home").alias("cell")).agg(F.count("*").alias("nb"))
    met = narrow.join(homes, ["label", "cell"])
    guests_of = met.groupBy("label", "cell").agg(F.count("*").alias("nv"))
    met = met.join(guests_of, ["label", "cell"]).groupBy("rep", "vh").agg(F.collect_list(F.struct("cell", "nb", "nv")).alias("met"))
    rows = filed.join(met, ["rep", "vh"]).withColumn("m", F.explode("met")).select("label", "rep", "vh", "cnt", "v", "visits", "home", "m.cell", "m.nb", "m.nv")
    ways = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    side = lambda c, salt: F.pmod(F.xxhash64("rep", "vh", F.lit(salt)), ways(c)).cast("int")
    keep = ["label", "cell", "rep", "vh", "cnt", "v", "visits", "home"]
    # a tile reads the visits of hosts only
    guests = rows.withColumn("visits", F.lit(None).cast("array<long>")).select(*keep, F.lit(False).alias("base"), side("nv", 3).alias("vt"), F.explode(F.sequence(F.lit(0), ways("nb") - 1)).alias("bt"))
    hosts = rows.filter("cell = home").select(*keep, F.lit(True).alias("base"), side("nb", 4).alias("bt"), F.explode(F.sequence(F.lit(0), ways("nv") - 1)).alias("vt"))

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in it:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cut = _tile_cuts(pdf)
            if len(cut):
                yield _tiles(pdf.iloc[: cut[-1]], np.r_[0, cut], threshold)
            rest = pdf.iloc[cut[-1] :] if len(cut) else pdf
        if rest is not None and len(rest):
            yield _tiles(rest, np.array([0, len(rest)]), threshold)
        release_memory()

    tile = ["label", "cell", "bt", "vt"]
    sides = guests.unionByName(hosts).repartition(*tile).sortWithinPartitions(*tile)
    return sides.mapInPandas(compare, "rep long, vh long, n long, root long")


def _tile_cuts(pdf: pd.DataFrame) -> np.ndarray:
    """Where tiles of a sorted frame end, but for the last."""
    new = np.zeros(max(0, len(pdf) - 1), bool)
    for c in ("label", "cell", "bt", "vt"):
        v = pdf[c].to_numpy()
        new |= v[1:] != v[:-1]
    return np.flatnonzero(new) + 1


def _tiles(pdf: pd.DataFrame, cuts: np.ndarray, threshold: float) -> pd.DataFrame:
    """(rep, vh, n, root): links counted, and edges that connect what they link, of tiles that end at the cuts."""
    x, base = _unit(pdf["v"].tolist()), pdf["base"].to_numpy()
    rep, vh, cnt, home, visits = (pdf[c].to_numpy() for c in ("rep", "vh", "cnt", "home", "visits"))
    counted, edges = [], []
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = base[a:z]
        b, g = a + np.flatnonzero(own), a + np.flatnonzero(~own)
        if not len(b) or not len(g):
            continue
        linked = x[g] @ x[b].T >= threshold
        linked &= (rep[g, None] != rep[b]) | (vh[g, None] != vh[b])
        if not linked.any():
            continue
        # a guest counts its hosts; a host counts guests whose home it does not visit itself
        unseen = np.column_stack([~np.isin(home[g], visits[k]) for k in b])
        counted += [(rep[g], vh[g], linked @ cnt[b]), (rep[b], vh[b], (linked & unseen).T @ cnt[g])]
        edges.append(_forest(linked, rep[g], rep[b]))
    if not counted:
        return pd.DataFrame({"rep": [], "vh": [], "n": [], "root": []})
    r, v, n = (np.concatenate(c) for c in zip(*counted))
    node, root = (np.concatenate(c) for c in zip(*edges))
    some = n > 0
    nothing = np.zeros(len(node), np.int64)
    out = pd.DataFrame({"rep": np.r_[r[some], node], "vh": np.r_[v[some], nothing], "n": np.r_[n[some], nothing]})
    out["root"] = pd.array([None] * int(some.sum()) + root.tolist(), "Int64")
    return out
