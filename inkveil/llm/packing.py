"""Best-fit packing of tokenised documents into sequences (operator 9).

Lengths are integers up to the capacity, so the packing problem is solved on the
histogram of lengths, whose size does not grow with the corpus.  Best-fit
decreasing gives the incumbent.  Bin completion then works down from the largest
length: it branches over all undominated fillings around it, least waste first, used
as often as the counts allow or once; a branch is cut when its waste, or a lower bound
of what is left, exceeds what a packing with one sequence less may have, and best fit
of what is left is an incumbent of its own.  The search ends at the lower bound, or
with all branches done, or after a stated amount of work (``WORK``), which counts at
every size alike, with the best packing found.

Pieces get their places without a global sort: each task counts lengths while it
cuts documents, the counts of (length, task) are summed up by a window, and a
piece's rank among those of its length selects its slot.

Null and empty texts are documents of the end id alone.  Rows that repeat an
identifier are packed each for itself; null identifiers are kept as null.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm import bpe
from inkveil.llm.common import materialize, release_memory

CAPACITY = 1024
#: Lengths and steps that the branch and bound looks at, over all its nodes, before it stops.
WORK = 2_000_000
#: What a node counts besides its lengths.
NODE = 200

Pattern = tuple[int, ...]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no packing can do without (Martello and Toth's L2)."""
    if not counts:
        return 0
    n = np.zeros(capacity + 1, np.int64)
    for x, c in counts.items():
        n[x] = c
    number, size = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)  # lengths under k are left out, those over capacity - k are alone
    alone = number[capacity] - number[capacity - k]
    big, free = number[capacity - k] - number[half], (number[capacity - k] - number[half]) * capacity - (size[capacity - k] - size[half])
    small = size[half] - np.where(k > 0, size[np.maximum(k - 1, 0)], 0)
    return int((alone + big + np.maximum(0, -(-(small - free) // capacity))).max())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, on groups of like sequences at once."""
    groups: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, times: int, room: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((pattern, times))

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                fit = capacity // x
                if left // fit:
                    put((x,) * fit, left // fit, capacity - fit * x)
                if left % fit:
                    put((x,) * (left % fit), 1, capacity - left % fit * x)
                break
            room = rooms[at]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            fit = min(room // x, left)
            use = min(times, left // fit)
            put(pattern + (x,) * fit, use, room - fit * x)
            if times > use:
                put(pattern, times - use, room)
            left -= fit * use
    return [g for room in rooms for g in groups[room]]


def _dominated(filling: Pattern, left: dict[int, int], spare: int, spare_of: int) -> bool:
    """Whether one length that is left over could stand for some of the filling's.

    That is one at least as long as they are together, with no more than ``spare`` on
    top; then what it stands for is free for other sequences, and nothing is lost.
    ``spare_of`` has a bit for each length of which some are left over.
    """
    one = many = 0  # sums of one length, and of several, as bits
    for x in filling:
        many |= (many | one) << x
        one |= 1 << x
    if many:
        reach, step = many, 1
        while step <= spare:  # sums and up to ``spare`` more
            more = min(step, spare + 1 - step)
            reach |= reach << more
            step += more
        if reach & spare_of:
            return True
    return any(spare_of >> (x + 1) & ((1 << spare) - 1) for x in set(filling)) if spare else False


class Effort:
    """What a search may still look at: lengths, and steps of listing fillings."""

    def __init__(self, left: int):
        self.left = left


def fillings(lengths: list[int], counts: dict[int, int], room: int, most_waste: int, effort: Effort) -> Iterator[Pattern]:
    """All undominated fillings of a room, least waste first, while there is effort left; lengths descend.

    They are found one by one: a table says which sums the shorter lengths can make,
    so that no branch is entered that has no filling of the wanted sum.
    """
    lengths = [x for x in lengths if x <= room]
    effort.left -= len(lengths)
    full = (1 << (room + 1)) - 1
    sums = [1] * (len(lengths) + 1)
    for k in range(len(lengths) - 1, -1, -1):
        x, n, made = lengths[k], min(counts[lengths[k]], room // lengths[k]), sums[k + 1]
        step = 1
        while n:  # powers of two, so that few shifts make all multiples
            use = min(step, n)
            made |= made << (x * use) & full
            n, step = n - use, step * 2
        sums[k] = made
    spare_all = sum(1 << x for x in lengths)
    for waste in range(min(room, most_waste) + 1):
        if not sums[0] >> (room - waste) & 1:
            continue
        stack: list[tuple[int, int, Pattern]] = [(0, room - waste, ())]
        while stack and effort.left > 0:
            effort.left -= 1
            k, want, chosen = stack.pop()
            if not want:
                effort.left -= len(chosen)
                used = Counter(chosen)
                spare_of = spare_all
                for x, c in used.items():
                    if c == counts[x]:
                        spare_of &= ~(1 << x)
                if not spare_of & ((1 << (waste + 1)) - 1) and not _dominated(chosen, counts, waste, spare_of):
                    yield chosen
                continue
            if k == len(lengths):
                continue
            x = lengths[k]
            for times in range(min(counts[x], want // x) + 1):  # the last one pushed, most of the longest, comes first
                if sums[k + 1] >> (want - x * times) & 1:
                    stack.append((k + 1, want - x * times, chosen + (x,) * times))


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, work: int = WORK) -> list[tuple[Pattern, int]]:
    """Patterns of lengths with how often each is used; all lengths are used up.

    The search is exact unless it stops for the ``work`` it has done.
    """
    effort = Effort(work)
    counts = {x: c for x, c in counts.items() if c}
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    least = lower_bound(counts, capacity)
    total = sum(x * c for x, c in counts.items())

    def branches(left: dict[int, int], waste: int) -> Iterator[tuple[Pattern, int, int]]:
        """(pattern, times, waste): what may be done with the longest that is left."""
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
        allowed = (used - 1) * capacity - total - waste
        for f in fillings(sorted(rest, reverse=True), rest, capacity - top, allowed, effort):
            need = Counter((top, *f))
            lost = capacity - top - sum(f)
            if lost > (used - 1) * capacity - total - waste:
                return
            most = min(left[x] // n for x, n in need.items())
            if lost:
                most = min(most, allowed // lost)
            for times in dict.fromkeys((most, 1)):  # as often as can be, or once and then anything
                if times:
                    yield (top, *f), times, lost * times

    path: list[tuple[dict[int, int], Iterator, Pattern, int, int, int]] = []  # with bins and waste so far

    def enter(left: dict[int, int], pattern: Pattern, times: int, bins: int, waste: int) -> None:
        nonlocal best, used
        made = [(p[2], p[3]) for p in path[1:]] + ([(pattern, times)] if times else [])
        effort.left -= len(left) + NODE
        if not left:
            if bins < used:
                best, used = made, bins
            return
        if bins + lower_bound(left, capacity) >= used:
            return
        tail = best_fit(left, capacity)  # an incumbent of its own
        n = sum(n for _, n in tail)
        if bins + n < used:
            best, used = made + tail, bins + n
            if bins + lower_bound(left, capacity) >= used:
                return
        path.append((left, branches(left, waste), pattern, times, bins, waste))

    if used > least:
        enter(counts, (), 0, 0, 0)
    while path and used > least and effort.left > 0:
        left, options, _, _, bins, waste = path[-1]
        option = next(options, None)
        if option is None or bins >= used:
            path.pop()
            continue
        pattern, times, lost = option
        if waste + lost > (used - 1) * capacity - total:
            continue
        need = Counter(pattern)
        after = {x: c for x in left if (c := left[x] - need.get(x, 0) * times)}
        enter(after, pattern, times, bins + times, waste + lost)
    return best


class Slots:
    """Where the r-th piece of a length goes."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        lists: dict[int, list[tuple[int, int, int]]] = {}
        ranks: Counter = Counter()
        base = 0
        for pattern, times in patterns:
            offset = 0
            for x in pattern:
                lists.setdefault(x, []).append((ranks[x], base, offset))
                ranks[x] += times
                offset += x
            base += times
        self.tables = {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in lists.items()}
        self.sequences = base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        cut = np.flatnonzero(np.diff(length[order])) + 1
        for part in np.split(order, cut) if len(order) else []:
            starts, bases, offsets = self.tables[int(length[part[0]])]
            at = np.searchsorted(starts, rank[part], side="right") - 1
            sequence[part] = bases[at] + rank[part] - starts[at]
            offset[part] = offsets[at]
        return sequence, offset


def cut_documents(df: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Pieces of all documents with the writing task and a rank among its like."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), Counter()
        model, end = bpe.model(vocabulary), np.array([end_id], "<u4").tobytes()
        for pdf in it:
            ids, texts = pdf["doc_id"], pdf["text"].fillna("").tolist()
            for k in range(0, len(texts), 256):
                rows = []
                for i, data in zip(ids.iloc[k : k + 256].tolist(), model.encode_batch(texts[k : k + 256])):
                    data += end
                    n = len(data) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        part = data[4 * a : 4 * b]
                        rows.append((i, piece, a, b - a, zlib.crc32(part), task, seen[b - a], part if with_ids else None))
                        seen[b - a] += 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank", "ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out if with_ids else out.drop(columns="ids")
        release_memory()

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, shape + (", ids binary" if with_ids else ""))


def pack(df: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    pieces = materialize(cut_documents(df, vocabulary, end_id, capacity, id_col, text_col, with_ids), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = Slots(pack_counts(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["sequence_id"], pdf["offset"] = slots.place(pdf["length"].to_numpy(), pdf["rank"].to_numpy())
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf.drop(columns="rank")

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInPandas(run, shape)
