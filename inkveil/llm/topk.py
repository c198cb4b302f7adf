"""Exact top-k search by inner product, tile by tile (operator 7).

Queries are taken in blocks of bounded size; a block's matrix goes to all tasks,
which multiply it with their shards of candidates one tile at a time, select the
best of each tile and merge them with those so far.  The tasks' lists are merged
by a tree of two windows.  Blocks come one after another and leave their lists in
the shared folder, so neither driver nor executors hold more than one block.

Components become ``floor(scale * x)`` and scores are exact integers: products are
done in doubles while every sum stays below 2**53, else with Python's integers
and clipped to 64 bits.  Vectors that are null, empty or hold null or non-finite
components take no part; vectors of different widths are not compared.  A row
is no candidate for queries with its own identifier; rows that repeat another
identifier are candidates each.  Ties go to the smaller identifier.  Null
identifiers take no part.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import fresh_path
from inkveil.llm.vectors import by_width, matrix, usable

#: Numbers in one block of queries (8 bytes each), and candidates in a tile.
BLOCK_NUMBERS, TILE = 1 << 21, 2048
EXACT = float(1 << 53)
#: Lists of one query that a first merge takes together.
MERGE_WAYS = 16


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, smaller id) of each query row, in order."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], ids[keep], score[keep]


class _Running:
    """Best lists so far of one block in one task."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def tile(self, ids: np.ndarray, c: np.ndarray) -> None:
        s = _scores(self.q, c)
        s_ok = self.ids[:, None] != ids[None, :]
        if s.shape[1] > self.k:
            low = np.where(s_ok, s, np.iinfo(np.int64).min)
            floor = np.partition(low, -self.k, axis=1)[:, -self.k]
            s_ok &= s >= floor[:, None]
        row, col = np.nonzero(s_ok)
        a, b, c_ = _best(row, ids[col], s[row, col], self.k)
        merged = [np.concatenate(x) for x in zip(self.kept, (a, b, c_))]
        self.kept = _best(*merged, self.k)


def top_k(df: DataFrame, query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row that ``query`` selects."""
    spark = df.sparkSession
    rows = df.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    chosen = rows.filter(query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    total = chosen.agg(F.sum(F.size("v").cast("long")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // BLOCK_NUMBERS))
    out, shape = fresh_path(spark, "top-lists"), "query_id long, q int, block int, task int, vec_id long, score long"
    for block in range(blocks):
        part = chosen if blocks == 1 else chosen.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        held = part.toPandas()  # one block: about BLOCK_NUMBERS numbers
        groups = {n: (held["id"].to_numpy()[at], np.floor(scale * matrix(held["v"], at)), at) for n, at in (by_width(held["v"]) if len(held) else {}).items()}
        sent = spark.sparkContext.broadcast(groups)

        def run(it: Iterator[pd.DataFrame], block=block, sent=sent) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            running = {n: _Running(ids, q, k) for n, (ids, q, _) in sent.value.items()}
            for pdf in it:
                for a in range(0, len(pdf), TILE):
                    tile = pdf.iloc[a : a + TILE]
                    for n, at in by_width(tile["v"]).items():
                        if n in running:
                            running[n].tile(tile["id"].to_numpy()[at], np.floor(scale * matrix(tile["v"], at)))
            for n, r in running.items():
                row, ids, score = r.kept
                yield pd.DataFrame({"query_id": r.ids[row], "q": sent.value[n][2][row].astype(np.int32), "block": np.int32(block), "task": np.int32(task), "vec_id": ids, "score": score})

        rows.mapInPandas(run, shape).write.mode("append").parquet(out)
        sent.destroy()
    lists = spark.read.schema(shape).parquet(out)
    order = [F.col("score").desc(), F.col("vec_id")]
    for keys in (["query_id", "q", "block", "ways"], ["query_id", "q", "block"]):
        lists = lists.withColumn("ways", F.col("task") % MERGE_WAYS)
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
