"""Rows whose identifier is surely in no set are told apart before a join by a Bloom filter, and need no shuffle.

The filter never misses a member.  It lets a few others pass, so an exact join must
follow.  It takes at most ``MOST_BITS``: with more members than that is meant for, more
rows go on to the join, and nothing else changes.  All of it stays in the JVM, since
Python would make the executors hold texts beside the identifiers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a member and hashes: one in 300 of the others passes, or fewer.
BITS, HASHES = 12, 4
LEAST_BITS, MOST_BITS = 1 << 13, 1 << 26


def _places(ids: Column, bits: int) -> list[Column]:
    """The bit numbers of an identifier."""
    h = F.xxhash64(ids.cast("long"))
    first, step = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1).cast("long"))
    return [(first + step * k).bitwiseAND(F.lit(bits - 1).cast("long")) for k in range(HASHES)]


def _shifted(way: str, word: Column, place: Column) -> Column:
    return F.call_function(way, word, place.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def bloom_split(rows: DataFrame, id_col: str, members: DataFrame, member_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may be members, rows that are surely none); a null identifier is no member."""
    members = members.filter(F.col(member_col).isNotNull())
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * members.count()).bit_length()))
    at = members.select(F.explode(F.array(*_places(F.col(member_col), bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(_shifted("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy()
    one = F.broadcast(rows.sparkSession.createDataFrame([(table.tolist(),)], "__words array<long>"))
    set_ = [_shifted("shiftrightunsigned", F.get("__words", F.shiftright(p, 6).cast("int")), p).bitwiseAND(F.lit(1).cast("long")) == 1 for p in _places(F.col(id_col), bits)]
    held = F.col(id_col).isNotNull()
    for s in set_:
        held = held & s
    return rows.join(one, held, "left_semi"), rows.join(one, held, "left_anti")
