"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 30


def labelled_documents(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label, doc_id, weight) of about ``most[label]`` documents of each class.

    ``weight`` is how many labelled rows a picked one stands for, so that a sample which
    is balanced by ``most`` keeps the class shares of the table.
    Rows are picked by a hash of the identifier, so the sample does not depend on
    the order of the table.  ``usable`` selects labelled rows by identifier.  Null
    identifiers and labels are passed over; an identifier with several labels has
    the largest.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marks = marks.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(usable)
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in marks.filter(F.col("label").isin(*most)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    share, weight = F.lit(0), F.lit(1.0)
    for label, n in counts.items():
        part = min(1.0, most[label] / n)
        share = F.when(F.col("label") == label, F.lit(int(part * SCALE))).otherwise(share)
        weight = F.when(F.col("label") == label, F.lit(1 / part)).otherwise(weight)
    picked = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(SCALE)) < share)
    # the picked labels are bounded by `most`, whatever the size of the tables
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("text", "label", "doc_id", weight.alias("weight"))
