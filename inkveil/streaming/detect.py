"""Detection and redaction over streams: both work row by row and keep no state.

The transforms are those of batches; only source, trigger and sink differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from inkveil.operators.detect import analyze_text, candidates
from inkveil.rules.registry import STANDARD


def stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files under a path or pattern as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def detect_stream(stream: DataFrame, *keys: str, level: str = STANDARD) -> DataFrame:
    return candidates(analyze_text(stream, level), *keys)


def run_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what there is now as Parquet, once and exactly once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
