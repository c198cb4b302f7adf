"""What the operators of this subpackage share: the shared folder, folds, files, memory."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Application (and stage folder, if any) to the folder in use.
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what ``spark.checkpoint.dir`` names.  Where that is unset, a temporary folder
    is made and set if all runs on one machine; on a cluster it is an error.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkveil-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        path = f"{shared_dir(spark)}/inkveil-{uuid.uuid4().hex}"
        p, fs = _hadoop(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _folders[app] = path
    return _folders[app]


@contextlib.contextmanager
def stage_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside go at the end; what is to stay must be written before."""
    app, outer = spark.sparkContext.applicationId, scratch_dir(spark)
    path = _folders[app] = f"{outer}/stage-{uuid.uuid4().hex}"
    try:
        yield outer
    finally:
        _folders[app] = outer
        remove(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: short lineage, stable rows."""
    return written(df, fresh_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def part_files(spark: SparkSession, path: str) -> list[str]:
    """URIs of a written table's files, sorted; one per writing task, so few."""
    p, fs = _hadoop(spark, path)
    names = [s.getPath().toString() for s in fs.listStatus(p)]
    return sorted(n for n in names if re.search(r"/part-[^/]*$", n))


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def open_fs(uri: str):
    """(file system, path) by which a worker opens a URI of the shared folder."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def id_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo a number; null for a null identifier."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


#: Rows that Python gets at once: texts may be long, and workers keep the memory they once had.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what an Arrow batch of texts holds in this session's Python functions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# -- memory of Python workers ------------------------------------------------------------------

_in_use: list = []


def only_cache(owner) -> None:
    """Says that ``owner``'s cache is the one in use: a worker keeps no other (``forget`` empties it)."""
    if _in_use and _in_use[0] is owner:
        return
    for other in _in_use:
        other.forget()
    _in_use[:] = [owner]


def release_memory() -> None:
    """Gives freed memory back to the system; workers live on between tasks and stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL(None).malloc_trim(0)
