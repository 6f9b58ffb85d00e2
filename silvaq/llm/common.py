"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and DuckDB pattern of a word: a run of anything but space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Documents in a batch that Spark hands to Python. Long texts make a batch of a few MB.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI. A temporary one of our own where none is set and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="silvaq-shared-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/silvaq-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def local_path(uri: str) -> str:
    return urlparse(uri).path if uri.startswith("file:") else uri


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI; what workers use for files that Spark's own writers cannot make."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + local_path(uri))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: later jobs start from the files, and so does recovery."""
    return stored_at(df, fresh_dir(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint. For narrow rows: checkpoints are not compressed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def release() -> None:
    """Gives memory that has been freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def leaving_nothing(task):
    """A task of mapInArrow that gives its memory back at its end: the worker serves other tasks, beside others, after it."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def remainder(doc_id, modulus: int):
    """crc32 of doc_id as text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def lower_ascii(text):
    """A-Z in lower case; no other letter changes."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8: exactly the runs that WORD matches."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
