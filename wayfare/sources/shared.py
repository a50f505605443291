"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A temporary one serves only where none is set and all runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="wayfare-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """df written once and read again: later steps neither repeat its work nor depend on lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that no result reads any more."""
    path = getattr(df, "settled_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_of(path: str):
    """A file system of pyarrow and the folder there; path is a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files_of(path: str):
    """The same file system and the settled folder's files in order."""
    from pyarrow import fs

    system, at = folder_of(path)
    return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-"))


def parts_of(path: str) -> Iterator[pa.Table]:
    """The tables of a settled folder's files in order, read without Spark; path is a URI or a plain path."""
    import pyarrow.parquet as pq

    system, found = _files_of(path)
    for name in found:
        yield pq.read_table(name, filesystem=system)


def batches_of(path: str, rows: int, first: int = 0, step: int = 1) -> Iterator[pa.RecordBatch]:
    """The same in batches of at most so many rows, of each so many-th file from the first on."""
    import pyarrow.parquet as pq

    system, found = _files_of(path)
    for name in found[first::step]:
        with system.open_input_file(name) as file:
            yield from pq.ParquetFile(file).iter_batches(rows)


def place_of(ids: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """What gives the places of values in sorted ids that hold them: by a table where ids are close together."""
    if not len(ids) or int(ids[-1]) - int(ids[0]) >= 8 * len(ids) + 1024:
        return lambda values: np.searchsorted(ids, values)
    low, table = ids[0], np.zeros(int(ids[-1]) - int(ids[0]) + 1, np.int32)
    table[ids - low] = np.arange(len(ids), dtype=np.int32)
    return lambda values: table[values - low]
