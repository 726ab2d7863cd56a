"""Session, table and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a fresh one in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="zonalis-")
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Rows and words that one file of a table takes, where partitions are too many for it.
FILE_ROWS, FILE_WORDS = 1 << 13, 1 << 21


def files_for(spark: SparkSession, rows: int, words: int) -> int:
    """Files enough for tables on so many documents with so many words: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS), -(-words // FILE_WORDS))


def in_files(df: DataFrame, files: int | None) -> DataFrame:
    """df in `files` partitions where a shuffle has four times as many or more, else as it is.

    Every partition becomes a file, and on a local file system without Hadoop's native library the executor starts two or
    three processes (chmod) for each, which for a moment share, and are counted with, the memory of its JVM.
    """
    return df.repartition(files) if files and 4 * files <= partitions(df) else df


def materialise(df: DataFrame, name: str, compression: str = "zstd", files: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and return its reader; this cuts lineage and survives lost executors.

    files: see `in_files`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    in_files(df, files).write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def inner_name(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of df's, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the len+1 offsets of its rows; null rows are empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or one longer row; at most 20,000 rows."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), first + 20_000, n)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on uint64."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(seed: int, n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(x) | np.uint64(1)
