"""Helpers that the operators of this package share: shared storage, hashing, row readers."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
ONE_MACHINE = "file:///tmp/checkpoints/tidemark"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or ONE_MACHINE).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name for one run of one operator."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None, a_file: int = 20_000, least: int = 8) -> DataFrame:
    """Write df as Parquet in the shared folder and read it: a cut in the lineage that outlives executors.

    With rows, a bound of what is written, there are about rows / a_file files (`least` at least, or fewer partitions): small
    tables between rounds are not scattered over as many files as the last shuffle had partitions."""
    path = scratch(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(least, rows // a_file))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files behind a written() table, once nothing will read it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that a Python worker receives at once; the default bounds the number of rows only.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, with its session set to send Python workers batches of bounded bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


_cache: dict[str, object] = {}


def trim() -> None:
    """Give back to the system what this process has freed: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def worker_cache(name: str, make):
    """What make() gives, kept for later tasks of the same worker process. Only one name is kept at a time, so that the
    stages of a pipeline do not add up their caches."""
    if name not in _cache:
        _cache.clear()
        trim()
        _cache[name] = make()
    return _cache[name]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns can't clash with its own."""
    return bounded(df).select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"), *[quoted(c) for c in more])


def quoted(name: str) -> Column:
    """A column by its whole name, whatever letters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct `row`, beside which an operator's own columns can have any name."""
    return F.struct(*[quoted(c) for c in df.columns]).alias("row")


def fields(df: DataFrame, **new: Column) -> list[Column]:
    """The columns of df out of `row`, some of them made anew."""
    return [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in df.columns]


def let(value: Column, then) -> Column:
    """then(value) with value worked out once a row. A column named inside a lambda is put there as its whole
    expression, which would run anew for each element; a lambda's own variable is not."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def hash64(data: bytes) -> int:
    """A signed 64-bit hash that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of `column` (one row at least), to bound a worker's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size + 64
        yield batch.slice(start)
