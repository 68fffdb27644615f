"""Sinks. A partitioned write replaces only the partitions that it holds; nothing is gathered unless one file is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition folder; rows of a folder come from few tasks, and a large folder is split by size."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def one_file(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").parquet(path)


def ordered_csv(df: DataFrame, path: str, *order: str) -> None:
    df.repartitionByRange(1, *order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def append_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do, from the data that is already written."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def once(df_of, spark, path: str) -> DataFrame:
    """The table at path, made by df_of() only if it is not complete yet (Spark marks a complete one)."""
    if not exists(spark, f"{path}/_SUCCESS"):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def record(df: DataFrame, path: str) -> None:
    """A run's record; an existing one is never replaced."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def zipped_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "utf-8") -> None:
    """A zip file a partition in the shared folder at path, each with one member of comma (or otherwise) separated text. A
    task writes under a name of its own attempt and renames it when complete, so it can run again elsewhere."""

    def work(batches):
        import codecs
        import csv as lines
        import io
        import os
        import zipfile

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") or "://" not in path else fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name, part = f"{folder}/part-{task.partitionId():05d}.zip", f"{folder}/.{task.taskAttemptId()}-{os.getpid()}"
        n = 0
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("rows.csv", "w") as member:
            encoder = codecs.getincrementalencoder(encoding)()  # which writes a mark once, at the start
            for b in batches:
                text = io.StringIO()
                w = lines.writer(text, delimiter=sep, lineterminator="\n")
                if not n:
                    w.writerow(b.schema.names)
                w.writerows(zip(*(c.to_pylist() for c in b.columns), strict=True))
                member.write(encoder.encode(text.getvalue()))
                n += b.num_rows
        (store.move(part, name) if n else store.delete_file(part))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    df.mapInArrow(work, "n long").agg(F.sum("n")).collect()  # one number
