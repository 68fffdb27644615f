"""Readers. Schemas are given or all text; nothing is inferred from the data."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv(spark: SparkSession, path: str, columns: list[str] | None = None, strict: bool = True, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text. strict: a malformed line is an error; else it is dropped. Header names are stripped. With
    columns, just these in this order; one that the file lacks is null."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("inferSchema", False)
    df = reader.csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return fitted(df, columns) if columns else df


def fitted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, null where absent: drifting sources under one schema."""
    have = {c.strip(): c for c in df.columns}
    return df.select(*[F.col(f"`{have[c]}`").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def zipped_csv(spark: SparkSession, path: str, columns: list[str], member: str = ".csv", sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """Rows of the members (by name's end) of zip files, as text columns. Files are read on executors, a file a task; each
    member is decompressed as a stream."""
    import csv as lines

    def work(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(member)):
                        with z.open(name) as f:
                            rows = lines.DictReader(io.TextIOWrapper(f, encoding, newline=""), delimiter=sep)
                            rows.fieldnames = [c.strip().lstrip("﻿") for c in rows.fieldnames or []]
                            held: list[dict] = []
                            for r in rows:
                                held.append(r)
                                if len(held) == 5000:
                                    yield pa.RecordBatch.from_pydict({c: [x.get(c) for x in held] for c in columns}, pa.schema([(c, pa.string()) for c in columns]))
                                    held = []
                            if held:
                                yield pa.RecordBatch.from_pydict({c: [x.get(c) for x in held] for c in columns}, pa.schema([(c, pa.string()) for c in columns]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, text_schema(columns))


def parquet(spark: SparkSession, *paths: str, merge: bool = False) -> DataFrame:
    """By column name; merge reads every footer and joins drifting schemas. Partition folders become columns, filters on them prune folders."""
    return spark.read.option("mergeSchema", merge).parquet(*paths)


def ndjson(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Newline-delimited JSON, gzipped or not. A gzip file is one task, so what follows is dealt out anew."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def listed(value: Column, element: str) -> Column:
    """A JSON text that holds an object or an array of objects, as an array."""
    one = F.from_json(value, element)
    return F.when(F.trim(value).startswith("["), F.from_json(value, f"array<{element}>")).when(value.isNotNull(), F.array(one))


def html_rows(html: Column, cells: int) -> Column:
    """array<array<string>>: the text of each table row with that many cells."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    texts = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))))
    return F.filter(texts, lambda r: F.size(r) == cells)


def carry_header(lines: DataFrame, order: str, is_header: Column, value: Column, document: str) -> DataFrame:
    """Lines of sectioned documents with the section header that stands above each; headers themselves go."""
    from pyspark.sql import Window

    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumns({"_h": is_header, "section": F.last(F.when(is_header, value), ignorenulls=True).over(w)})
    return d.filter(~F.col("_h")).drop("_h")


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """m (month start) for each month from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
