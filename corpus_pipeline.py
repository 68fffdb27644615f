"""A training-data pipeline: language, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. All but the last return the
columns of documents, n_chars counted anew where the text changes; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import tokenizer_file
from tidemark.llm.common import fields, quoted, written
from tidemark.llm.jaccard import one_of_each_group
from tidemark.llm.langid import fit, identify
from tidemark.llm.packing import pack, pieces
from tidemark.llm.pii import redact
from tidemark.llm.substrings import without_repeats

#: A text of LONG characters or more of whose n-grams no language knows this share is in none of the learned languages,
#: however many they are. A shorter one may just hold too little evidence, and stays.
LEAST_KNOWN = 0.2
LONG = 200
#: Encoded words that a worker keeps in the packing stage, less than op4's own: executors still hold what the stages before
#: this one have grown to.
KEPT_WORDS = 250_000


def counted(docs: DataFrame) -> DataFrame:
    """The same columns, n_chars counted anew."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter, and long ones in none of the learned languages. lang stays as it is where it is
    known, and takes the prediction where it is null."""
    told = identify(docs, fit(docs), with_rows=True)
    good = told.filter((F.col("lang_pred") != "und") & ((F.col("known") >= LEAST_KNOWN) | (F.length("row.text") < LONG)))
    return good.select(*fields(docs, lang=F.coalesce(F.col("row.lang"), "lang_pred")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five words, similarity 0.8."""
    return one_of_each_group(docs, 5, 80, 100)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentence spans go; a document of which no word is left goes with them."""
    return counted(without_repeats(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(written(pieces(docs, tokenizer_file(), kept=KEPT_WORDS), "pieces"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Tokenizing and the language model have no SQL form; tests/llm compares the pipeline with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
    return docs
