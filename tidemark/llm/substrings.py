"""Substring dedup by sliding sentence spans.

A span is a run of two or more consecutive sentences that hold `least_words` words. Every repeated span loses all places
but the first, that of the smallest doc_id, then text hash, then place: each sentence that a later place covers is removed.

Hashing every run would take a square of a text's sentences. The shortest run from each first sentence and the shortest to
each last one are enough: a run's sentences are covered by the shortest runs inside it, and these repeat wherever it does.
Spans are hashed (words in lower case, runs of space as one) to 64 bits and a check of 32 more, and joined over the whole
corpus.

Null texts stay null, empty texts empty. Rows that are equal in id and text are one document and keep the same
sentences. A null id counts as smallest. Text that is removed goes with the space after it; the rest stays as it is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded, fields, quoted, release, small_batches, texts, whole_row, written

LEAST_WORDS = 16
#: A repeated span's first place is told to so many slices of its places.
SALTS = 8
#: Parts of the hash space whose spans are joined one after the other.
SLICES = 8

_END = re.compile(r"[.!?]+[\"')\]]*\s+|\n\s*")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_M_INVERSE = [np.uint64(pow(int(x), -1, 1 << 64)) for x in _M]


def sentences(text: str) -> list[str]:
    """Pieces that make up the text, each with the space after it."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]] if at < len(text) else out


def spans(pieces: list[str], least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentences, hash, check) of each shortest run, in order."""
    words = [p.split() for p in pieces]
    n = np.array([len(w) for w in words], np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(w).lower().encode("utf-8")) for w in words], np.uint64)
    m = len(n)
    total = np.concatenate([[0], np.cumsum(n)])
    first, last = np.arange(m), np.arange(1, m + 1)
    end = np.maximum(np.searchsorted(total, total[:-1] + least_words), first + 2)
    start = np.minimum(np.searchsorted(total, total[1:] - least_words, side="right") - 1, last - 2)
    # a piece without a word, which only a text's first one can be, is no sentence
    ahead, back = (end <= m) & (n > 0), (start >= 0) & (n[np.maximum(start, 0)] > 0)
    first, end = np.unique(np.stack([np.append(first[ahead], start[back]), np.append(end[ahead], last[back])]), axis=1)

    def mixed(own: np.ndarray, k: int) -> np.ndarray:
        """A polynomial of the run's own sentences, wherever it stands."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(own * _powers(_M[k], m)[:m])])
        value = (sums[end] - sums[first]) * _powers(_M_INVERSE[k], m)[first]
        value = (value ^ (value >> np.uint64(31)) ^ (end - first).astype(np.uint64)) * _M[k]
        return value ^ (value >> np.uint64(29))

    check = mixed((h ^ (h >> np.uint64(32))) * _M[0], 1) >> np.uint64(32)
    return first, end - first, mixed(h, 0), check


def _powers(x: np.uint64, m: int) -> np.ndarray:
    out = np.ones(m + 1, np.uint64)
    out[1:] = x
    return np.multiply.accumulate(out)


def mark(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """doc_id, text_hash, n_sentences, hashes, checks, lengths, skips: the spans of each text, in order; skips counts the
    sentences between a span's first one and that of the span before it."""

    def work(batches):
        none = (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
        for b in small_batches(batches):
            count, hashes, checks, lengths, skips = [], [], [], [], []
            for text in b.column("text").to_pylist():
                pieces = sentences(text or "")
                count.append(len(pieces))
                first, length, value, check = spans(pieces, least_words) if pieces else none
                hashes.append(value.view(np.int64))
                checks.append(check.astype(np.uint32).view(np.int32))
                lengths.append(length.astype(np.int32))
                skips.append(np.diff(first, prepend=0).astype(np.int32))
            bounds = pa.array(np.cumsum([0, *map(len, hashes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (hashes, checks, lengths, skips)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(count, pa.int32()), *lists], ["doc_id", "text_hash", "n_sentences", "hashes", "checks", "lengths", "skips"])

    t = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return t.mapInArrow(work, "doc_id long, text_hash long, n_sentences int, hashes array<long>, checks array<int>, lengths array<int>, skips array<int>")


def repeated(marks: DataFrame) -> DataFrame:
    """doc_id, text_hash, covered array<k>: the spans (by number) that are not the first of their kind.

    The spans are taken in SLICES of the hash space, so that only a slice's shuffle files are on disk at a time."""
    out = None
    for part in range(SLICES):
        places = marks.select("doc_id", "text_hash", "checks", F.posexplode("hashes").alias("k", "span")).filter(F.pmod("span", F.lit(SLICES)) == part)
        places = places.select("doc_id", "text_hash", "k", "span", F.get("checks", F.col("k")).alias("check"))
        first = places.groupBy("span", "check").agg(F.min(F.struct("doc_id", "text_hash", "k")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("span", "check", "f")
        first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = places.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS))).join(first, ["span", "check", "salt"])
        later = met.filter(~(F.col("f.doc_id").eqNullSafe(F.col("doc_id")) & F.col("f.text_hash").eqNullSafe(F.col("text_hash")) & (F.col("f.k") == F.col("k"))))
        later = written(later.select("doc_id", "text_hash", "k"), "later")
        release(marks.sparkSession)
        out = later if out is None else out.unionByName(later)
    return out.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("k")).alias("covered"))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """row (the whole input row), clean, n_sentences, n_removed, words_removed."""
    marks = written(mark(docs, id_col, text_col, least_words), "spans")
    covered = written(repeated(marks), "covered")
    release(docs.sparkSession)
    one = marks.dropDuplicates(["doc_id", "text_hash"])
    found = covered.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), "covered")
    told = one.join(found, one["doc_id"].eqNullSafe(found["c_id"]) & one["text_hash"].eqNullSafe(found["c_hash"])).select("c_id", "c_hash", "covered", "lengths", "skips")
    keyed = bounded(docs).select(whole_row(docs), quoted(id_col).cast("long").alias("_id"), quoted(text_col).cast("string").alias("text"))
    keyed = keyed.withColumn("_hash", F.xxhash64("text"))
    joined = keyed.join(told, keyed["_id"].eqNullSafe(told["c_id"]) & keyed["_hash"].eqNullSafe(told["c_hash"]), "left").select("row", "text", "covered", "lengths", "skips")

    def work(batches):
        for b in small_batches(batches):
            rows = []
            for text, own, lengths, skips in zip(*(b.column(c).to_pylist() for c in ("text", "covered", "lengths", "skips")), strict=True):
                pieces = sentences(text or "")
                gone = np.zeros(len(pieces) + 1, np.int64)
                if own:
                    at = np.cumsum(skips)[own]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + np.array(lengths)[own], -1)
                gone = np.cumsum(gone)[:-1] > 0 if pieces else np.zeros(0, bool)
                clean = "".join([p for p, g in zip(pieces, gone.tolist(), strict=True) if not g]) if gone.any() else text
                rows.append((clean, len(pieces), int(gone.sum()), sum(len(p.split()) for p, g in zip(pieces, gone.tolist(), strict=True) if g) if gone.any() else 0))
            clean, n, r, w = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(clean, pa.string()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(w, pa.int64())], ["row", "clean", "n_sentences", "n_removed", "words_removed"])

    schema = StructType([joined.schema["row"]])
    for name, kind in (("clean", "string"), ("n_sentences", "long"), ("n_removed", "long"), ("words_removed", "long")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(work, schema)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows with text_col cleaned, and n_sentences, n_removed, words_removed beside the other columns (which keep
    their names; a column of one of these three names is replaced)."""
    own = ("n_sentences", "n_removed", "words_removed")
    out = _cleaned(docs, id_col, text_col, least_words)
    kept = [c for c in docs.columns if c not in own]
    return out.select(*[F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept], *own)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows, columns as they are, with text_col cleaned. A document of which no word is left goes with its words; one
    that lost nothing stays, empty or not."""
    out = _cleaned(docs, id_col, text_col, least_words).filter((F.col("n_removed") == 0) | F.col("clean").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*fields(docs, **{text_col: F.col("clean")}))


def op8_sentence_spans(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op8_sentence_spans": op8_sentence_spans}
ORACLES: dict[str, str] = {}
