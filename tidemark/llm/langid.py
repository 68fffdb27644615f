"""Language identification by language-bitmask n-gram filters.

One Bloom filter a language, stored bit-sliced: a slot holds one bit for each language, so one probe of `HASHES` slots,
and-ed, returns every language whose training texts hold an n-gram. A text's n-grams give hits by language (a popcount
of each bit); the hits that a filter's fill would give by chance are taken off; the rest decide.

The filter is fitted on about `per_language` labelled texts a language, drawn by a hash of their id, each in
whole; its size does not grow with the corpus. Predictions read the text alone and cover every row in whole.

A null text, or one without a letter, is `und` with score 0. Without training rows all texts are `und`. Repeated rows
are repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded, small_batches, texts, whole_row

NGRAM = 5
#: Slots of the bit-sliced filter; each holds a 64-bit mask, so at most 64 languages are learned.
SLOTS = 1 << 20
HASHES = 2
#: Labelled texts a language that the filter is fitted on, and texts that must hold an n-gram before it is kept.
PER_LANGUAGE = 2000
LEAST_TEXTS = 3

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_fold: np.ndarray | None = None


def _folded() -> np.ndarray:
    """Code point to letter: lower case for letters, a space for all else (runs of it are squeezed later)."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def grams(text: str | None, n: int = NGRAM) -> np.ndarray:
    """A 64-bit hash of each n-gram of letters and word gaps, in order of place; none without a letter."""
    if not text:
        return np.empty(0, np.uint64)
    points = _folded()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    gap = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    points = points[keep]
    if not len(points) or (len(points) == 1 and points[0] == 32):
        return np.empty(0, np.uint64)
    points = np.concatenate([[32], points[int(points[0] == 32) :], [32] * int(points[-1] != 32)]).astype(np.uint64)
    n = min(n, len(points))
    out = np.zeros(len(points) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ points[k : len(points) - n + 1 + k]) * _MIX[1]
        out ^= out >> np.uint64(29)
    return out


def slots(hashes: np.ndarray, k: int, size: int = SLOTS) -> np.ndarray:
    return (((hashes ^ _MIX[k]) * _MIX[0]) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


class SlicedFilter:
    """Masks by slot, the languages by bit, and each bit's share of set slots."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        fill = np.array([((masks >> np.uint64(b)) & np.uint64(1)).mean() for b in range(len(languages))])
        self.chance = fill**HASHES

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """A mask of languages for each n-gram."""
        size, out = len(self.masks), None
        for k in range(HASHES):
            own = self.masks[slots(hashes, k, size)]
            out = own if out is None else out & own
        return out

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, known): hits corrected for chance; the best language's share of all languages' hits, and its
        share of the text's n-grams, which does not depend on how many languages are learned. Ties go to the first."""
        hashes = grams(text)
        if not len(hashes) or not self.languages:
            return "und", 0.0, 0.0
        masks = self.languages_of(hashes)
        hits = np.array([np.count_nonzero(masks & np.uint64(1 << b)) for b in range(len(self.languages))], float)
        true = np.maximum((hits - self.chance * len(hashes)) / (1 - np.minimum(self.chance, 0.999)), 0)
        if not true.sum():
            return self.languages[int(hits.argmax())], 0.0, 0.0
        return self.languages[int(true.argmax())], float(true.max() / true.sum()), min(1.0, float(true.max()) / len(hashes))


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, least_texts: int = LEAST_TEXTS, size: int = SLOTS) -> SlicedFilter:
    """The filter from labelled rows. What reaches the driver is at most one mask a slot."""
    rows = texts(training, id_col, text_col, lang_col).filter(F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    # a hash of the id decides, at a rate from the language's count: no shuffle of texts, and no task that gathers them
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(lang_col).limit(65).collect()}
    space = 1 << 40
    limits = {x: space if n <= per_language else int(space * per_language / n) for x, n in counts.items()}
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(space))
    sample = rows.filter(F.coalesce(*[F.when(F.col(lang_col) == x, drawn < n) for x, n in limits.items()], F.lit(False))) if limits else rows
    languages = sorted(counts)
    if len(languages) > 64:
        raise ValueError("at most 64 languages")
    bit = {x: i for i, x in enumerate(languages)}

    def count(batches):
        for b in small_batches(batches):
            own = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column(lang_col).to_pylist(), strict=True):
                own.setdefault(bit[lang], []).append(np.unique(grams(text)))
            for k, lists in own.items():
                values, n = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values.view(np.int64)), pa.array(n)], ["bit", "gram", "n"])

    kept = sample.mapInArrow(count, "bit int, gram long, n long").groupBy("bit", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_texts)

    def put(batches):
        for b in batches:
            g, k = b.column("gram").to_numpy(zero_copy_only=False).view(np.uint64), b.column("bit").to_numpy(zero_copy_only=False)
            at = np.concatenate([slots(g, h, size) for h in range(HASHES)])
            values = np.unique(at * 64 + np.tile(k, HASHES))
            yield pa.RecordBatch.from_arrays([pa.array(values // 64), pa.array(np.int64(1) << (values % 64))], ["slot", "mask"])

    masks = np.zeros(size, np.uint64)
    table = kept.mapInArrow(put, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks[table.column("slot").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return SlicedFilter(languages, masks)


def identify(docs: DataFrame, model: SlicedFilter, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, known (see decide) for every row; with_rows adds the whole input row as the struct `row`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one mask a slot: 8 MB at most
    rows = bounded(docs).select(whole_row(docs)) if with_rows else texts(docs, id_col, text_col)

    def work(batches):
        m = shared.value
        for b in batches:
            # a text is sent once: with_rows reads it where it stands in its row
            fields = b.column("row") if with_rows else None
            ids = pc.cast(fields.field(id_col), pa.int64()) if with_rows else b.column("doc_id")
            told = list(zip(*[m.decide(t) for t in pc.cast(fields.field(text_col) if with_rows else b.column("text"), pa.string()).to_pylist()], strict=True)) or [()] * 3
            cols = [ids, *(pa.array(x, t) for x, t in zip(told, (pa.string(), pa.float64(), pa.float64()), strict=True))]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[: int(with_rows)]], ["doc_id", "lang_pred", "score", "known", *["row"][: int(with_rows)]])

    schema = StructType.fromDDL("doc_id long, lang_pred string, score double, known double")
    return rows.mapInArrow(work, schema.add(rows.schema["row"]) if with_rows else schema)


def held_out(doc_id="doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_filters(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_filters": op5_language_filters}
ORACLES: dict[str, str] = {}
