"""Best-fit packing by minimum bin slack.

Documents become pieces of at most `capacity` tokens. Only the number of pieces of each length (at most `capacity`
numbers, whatever the input's size) reaches the driver. There, bin after bin takes the longest length left, and a bitset
subset-sum over the other lengths finds the fullest combination beside it; the combination is removed as often as the
counts allow, so the loop ends after some thousand combinations. Executors then number the pieces of each length and
read their sequence and offset from the plan.

Null and empty texts are one piece, the closing id alone. Repeated rows are pieces of their own. An empty table packs
into nothing.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import tokenizer_file
from .common import small_batches, texts, worker_cache, written
from .words import Vocabulary, byte_letters

CAPACITY = 2048
#: Pieces of one length are numbered in groups of about so many, so that a length that a third of all have is spread.
A_GROUP = 20_000
#: Words in one of the two generations that a worker keeps encoded.
KEPT_WORDS = 700_000

_LETTERS = byte_letters()


def bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination: length to copies, times it is used), by minimum bin slack."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    out = []
    while left:
        longest = next(iter(left))
        slack = capacity - longest
        mask, reach, layers = (1 << (slack + 1)) - 1, 1, []
        for n, c in left.items():
            if n > slack:
                continue
            most = min(c - (n == longest), slack // n)
            if most <= 0:
                continue
            before, step = reach, 1
            while most > 0:
                step = min(step, most)
                reach |= (reach << (step * n)) & mask
                most -= step
                step *= 2
            layers.append((n, before))
            if reach >> slack & 1:
                break
        full, combination = reach.bit_length() - 1, Counter({longest: 1})
        for n, before in reversed(layers):
            while not before >> full & 1:
                full -= n
                combination[n] += 1
        times = min(left[n] // c for n, c in combination.items())
        out.append((dict(combination), times))
        for n, c in combination.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return out


class Plan:
    """Where the r-th piece of a length goes: arrays by length, in order of rank."""

    def __init__(self, combinations: list[tuple[dict[int, int], int]]):
        by, first, taken = defaultdict(list), 0, Counter()
        for combination, times in combinations:
            offset = 0
            for n, c in combination.items():
                by[n].append((taken[n], first, c, offset))
                taken[n] += c * times
                offset += n * c
            first += times
        self.sequences = first
        self.by = {n: np.array(x, np.int64).T for n, x in by.items()}

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, first, copies, offset = self.by[length]
        at = np.searchsorted(lo, ranks, side="right") - 1
        turn, copy = np.divmod(ranks - lo[at], copies[at])
        return first[at] + turn, offset[at] + copy * length


class _Words(dict):
    """A word's ids as little-endian bytes, asked of the tokenizers library's model once. When `kept` are known they
    become the older generation, from which words in use return; so memory is bounded."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.v, self.older, self.kept = Vocabulary(path), {}, kept
        self.tokenize = Tokenizer.from_file(path).model.tokenize
        self.made = {n: struct.Struct(f"<{n}I") for n in range(1, 65)}

    def learn(self, lists) -> None:
        """Encode what a block of texts holds and is not known yet."""
        if len(self) > self.kept:
            self.older = dict(self)
            self.clear()
        new = set().union(*lists) - self.keys()
        again = new & self.older.keys()
        self.update(zip(again, map(self.older.__getitem__, again), strict=True))
        tokenize, made = self.tokenize, self.made
        for word in new - again:
            ids = [t.id for t in tokenize(word if word.isascii() and word.isprintable() else "".join([_LETTERS[b] for b in word.encode("utf-8")]))]
            self[word] = made[len(ids)].pack(*ids) if len(ids) <= 64 else struct.pack(f"<{len(ids)}I", *ids)

    def ids_of(self, block: list[str]) -> list[bytes]:
        parts = [[(() if s else self.v.words(p), s, p) for p, s in self.v.pieces(t)] for t in block]
        self.learn([w for own in parts for w, s, _ in own if not s])
        get, special = self.__getitem__, self.v.special
        return [b"".join([struct.pack("<I", special[p]) if s else b"".join(map(get, w)) for w, s, p in own]) for own in parts]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept: int = KEPT_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit). kept: encoded words in memory."""

    def work(batches):
        words, closing = worker_cache(f"words {tokenizer_path} {kept}", lambda: _Words(tokenizer_path, kept)), b"\0\0\0\0"
        for b in small_batches(batches):
            rows = []
            block = words.ids_of([t or "" for t in b.column("text").to_pylist()])
            for doc, ids in zip(b.column("doc_id").to_pylist(), block, strict=True):
                ids += closing
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    return texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(cut: DataFrame, capacity: int = CAPACITY, a_group: int = A_GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. `cut` should be a written table: it is read twice."""
    sizes = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    split = [max(1, -(-sizes.get(n, 0) // a_group)) for n in range(capacity + 1)]
    groups = max(split)
    grouped = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(F.lit(split), F.col("length").cast("int"))).cast("int"))
    counted = grouped.groupBy("length", "_group").count().collect()  # a row a length and one for each a_group pieces
    first, total = {}, Counter()
    for r in sorted(counted, key=lambda r: (r["length"], r["_group"])):
        first[r["length"], r["_group"]] = total[r["length"]]
        total[r["length"]] += r["count"]
    plan = Plan(bins(total, capacity))
    order = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = grouped.withColumn("_rank", F.row_number().over(order).cast("long"))

    def work(batches):
        for b in batches:
            n = b.num_rows
            lengths, own = b.column("length").to_numpy(zero_copy_only=False), b.column("_group").to_numpy(zero_copy_only=False)
            ranks, seq, off = b.column("_rank").to_numpy(zero_copy_only=False) - 1, np.empty(n, np.int64), np.empty(n, np.int64)
            keys, back = np.unique(lengths * groups + own, return_inverse=True)
            ranks = ranks + np.array([first[divmod(k, groups)] for k in keys.tolist()], np.int64)[back]
            for length in np.unique(lengths).tolist():
                here = lengths == length
                seq[here], off[here] = plan.place(length, ranks[here])
            kept = [x for x in b.schema.names if x not in ("_group", "_rank")]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), pa.array(seq), pa.array(off)], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(work, StructType(cut.schema.fields).add("sequence_id", "long").add("offset", "long"))


def op4_min_bin_slack(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(written(pieces(docs, tokenizer_file()), "pieces"))


QUERIES = {"op4_min_bin_slack": op4_min_bin_slack}
ORACLES: dict[str, str] = {}
