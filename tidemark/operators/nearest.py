"""The nearest names of a block by normalised Levenshtein similarity, found without comparing all of a block's pairs.

Two names within k edits become equal when at most k characters are deleted from each. So names meet by the hashes of what
up to two deletions leave of them, and a common head or tail of a cell's names is left out first. Names with one within one
edit need not look further, as that is nearer than any other. Pairs that may be three edits or more apart, and long ones,
are compared by their counts of characters, which bound the distance from below. What remains is compared exactly: short
names beside one another in a band of the matrix, of which a cell tells a name's best only; long ones by Spark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import comb
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell has about so many names of a side; a block with more has several cells.
CELL = 20_000
#: Names longer than this are not met by two deletions.
SHORT = 34
_HASHES = 2_000_000
_STEP = 1 << 16
_AT_ONCE = 50_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def similarity(a: Column, b: Column) -> Column:
    """Normalised Levenshtein similarity from 0 to 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def edits(longest: int, least: float) -> int:
    """How many edits names may be apart of which the longer one has this length."""
    return int((1 - least) * longest + 1e-9)


def left_by_deletions(codes: np.ndarray, k: int) -> np.ndarray:
    """A row of hashes for each row of characters: of what the deletion of any k of them leaves."""
    rows, n = codes.shape
    c = (codes.astype(np.uint64) + np.uint64(1)) * _ODD[1]
    c ^= c >> np.uint64(29)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD[0])]))
    sums = []  # sums[s][i]: of the characters before i, each s places further to the front
    for s in range(k + 1):
        t = np.zeros((rows, n + 1), np.uint64)
        t[:, s + 1 :] = np.cumsum(c[:, s:] * power[: max(n - s, 0)], axis=1, dtype=np.uint64)
        sums.append(t)
    gone = np.array(list(combinations(range(n), k)), np.int64).reshape(comb(n, k), k)
    out, at = np.zeros((rows, len(gone)), np.uint64), 0
    for s in range(k):
        out += sums[s][:, gone[:, s]]
        if s:
            out -= sums[s][:, at]
        at = gone[:, s] + 1
    out += sums[k][:, n : n + 1]
    if k:
        out -= sums[k][:, at]
    out ^= out >> np.uint64(32)
    return out * _ODD[2]


class _Names:
    """The names of one side by length: their numbers and characters between the common head and tail."""

    def __init__(self, names: list[str], head: int, tail: int):
        self.lengths = np.array([len(x) for x in names], np.int64)
        by = defaultdict(list)
        for i, name in enumerate(names):
            by[len(name)].append(i)
        self.by = {n: (np.array(own), np.frombuffer("".join(names[i][head : n - tail] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n - head - tail)) for n, own in by.items()}
        self.place = np.zeros(len(names), np.int64)
        for own, _ in self.by.values():
            self.place[own] = np.arange(len(own))

    def hashed(self, other: _Names, most: int, least: float, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes with the numbers of their names, in portions: after up to `most` deletions, or fewer if no name of the other
        side has a length that allows them."""
        for n, (own, codes) in self.by.items():
            allowed = max((edits(max(n, m), least) for m in other.by if abs(n - m) <= edits(max(n, m), least)), default=-1)
            if wanted is not None:
                own, codes = own[wanted[own]], codes[wanted[own]]
            for k in range(min(most, allowed, codes.shape[1]) + 1):
                if k == 2 and codes.shape[1] > SHORT:
                    continue
                a_name = comb(codes.shape[1], k)
                step = max(1, _STEP // a_name)
                for i in range(0, len(own), step):
                    h = left_by_deletions(codes[i : i + step], k)
                    yield h.ravel(), np.repeat(own[i : i + step], h.shape[1])


def _met(a: _Names, b: _Names, most: int, least: float, wanted: np.ndarray | None = None) -> Pairs:
    """Numbers of names of a and b with an equal hash."""
    for keys, who in _portions(a.hashed(b, most, least, wanted)):
        order = np.argsort(keys)
        keys, who = keys[order], who[order]
        bits = np.uint64(64 - min(24, max(12, len(keys).bit_length() + 3)))
        there = np.zeros(1 << (64 - int(bits)), bool)
        there[keys >> bits] = True
        for h, ids in b.hashed(a, most, least):
            hit = there[h >> bits]
            h, ids = h[hit], ids[hit]
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            hit = hi > lo
            lo, n, ids = lo[hit], (hi - lo)[hit], ids[hit]
            for own in _bounded(n):
                m = n[own]
                at = np.repeat(lo[own] - np.cumsum(m) + m, m) + np.arange(m.sum())
                both = np.unique((who[at].astype(np.int64) << 32) | np.repeat(ids[own], m))
                yield both >> 32, both & 0xFFFFFFFF


def _portions(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= 2 * _HASHES:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _bounded(n: np.ndarray) -> Iterator[slice]:
    """Runs of about _HASHES pairs."""
    total = np.cumsum(n)
    start = 0
    while start < len(n):
        done = total[start - 1] if start else 0
        to = max(start + 1, int(np.searchsorted(total, done + _HASHES)))
        yield slice(start, to)
        start = to


def _by_length(a: _Names, b: _Names, p: np.ndarray, r: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs by their lengths, with the characters of each."""
    both = a.lengths[p] << 32 | b.lengths[r]
    for key in np.unique(both):
        n, m, own = int(key >> 32), int(key & 0xFFFFFFFF), both == key
        yield n, m, p[own], r[own], a.by[n][1][a.place[p[own]]], b.by[m][1][b.place[r[own]]]


def within_one_edit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row of x and that of y are equal, and whether at most one edit apart."""
    n, m = x.shape[1], y.shape[1]
    least, most = min(n, m), max(n, m)
    if abs(n - m) > 1:
        return np.zeros(len(x), bool), np.zeros(len(x), bool)
    stop = np.ones((len(x), 1), bool)
    ahead = np.argmax(np.hstack([x[:, :least] != y[:, :least], stop]), axis=1)
    behind = np.argmax(np.hstack([(x[:, n - least :] != y[:, m - least :])[:, ::-1], stop]), axis=1)
    return (ahead == least) & (n == m), ahead + behind >= most - 1


def distances(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The edits between each row of x and that of y; most + 1 for more than most."""
    n, m = x.shape[1], y.shape[1]
    out = np.full(len(x), most + 1, np.int16)
    for at in range(0, len(x) if abs(n - m) <= most else 0, _AT_ONCE):
        xs, ys = (np.ascontiguousarray(z[at : at + _AT_ONCE].T) for z in (x, y))
        full = lambda v: np.full(xs.shape[1], v, np.int16)
        last = {j: full(j) for j in range(min(m, most) + 1)}
        for i in range(1, n + 1):
            own = {}
            for j in range(max(0, i - most), min(m, i + most) + 1):
                v = last[j - 1] + (xs[i - 1] != ys[j - 1]) if j else full(i)
                if j in last:
                    v = np.minimum(v, last[j] + 1)
                if j - 1 in own:
                    v = np.minimum(v, own[j - 1] + 1)
                own[j] = v
            last = own
        out[at : at + _AT_ONCE] = np.minimum(last[m], most + 1)
    return out


def _by_counts(a: _Names, b: _Names, least: float, wanted: np.ndarray, met: callable) -> Pairs:
    """Pairs whose numbers of equal characters allow the similarity; those that met() tells are left out."""
    def counts(codes):
        out = np.zeros((len(codes), 64), np.int16 if codes.shape[1] < 30_000 else np.int32)
        np.add.at(out, (np.arange(len(codes))[:, None], codes % 64), 1)
        return out

    seen = {}
    for n, (own, codes) in a.by.items():
        fitting = [m for m in b.by if not met(n, m) and abs(n - m) <= edits(max(n, m), least)]
        own, codes = own[wanted[own]], codes[wanted[own]]
        if not fitting or not len(own):
            continue
        mine = counts(codes)
        for m in fitting:
            ids, theirs = b.by[m]
            if m not in seen:
                seen[m] = counts(theirs)
            for i, row in zip(own, mine, strict=True):
                more = np.maximum(seen[m] - row, 0).sum(axis=1)
                hit = ids[np.maximum(more, more + n - m) <= edits(max(n, m), least)]
                if len(hit):
                    yield np.full(len(hit), i), hit


def close_pairs(names: list[str], others: list[str], least: float) -> Pairs:
    """Numbers of names and others that may have the similarity; each name's nearest ones are among them."""
    for p, r, _ in _found(names, others, least):
        yield p, r


def _found(names: list[str], others: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """close_pairs() with the edits of each pair, -1 where they are not known."""
    ends = [min(names), max(names), min(others), max(others)]
    head = len(commonprefix(ends))
    shortest = min(min(map(len, names)), min(map(len, others)))
    back = [x[::-1] for x in (*names, *others)]
    tail = min(len(commonprefix([min(back), max(back)])), shortest - head)
    a, b = _Names(names, head, tail), _Names(others, head, tail)
    edits_of = np.array([edits(n, least) for n in range(1 + max(map(len, (*names, *others))))])
    wanted = np.ones(len(names), bool)
    for p, r in _met(a, b, 1, least):
        for n, m, p1, r1, x, y in _by_length(a, b, p, r):
            equal, near = within_one_edit(x, y)
            enough = equal | (near & (edits(max(n, m), least) >= 1))
            yield p1[enough], r1[enough], np.where(equal[enough], 0, 1)
            if n > 2:  # then two edits are less similar than one
                wanted[p1[enough]] = False
    if not wanted.any():
        return

    def compared(p, r):
        for n, m, p1, r1, x, y in _by_length(a, b, p, r):
            if max(x.shape[1], y.shape[1]) > SHORT:
                yield p1, r1, np.full(len(p1), -1)
                continue
            d = distances(x, y, edits(max(n, m), least))
            enough = d <= edits(max(n, m), least)
            yield p1[enough], r1[enough], d[enough]

    for p, r in _met(a, b, 2, least, wanted):
        longest = np.maximum(a.lengths[p], b.lengths[r])
        enough = edits_of[longest] >= np.maximum(2, np.abs(a.lengths[p] - b.lengths[r]))
        yield from compared(p[enough], r[enough])
    short = lambda n, m: edits(max(n, m), least) <= 1 or (edits(max(n, m), least) == 2 and max(n, m) - head - tail <= SHORT)
    for p, r in _portions(_by_counts(a, b, least, wanted, short)):
        yield from compared(p, r)


class _Best:
    """Of the pairs with known edits, the best one of each name: the most similar, ties by entity."""

    def __init__(self, names: list[str], others: list[str], entities: pa.Array):
        self.lengths, self.others = (np.array([len(x) for x in z], np.int64) for z in (names, others))
        self.rank = np.zeros(len(others), np.int64)
        self.rank[pc.sort_indices(entities, null_placement="at_start").to_numpy()] = np.arange(len(others))
        self.score, self.to, self.edits = np.full(len(names), -1.0), np.full(len(names), -1), np.zeros(len(names), np.int32)

    def add(self, p: np.ndarray, r: np.ndarray, d: np.ndarray) -> None:
        score = 1 - d / np.maximum(np.maximum(self.lengths[p], self.others[r]), 1)
        order = np.lexsort((self.rank[r], -score, p))
        order = order[np.diff(p[order], prepend=-1) != 0]
        p, r, d, score = p[order], r[order], d[order], score[order]
        better = (score > self.score[p]) | ((score == self.score[p]) & (self.rank[r] < self.rank[self.to[p]]))
        self.score[p[better]], self.to[p[better]], self.edits[p[better]] = score[better], r[better], d[better]


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str], least: float, every: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell and side. *keys, nm, r_nm, r_cn, edits: each name's best of the pairs with known edits, and
    the pairs without; with every, also each name alone."""
    def done():
        if not names or not (others or every):
            return
        x, y, cn = pa.array(names, pa.string()), pa.array(others, pa.string()), pa.array(whose, kind)

        def rows(p, r, d):
            for i in range(0, len(p), _AT_ONCE):
                at, to, n = (pa.array(z[i : i + _AT_ONCE], pa.int64(), mask=z[i : i + _AT_ONCE] < 0) for z in (p, r, d))
                same = [pa.array([k] * len(at), pa.string()) for k in key[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*same, x.take(at), y.take(to), cn.take(to), n.cast(pa.int32())], [*keys, "nm", "r_nm", "r_cn", "edits"])

        best = _Best(names, others, cn)
        for p, r, d in _found(names, others, least) if others else ():
            known = d >= 0
            best.add(p[known], r[known], d[known])
            yield from rows(p[~known], r[~known], d[~known])
        told = np.arange(len(names)) if every else np.flatnonzero(best.to >= 0)
        yield from rows(told, best.to[told], np.where(best.to[told] < 0, -1, best.edits[told]))

    key, names, others, whose, kind = None, [], [], [], None
    for batch in batches:
        kind = batch.schema.field("r_cn").type
        for *own, side, name, cn in zip(*(batch.column(c).to_pylist() for c in (*keys, "i", "j", "side", "name", "r_cn")), strict=True):
            if own != key:
                yield from done()
                key, names, others, whose = own, [], [], []
            if side:
                others.append(name)
                whose.append(cn)
            else:
                names.append(name)
    yield from done()


def nearest(names: DataFrame, reference: DataFrame, block: list[str], least: float, every: bool = False) -> DataFrame:
    """*block, nm, f (r_cn, score): the most similar entity of the same block, if it is similar enough; ties by entity. With
    every, f is null for the other names. names: *block, nm, the same once; reference: *block, r_nm, r_cn. A null key or name
    meets nothing and is left out. A block with many names is dealt over cells by the names of both sides."""
    keys = [f"_b{i}" for i in range(len(block))]
    text = [F.col(c).cast("string").alias(k) for c, k in zip(block, keys, strict=True)]
    there = " AND ".join(f"{c} IS NOT NULL" for c in (*keys, "name"))  # what is never null is not computed for it
    a = names.select(*text, F.col("nm").alias("name")).filter(there)
    b = reference.select(*text, F.col("r_nm").alias("name"), "r_cn").filter(there).groupBy(*keys, "name").agg(F.min("r_cn").alias("r_cn"))
    parts = lambda df, n, c: df.groupBy(*keys).agg(F.greatest(F.ceil(F.count(n) / CELL), F.lit(1)).alias(c))
    # counted by r_cn, so that the count reads the same shuffle as the names
    grid = parts(a, "*", "rows").join(parts(b, "r_cn", "columns"), keys, "left" if every else "inner").na.fill(1, ["columns"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("name"), F.col(n))
    kind = reference.schema["r_cn"].dataType
    cols = [*keys, "i", "j", "side", "name", "r_cn"]
    left = a.join(grid, keys).withColumns({"i": own("rows"), "j": each("columns"), "side": F.lit(False), "r_cn": F.lit(None).cast(kind)}).select(cols)
    right = b.join(grid, keys).withColumns({"i": each("rows"), "j": own("columns"), "side": F.lit(True)}).select(cols)
    dealt = left.unionByName(right).repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "side")
    pairs = dealt.mapInArrow(lambda rows: _cells(rows, keys, least, every), ", ".join([*(f"{k} string" for k in keys), "nm string", "r_nm string", f"r_cn {kind.simpleString()}", "edits int"]))
    longest = F.greatest(F.length("nm"), F.length("r_nm"), F.lit(1))
    near = pairs.withColumn("score", F.when(F.col("edits").isNotNull(), 1 - F.col("edits") / longest).otherwise(similarity(F.col("nm"), F.col("r_nm"))))
    enough = F.when(F.col("r_nm").isNotNull() & (F.col("score") >= least), F.struct(-F.col("score"), F.col("r_cn")))
    best = near.groupBy(*keys, "nm").agg(F.min_by(F.struct("r_cn", "score"), enough).alias("f"))
    best = best if every else best.filter("f IS NOT NULL")
    schema = names.schema
    return best.select(*[F.col(k).cast(schema[c].dataType).alias(c) for k, c in zip(keys, block, strict=True)], "nm", "f")
