"""N-gram Jaccard join by prefix tree, and the near-duplicate groups that its links make.

1. Each text becomes the set of 64-bit hashes of its n-grams. Texts with equal sets are one class from then on.
2. All n-grams have one global order, written as a 64-bit key (`order_keys`): those in the lowest part of the hash space
   come first, rare ones before frequent ones, then the others by hash. N-grams of that lowest part that a single class
   holds are in no intersection: they stand first in the order, are counted, and not stored.
3. Two sets can only link if they share one of their first |x| - ceil(t |x|) + 1 n-grams (the prefix). The tree is dealt
   out by root: a class lies under the one of its prefix n-grams that most prefixes hold, once. Near copies lie under one
   root, whatever else their prefixes hold. A class visits the roots under which classes with one of its prefix n-grams
   and a fitting size lie; of two roots, the members of the smaller one visit the larger one.
4. Under each root the ordered sets are a trie of bounded size; a root with more of them has several. A visitor walks it
   once: sets that begin alike share the overlap so far, and a subtree is left when the most that can still come (what
   remains of the visitor or of the longest set below) is too little for the smallest set below.
5. First each root's most typical class alone walks its trie, which joins most of a group of near copies with one link a
   member. Then each class visits every root that still holds another component, and passes by subtrees of its own. So the
   result is exact without a cap, and the pairs inside a group are never made.

Null texts and texts without a word have an empty set and link with nothing. A text with fewer words than n has one
n-gram, the whole sequence. Repeated rows are members like others. A row whose id is null links as others do, but no
component is named after it: its component_id is the smallest other id reached, or null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, fields, quoted, release, remove, small_batches, texts, whole_row, worker_cache, written
from .components import connected_components

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_KEPT_WORDS = 200_000
_KEPT_COMPONENTS = 200_000
#: Rows of 24 bytes up to which the classes to be joined are broadcast to the texts.
BROADCAST_ROWS = 500_000
#: Parts of the hash space whose n-grams are counted one after the other.
SLICES = 4
#: A trie holds about so many sets and bytes of them at most (one set at least); a root with more has several tries.
TRIE_SETS, TRIE_BYTES = 512, 2 << 20
#: Bits of an order key that hold the hash; those above hold the number of classes, up to 2047, and the border.
KEY_BITS = 52
#: Tasks over which the classes under one root are dealt where they meet what the root has one row of.
SALTS = 16


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words; ASCII letters in lower case, words between ASCII spaces."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = worker_cache("word hashes", dict)
    if len(known) > _KEPT_WORDS:
        known.clear()
    get, put = known.get, known.__setitem__
    h = []
    for w in words:
        v = get(w)
        if v is None:
            v = xxhash.xxh3_64_intdigest(w)
            put(w, v)
        h.append(v)
    h = np.array(h, np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * _ODD[0]
        out ^= out >> np.uint64(32)
    out = out * _ODD[1]
    return np.unique(out ^ (out >> np.uint64(29)))


def least_overlap(nx, ny, num: int, den: int):
    """The smallest intersection of sets of these sizes with intersection / union >= num / den."""
    return -((-(nx + ny) * num) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -((-n * num) // den) + 1 if n else 0


def _border(num: int, den: int) -> np.uint64:
    """The hashes below this come first in the global order, rare ones ahead: 1.8 times what a prefix takes."""
    return np.uint64(int(min(1.0, 1.8 * (1 - num / den)) * (2**64 - 1)))


def order_keys(members: np.ndarray, border: np.uint64, shared: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The set in the global order, each n-gram as a key that sorts so. members: sorted hashes; shared and held: its n-grams
    below the border that several classes hold, and how many do."""
    early = (np.minimum(held, 2047).astype(np.uint64) << np.uint64(KEY_BITS)) | (shared & np.uint64((1 << KEY_BITS) - 1))
    late = members[np.searchsorted(members, border) :]
    return np.concatenate([np.sort(early), (late >> np.uint64(1)) | np.uint64(1 << 63)])


def fingerprints(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, cid (of the class of equal sets), size, low (hashes below the border), first (the lowest hashes
    that the prefix may need)."""

    def work(batches):
        border = _border(num, den)
        for b in small_batches(batches):
            rows = []
            for text in b.column("text").to_pylist():
                s = ngram_set(text, n)
                low = int(np.searchsorted(s, border))
                cid = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None
                rows.append((cid, len(s), low, s[: max(low, prefix_length(len(s), num, den))].view(np.int64)))
            cid, size, low, first = zip(*rows, strict=True)
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(cid, pa.int64()), pa.array(size, pa.int64()), pa.array(low, pa.int64()), lists],
                ["doc_id", "text_hash", "cid", "size", "low", "first"],
            )

    t = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return t.mapInArrow(work, "doc_id long, text_hash long, cid long, size long, low long, first array<long>")


def shared_grams(classes: DataFrame, rows: int) -> DataFrame:
    """gram, cid, at (place by hash, of those beyond the border only), df: the n-grams that more than one class holds.

    The n-grams are taken in SLICES of the hash space, one after the other, so that only a slice's shuffle files are on
    disk at a time; what stays of each is a small written table."""
    out = None
    for k in range(SLICES):
        held = classes.select("cid", "low", F.posexplode("first").alias("at", "gram")).filter(F.pmod("gram", F.lit(SLICES)) == k)
        held = held.select("cid", "gram", F.when(F.col("at") >= F.col("low"), F.col("at")).alias("at"))
        shared = held.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
        part = written(held.join(shared, "gram"), "shared", rows)
        release(classes.sparkSession)
        out = part if out is None else out.unionByName(part)
    return out


def live_classes(shared: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """cid, size, doc_id and text_hash (of one of its texts), prefix (the shared n-grams in its prefix; classes without one
    are in no pair), early and held (its shared n-grams below the border, and how many classes hold each), typical (the
    mean of that over all its n-grams there)."""
    both = shared.withColumn("late", F.col("at").isNotNull().cast("int"))
    # rare ones first; beyond the border the place is that by hash
    grams = F.sort_array(F.collect_list(F.struct("late", F.when(F.col("late") == 0, F.col("df")).alias("df"), "at", "gram")))
    own = both.groupBy("cid").agg(grams.alias("grams"), F.sum(1 - F.col("late")).cast("int").alias("n"), F.sum(F.when(F.col("late") == 0, F.col("df"))).alias("total"))
    own = own.join(classes.select("cid", "size", "low", "w"), "cid")
    # columns named in a lambda run once an element, so they are plain sums here
    alone = F.col("low") - F.col("n")
    within = F.col("size") - F.expr(f"(size * {num} + {den} - 1) div {den}") + 1
    place = lambda g, k: F.when(g["late"] == 1, g["at"]).otherwise(alone + k)
    prefix = F.transform(F.filter("grams", lambda g, k: place(g, k) < within), lambda g: g["gram"])
    early = F.slice("grams", F.lit(1), F.col("n"))
    typical = (F.coalesce("total", F.lit(0)) + alone) / F.greatest("low", F.lit(1))
    return own.withColumn("prefix", prefix).filter(F.size("prefix") > 0).select(
        "cid", "size", "w.doc_id", "w.text_hash", "prefix",
        F.transform(early, lambda g: g["gram"]).alias("early"), F.transform(early, lambda g: g["df"]).alias("held"), typical.alias("typical"),
    )


def rooted(live: DataFrame) -> DataFrame:
    """gram, cid, size, root: each class's prefix n-grams that another prefix holds too, and the root it lies under."""
    posts = live.select("cid", "size", F.explode("prefix").alias("gram"))
    met = posts.join(posts.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1"), "gram")
    # a window holds one class's prefix
    return met.withColumn("root", F.max(F.struct("m", "gram")).over(Window.partitionBy("cid"))["gram"]).select("gram", "cid", "size", "root")


def sets_of(docs: DataFrame, live: DataFrame, wanted: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """cid, members (the ordered set as order keys) of the wanted classes (cid), made again from one text of each."""
    chosen = live.join(wanted, "cid", "left_semi").select("cid", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"))
    chosen = written(chosen, "chosen", 0)
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)  # so that texts stay where they are; beyond the bound they are shuffled
    t = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    found = t.join(chosen, t["doc_id"].eqNullSafe(F.col("w_id")) & (t["text_hash"] == F.col("w_hash"))).select("cid", "text").dropDuplicates(["cid"])
    whole = found.hint("merge").join(live.select("cid", "early", "held"), "cid")

    def work(batches):
        border = _border(num, den)
        for b in small_batches(batches):
            out = []
            for text, early, held in zip(b.column("text").to_pylist(), b.column("early"), b.column("held"), strict=True):
                shared, many = (np.asarray(x.values, dtype=np.int64) for x in (early, held))
                out.append(order_keys(ngram_set(text, n), border, shared.view(np.uint64), many).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(out, pa.binary())], ["cid", "members"])

    return whole.select("cid", "text", "early", "held").mapInArrow(work, "cid long, members binary")


class Trie:
    """Ordered sets, what they share stored once: a node is a run of members (its own part of the path), its children and
    the sets that end there. `least` is the smallest size of a set below, `most` the longest path, `only` the one component
    of the sets below (none if there are several). The first node has all nodes, parents first."""

    __slots__ = ("run", "children", "ends", "least", "most", "only", "nodes")

    def __init__(self, sets: list[tuple[int, int, np.ndarray]]):
        """sets: (component, size, path), sorted by path; the size counts members that are not in the path too. Built with a
        stack of its own: one branching a member would go too deep for calls."""
        todo, self.nodes = [(self, sets, 0)], []
        while todo:
            node, own, depth = todo.pop()
            self.nodes.append(node)
            first, last = own[0][2], own[-1][2]
            n = min(len(first), len(last))
            differ = np.nonzero(first[depth:n] != last[depth:n])[0]
            node.least, node.most = min(s for _, s, _ in own), max(len(p) for _, _, p in own)
            comps = {c for c, _, _ in own}
            node.only = next(iter(comps)) if len(comps) == 1 else None
            shared = depth + int(differ[0]) if len(differ) else n
            node.run = first[depth:shared]
            node.ends = [(c, s) for c, s, p in own if len(p) == shared]
            rest = [x for x in own if len(x[2]) > shared]
            node.children, at = [], 0
            while at < len(rest):
                to = at + 1
                while to < len(rest) and rest[to][2][shared] == rest[at][2][shared]:
                    to += 1
                child = Trie.__new__(Trie)
                node.children.append(child)
                todo.append((child, rest[at:to], shared))
                at = to

    def links(self, comp: int | None, size: int, probe: np.ndarray, num: int, den: int) -> set[int]:
        """The components other than its own that the probe links with: one walk, the overlap carried along."""
        out, todo = set(), [(self, 0, 0, 0)]
        n = len(probe)
        while todo:
            node, depth, overlap, passed = todo.pop()
            if node.only is not None and (node.only == comp or node.only in out):
                continue
            if overlap + min(n - passed, node.most - depth) < least_overlap(size, node.least, num, den):
                continue
            if len(node.run) and n:
                at = np.searchsorted(probe, node.run)
                overlap += int(np.count_nonzero(probe[np.minimum(at, n - 1)] == node.run))
                depth += len(node.run)
                passed = int(at[-1])
            for c, s in node.ends:
                if c != comp and overlap >= least_overlap(size, s, num, den):
                    out.add(c)
            todo += [(c, depth, overlap, passed) for c in node.children]
        return out

    def join(self, comp: int, size: int, probe: np.ndarray, num: int, den: int, joined: Joined) -> list[tuple[int, int]]:
        """links() that joins what it finds at once, so that the walk passes by all that is joined with the probe by now. The
        pairs told are those that joined two components."""
        out, todo = [], [(self, 0, 0, 0)]
        n, find = len(probe), joined.find
        mine = find(comp)
        while todo:
            node, depth, overlap, passed = todo.pop()
            if node.only is not None and find(node.only) == mine:
                continue
            if overlap + min(n - passed, node.most - depth) < least_overlap(size, node.least, num, den):
                continue
            if len(node.run) and n:
                at = np.searchsorted(probe, node.run)
                overlap += int(np.count_nonzero(probe[np.minimum(at, n - 1)] == node.run))
                depth += len(node.run)
                passed = int(at[-1])
            for c, s in node.ends:
                if find(c) != mine and overlap >= least_overlap(size, s, num, den):
                    mine = joined.join(comp, c)
                    out.append((min(comp, c), max(comp, c)))
            todo += [(c, depth, overlap, passed) for c in node.children]
        return out

    def renew(self, find) -> int:
        """Make `only` anew from what is joined by now; how many components are left."""
        for node in reversed(self.nodes):
            comps = {find(c) for c, _ in node.ends} | {c.only for c in node.children}
            node.only = comps.pop() if len(comps) == 1 else None
        return len({find(c) for node in self.nodes for c, _ in node.ends})


class Joined:
    """Components joined so far by the links that one task has told."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, c: int) -> int:
        up = self.up
        while (a := up.get(c, c)) != c:
            up[c] = c = up.get(a, a)
        return c

    def join(self, a: int, b: int) -> int:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
        return a


def _walk(rows: Iterator[pa.RecordBatch], num: int, den: int, forest: bool = False) -> Iterator[pa.RecordBatch]:
    """a, b: components with a link between them; with forest only links that join what those told before leave apart, so
    there are fewer of them than sets and visitors. Rows come sorted by root, part, block and visits, so a trie's sets are
    there before its visitors, who pass one by one."""
    key, sets, trie = None, [], None
    found: set[tuple[int, int]] = set()
    joined, apart, new = Joined(), 0, 0

    def told():
        a, b = zip(*found, strict=True)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in rows:
        for *own, visits, comp, size, members in zip(*(batch.column(c).to_pylist() for c in ("root", "part", "block", "visits", "comp", "size", "members")), strict=True):
            path = np.frombuffer(members, np.uint64)
            if own != key:
                key, sets, trie = own, [], None
                if found:
                    yield told()
                if len(joined.up) > _KEPT_COMPONENTS:
                    joined = Joined()
            if not visits:
                sets.append((comp, size, path))
                continue
            if trie is None and sets:
                sets.sort(key=lambda x: x[2].byteswap().tobytes())
                trie, sets = Trie(sets), []
                apart, new = trie.renew(joined.find) if forest else 0, 0
            if trie is None:
                continue
            if forest:
                links = trie.join(comp, size, path, num, den, joined)
                found.update(links)
                new += len(links)
                if apart > 1 and 2 * new >= max(16, apart):
                    apart, new = trie.renew(joined.find), 0
            else:
                found.update((min(comp, c), max(comp, c)) for c in trie.links(comp, size, path, num, den))
    if found:
        yield told()


def _salted(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """rows (one a class) joined with a table of one row for each key, which a third of all rows may share: the key's rows
    are dealt over SALTS tasks, its one row goes to each."""
    each = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS))).hint("merge").join(each, [*on, "salt"]).drop("salt")


def walks(stored: DataFrame, visits: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links between components, enough to join all that have one. stored: root, part, cid, comp, size of the sets in tries (parts that nobody visits are
    passed by); visits: the same, of those who walk them. Of the visits inside a part, one goes to the tries with its own
    number or a larger one only."""
    sizes = stored.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / TRIE_SETS), F.ceil(F.col("total") * 8 / TRIE_BYTES)).cast("long")
    sizes = sizes.join(visits.select("root", "part").distinct(), ["root", "part"], "left_semi").select("root", "part", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    cols = ["root", "part", "block", "visits", "cid", "comp", "size"]
    kept = _salted(stored, sizes, ["root", "part"]).withColumns({"block": own, "visits": F.lit(False)}).select(cols)
    each = F.explode(F.sequence(F.when(F.col("inside"), own).otherwise(F.lit(0).cast("long")), F.col("blocks") - 1))
    gone = _salted(visits, sizes, ["root", "part"]).withColumns({"block": each, "visits": F.lit(True)}).select(cols)
    rows = kept.unionByName(gone).hint("merge").join(sets, "cid").drop("cid")
    rows = rows.repartition("root", "part", "block").sortWithinPartitions("root", "part", "block", "visits")
    return rows.mapInArrow(lambda b: _walk(b, num, den, True), "a long, b long").distinct()


def first_round(posts: DataFrame, live: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of each root's most typical class with the others under it."""
    under = posts.select("root", "cid", "size").distinct().join(live.select("cid", "typical"), "cid")
    top = under.groupBy("root").agg(F.max_by(F.struct("cid", "size"), F.struct("typical", "cid")).alias("top"), F.count("*").alias("n")).filter("n > 1")
    stored = under.select("root", F.lit(0).alias("part"), "cid", F.col("cid").alias("comp"), "size")
    visits = top.select("root", F.lit(0).alias("part"), "top.cid", F.col("top.cid").alias("comp"), "top.size", F.lit(False).alias("inside"))
    return walks(stored, visits, sets, num, den)


def second_round(posts: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the components that labels (node, label) leave apart. Under each root its largest component is a part
    of its own, which nobody of that component visits; the rest is the other part."""
    p = posts.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")
    under = p.select("root", "cid", "comp", "size").distinct()
    largest = under.groupBy("root", "comp").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    part = _salted(under, largest, ["root"]).select("cid", (F.col("comp") != F.col("main")).cast("int").alias("part"))
    p = written(p.hint("merge").join(part, "cid"), "posts")
    reach = p.groupBy("gram", "root", "part").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("comp", "size") for f in (F.min, F.max)])
    reach = reach.select(F.col("gram").alias("g"), F.col("root").alias("to"), F.col("part").alias("to_part"), "min_comp", "max_comp", "min_size", "max_size")
    other = ~((F.col("min_comp") == F.col("max_comp")) & (F.col("min_comp") == F.col("comp")))
    fits = (F.col("max_size") * den >= F.col("size") * num) & (F.col("size") * den >= F.col("min_size") * num)
    beyond = (F.col("to") > F.col("root")) | ((F.col("to") == F.col("root")) & (F.col("part") == 1))
    inside = (F.col("to") == F.col("root")) & (F.col("to_part") == F.col("part"))
    met = p.hint("merge").join(reach, F.col("gram") == F.col("g")).filter(other & fits & beyond)
    visits = written(met.select(F.col("to").alias("root"), F.col("to_part").alias("part"), "cid", "comp", "size", inside.alias("inside")).distinct(), "visits")
    stored = p.select("root", "part", "cid", "comp", "size").distinct()
    found = written(walks(stored, visits, sets, num, den), "links")
    remove(visits)
    remove(p)
    return found


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and, if asked for, text_hash (xxhash64 of the text) and label (of the group, whatever
    its ids; null without a word); one row per input row. Links: den * intersection >= num * union."""
    spark = bounded(docs).sparkSession
    marks = written(fingerprints(docs, n, num, den, id_col, text_col), "marks")
    rows = marks.count()
    one_text = F.min(F.struct("doc_id", "text_hash")).alias("w")
    classes = marks.filter("cid IS NOT NULL").groupBy("cid").agg(F.first("size").alias("size"), F.first("low").alias("low"), F.first("first").alias("first"), one_text)
    classes, narrow = written(classes, "classes", rows), written(marks.select("doc_id", "text_hash", "cid", "size"), "members", rows)
    remove(marks)
    release(spark)
    shared = shared_grams(classes, rows)
    live = written(live_classes(shared, classes, num, den), "live", rows)
    remove(classes)
    remove(shared)
    release(spark)
    posts = written(rooted(live), "posts", rows)
    sets = written(sets_of(docs, live, posts.select("cid").distinct(), n, num, den, id_col, text_col), "sets")
    links = written(first_round(posts, live, sets, num, den), "links", rows)
    release(spark)
    labels = connected_components(links)
    more = second_round(posts, labels, sets, num, den)
    for old in (live, posts, sets):
        remove(old)
    release(spark)
    named = connected_components(links.unionByName(more)).withColumnRenamed("node", "cid")
    grouped = narrow.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("least")).join(named, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = grouped.join(least, "label").select("cid", "component_id", "label")
    out = narrow.join(by_class, "cid", "left")
    remove(labels)
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *["text_hash", "label"] * with_hash)


def one_of_each_group(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when each near-duplicate group keeps the document of smallest id. Rows equal in id and
    text are one document; rows of one id in one group keep the smallest text hash; a null id stays unless its group has
    another. Groups are told apart by label, as ids may be null or stand in several groups. Texts without a word are in no
    group, and each stays."""
    named = near_duplicates(docs, n, num, den, id_col, text_col, True)
    alone = [F.when(F.col("label").isNull(), F.col(c)).alias(f"_{c}") for c in ("doc_id", "text_hash")]
    best = named.groupBy("label", *alone).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x"))
    stay = best.select(F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_hash"))
    keyed = docs.select(whole_row(docs), quoted(id_col).cast("long").alias("key"), F.xxhash64(quoted(text_col).cast("string")).alias("hash"))
    kept = keyed.join(stay, F.col("key").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["key", "hash"]).select(*fields(docs))


def op10_prefix_tree_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)


QUERIES = {"op10_prefix_tree_join": op10_prefix_tree_join}
ORACLES: dict[str, str] = {}
