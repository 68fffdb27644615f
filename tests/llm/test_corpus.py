"""Operators over the whole corpus, and the pipeline, against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from plain import redacted, runs_covered
from support import SF

from tidemark.llm import jaccard, substrings
from tidemark.llm.components import connected_components


def plain_groups(rows, n, num):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = {i: grams(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed=4, bases=12, copies=9):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for b in range(bases):
        base = r.choices(words, k=r.choice((3, 9, 10, 11, 30, 120, 700)))
        for c in range(copies):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 6, 12)) if len(w) > 20 else r.choice((0, 1))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice(([], [r.choice(words)], [w[k], r.choice(words)]))
            rows.append((b * copies + c, " ".join(w).upper() if c % 4 == 3 else "  ".join(w)))
    return [*rows, (900, None), (901, ""), (902, "one"), (903, "ONE "), (904, "one two")]


@pytest.mark.parametrize(("n", "num", "most"), [(3, 90, 512), (3, 90, 2), (5, 80, 512), (2, 50, 3)])
def test_jaccard_groups(spark, monkeypatch, n, num, most):
    rows = near_copies()
    monkeypatch.setattr(jaccard, "TRIE_SETS", most)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, n, num, 100).collect()}
    assert got == plain_groups(rows, n, num)


def test_jaccard_of_chained_passages(spark):
    """Groups that share passages with one another, and chains whose ends do not link."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    passages = [r.choices(words, k=60) for _ in range(3)]
    rows = []
    for i in range(120):
        w = [*passages[i % 3], *r.choices(words, k=(i // 3) % 12)]
        if i % 5 == 0:
            w = w[: len(w) - i % 7]
        rows.append((1000 - i, " ".join(w)))
    chain = r.choices(words, k=90)
    for i in range(60):
        rows.append((2000 + i, " ".join(chain)))
        chain[(i * 7) % 90] = r.choice(words)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n, num in ((5, 80), (1, 70)):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(df, n, num, 100).collect()}
        assert got == plain_groups(rows, n, num)


def test_order_keys():
    r = np.random.default_rng(3)
    s = np.unique(r.integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2))
    border = jaccard._border(80, 100)
    low = s[s < border]
    held = np.arange(len(low), 0, -1) * 100
    keys = jaccard.order_keys(s, border, low, held)
    assert len(keys) == len(s) and (np.diff(keys.astype(object)) > 0).all()
    first = keys[: len(low)] >> np.uint64(jaccard.KEY_BITS)
    assert first.tolist() == sorted(min(2047, int(x)) for x in held) and (keys[len(low) :] >= np.uint64(1 << 63)).all()
    # an n-gram that no other class holds has no key
    assert np.isin(jaccard.order_keys(s, border, low[1:], held[1:]), keys).all()


def by_path(sets):
    return sorted(sets, key=lambda x: x[2].byteswap().tobytes())


def test_trie_finds_all_links():
    r = np.random.default_rng(2)
    for _ in range(60):
        pool = np.unique(r.integers(0, 1 << 62, 60).astype(np.uint64))
        paths = [np.sort(r.choice(pool, r.integers(1, len(pool)), replace=False)) for _ in range(12)]
        sets = [(k % 7, len(p) + int(r.integers(0, 3)), p) for k, p in enumerate(paths)]
        probe = np.sort(r.choice(pool, r.integers(1, len(pool)), replace=False))
        size, trie = len(probe) + int(r.integers(0, 3)), jaccard.Trie(by_path(sets))
        for num in (50, 80, 90):
            for own in (None, 3):
                shared = lambda p: len(np.intersect1d(p, probe))  # noqa: B023, E731
                want = {c for c, s, p in sets if c != own and 100 * shared(p) >= num * (s + size - shared(p))}
                assert trie.links(own, size, probe, num, 100) == want


def edited_copies(n, size):
    """A set and n copies with one member changed each."""
    base = np.arange(10, 10 * size + 10, 10).astype(np.uint64)
    copies = []
    for k in range(n):
        s = base.copy()
        s[k % size] += np.uint64(1 + k // size)
        copies.append((k, size, s))
    return base, copies


def test_trie_of_many_edited_copies():
    base, copies = edited_copies(3000, 1500)
    assert jaccard.Trie(by_path(copies)).links(None, len(base), base, 90, 100) == set(range(3000))


def test_walk_over_batches():
    base, copies = edited_copies(300, 400)
    rows = [(1, 0, 0, False, k, n, s.tobytes()) for k, n, s in copies] + [(1, 0, 0, True, 1000, 400, base.tobytes()), (1, 0, 0, True, 7, 400, copies[7][2].tobytes())]
    rows += [(1, 0, 1, True, 2000, 400, base.tobytes())]  # a visitor where no set is
    rows += [(2, 1, 0, False, 5000, 400, base.tobytes()), (2, 1, 0, True, 5001, 400, base.tobytes()), (2, 1, 0, True, 5000, 400, base.tobytes()), (2, 1, 0, True, 5002, 100, base[:100].tobytes())]
    cols = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    names = ["root", "part", "block", "visits", "comp", "size", "members"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
    got = {x for out in jaccard._walk(iter([batch.slice(0, 120), batch.slice(120, 181), batch.slice(301)]), 90, 100) for x in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)}
    assert got == {(k, 1000) for k in range(300)} | {(min(7, k), max(7, k)) for k in range(300) if k != 7} | {(5000, 5001)}


def test_many_variants_of_one_text(spark):
    """20,000 one-word variants of one text: one group, and tries of bounded size."""
    from pyspark.sql import functions as F

    base = [f"w{k}" for k in range(200)]
    words = F.transform(F.array(*map(F.lit, base)), lambda w, k: F.when(k == F.col("doc_id") % 200, F.concat(F.lit("x"), F.col("doc_id"))).otherwise(w))
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").select("doc_id", F.concat_ws(" ", words).alias("text"))
    df = df.unionByName(spark.createDataFrame([(99_999, "quite another text " * 9)], "doc_id bigint, text string"))
    got = jaccard.near_duplicates(df, 3, 90, 100).groupBy("component_id").count().collect()
    assert {(r["component_id"], r["count"]) for r in got} == {(0, 20_000), (99_999, 1)}


def test_roots_with_many_tries(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TRIE_SETS", 3)
    rows = near_copies(bases=3, copies=40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100).collect()}
    assert got == plain_groups(rows, 3, 90)


def test_jaccard_edge_rows(spark, docs, empty):
    got = jaccard.near_duplicates(docs, 3, 90, 100).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[3] == {1} and by[11] == {11} and by[4] == {4} and by[5] == {5} and by[None] == {None}
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 not in ids and {1, 2, 4, 5, 6, 10, 11} <= set(ids)
    assert jaccard.one_of_each_group(empty).count() == 0


def test_each_group_keeps_a_document(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(12))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2).upper()), (None, ""), (None, None)]
    rows += [(7, text(3)), (7, text(4)), (7, " "), (8, text(5)), (None, text(5)), (9, text(3))]
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in jaccard.one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    want = [(None, text(0)), (None, text(1)), (None, text(2)), (None, ""), (None, ""), (7, text(3)), (7, text(4)), (7, " "), (8, text(5))]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300) * 7919 % 1009, r.randrange(300) * 7919 % 1009) for _ in range(200)] + [(5000 + i, 5001 + i) for i in range(40)]
    got = {x["node"]: x["label"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_substrings(spark, docs, empty):
    for source in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in source.select("doc_id", "text").collect()]
        out = substrings.dedup_substrings(source)
        assert out.columns == [*(c for c in source.columns if c != "n_removed"), "n_sentences", "n_removed", "words_removed"]
        want = runs_covered(rows)
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(((i, want[i, t]) for i, t in rows), key=repr)
    assert substrings.dedup_substrings(empty).count() == 0


def test_passage_is_removed_once(spark, docs):
    out = {r["doc_id"]: r for r in substrings.dedup_substrings(docs.filter("doc_id IN (1, 2)")).collect()}
    assert out[1]["n_removed"] == 0 and "quick brown fox" in out[1]["text"]
    assert "quick brown fox" not in out[2]["text"] and out[2]["text"].startswith("Another beginning") and out[2]["text"].endswith("its own way.")


def test_ends_of_passages_go(spark, tmp_path):
    r = random.Random(5)
    sentence = lambda k: " ".join(f"w{r.randrange(10**9)}" for _ in range(k)) + ". "
    shapes = [[40, 22], [30, 3], [9, 9, 4], [12, 5, 7, 1], [16, 1], [3, 14], [25, 2, 2], [10, 10, 10, 15]]
    rows, own = [], {}
    for k, shape in enumerate(shapes):
        passage = "".join(map(sentence, shape))
        for i in (2 * k, 2 * k + 1):
            own[i] = (sentence(13), sentence(11), passage)
            rows.append((i, own[i][0] + passage + own[i][1]))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in substrings.op8_sentence_spans(spark, str(tmp_path)).collect()}
    for i, (before, after, passage) in own.items():
        assert got[i]["text"] == (before + after if i % 2 else before + passage + after)
        assert got[i]["words_removed"] == (i % 2) * len(passage.split())


def test_spans_from_both_sides():
    r = random.Random(6)
    for _ in range(300):
        sizes = [r.choice((1, 3, 8, 15, 16, 23, 24, 30)) for _ in range(r.randrange(1, 12))]
        pieces, total = [" ".join(["x"] * k) for k in sizes], lambda a, b: sum(sizes[a:b])  # noqa: B023
        want = set()
        for k in range(len(sizes)):
            want.update([(k, e) for e in range(k + 2, len(sizes) + 1) if total(k, e) >= 16][:1])
            want.update([(a, k + 1) for a in range(k - 1, -1, -1) if total(a, k + 1) >= 16][:1])
        first, length, value, check = substrings.spans(pieces)
        assert list(zip(first.tolist(), (first + length).tolist(), strict=True)) == sorted(want)
        both = {}
        for a, n, v, c in zip(first.tolist(), length.tolist(), value.tolist(), check.tolist(), strict=True):
            assert both.setdefault(tuple(sizes[a : a + n]), (v, c)) == (v, c) and c < 1 << 32
        assert len(set(both.values())) == len(both)
    assert len(substrings.spans(["\n", " ".join("x" * 40)])[0]) == 0


def test_a_span_in_a_third_of_all_documents(spark):
    passage = "one hot passage that stands almost everywhere in this table. it has a second sentence with many words too. "
    rows = [(i, (passage if i % 3 == 0 else "") + f"own words {i} are a {i * 7} text. and {i * 13} more of them.") for i in range(3000)]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("n_removed > 0").collect()
    assert {r["doc_id"] for r in got} == set(range(3, 3000, 3)) and all("hot passage" not in r["text"] for r in got)


def test_sentences_make_up_the_text():
    for t in ("", "a", "A. B! C? D", "x\n\ny  z. \n", "3.14 is pi. \"Yes.\" ok", " . . ."):
        assert "".join(substrings.sentences(t)) == t


def test_pipeline(spark, docs, empty):
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    from tidemark.llm.bpe import tokenizer_file
    from tidemark.llm.common import written

    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = source
    kept = {}
    for name, stage in c.STAGES[:-1]:
        out = written(stage(spark, rows, SF), "t")
        assert out.columns == rows.columns and out.dtypes == rows.dtypes
        kept[name] = {(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()}
        rows = out
    texts = {r["doc_id"]: r["text"] for r in source.select("doc_id", "text").collect()}
    assert kept["language ID"] == {(i, t) for i, t in texts.items() if any(ch.isalpha() for ch in t or "")}
    groups = plain_groups(sorted(kept["language ID"]), 5, 80)
    near = {(i, t) for i, t in kept["language ID"] if groups[i][1] == i}
    assert kept["n-gram Jaccard join"] == near
    clean = runs_covered(sorted(near))
    assert kept["substring dedup"] == {(i, v) for (i, t), v in clean.items() if v == t or v.split()}
    assert kept["PII"] == {(i, redacted(t)) for i, t in kept["substring dedup"]}
    library = Tokenizer.from_file(tokenizer_file())
    want = []
    for i, t in kept["PII"]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, min(2048, len(ids) - k), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    packed = c.run(spark, SF).collect()
    assert sorted(tuple(r[x] for x in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in packed) == sorted(want)
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        ends = [sum(n for _, n in sorted(own)[: k + 1]) for k in range(len(own))]
        assert [at for at, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in packed) // 2048) + 1
    odd = docs  # nulls, repeated rows, other columns under the operators' own names
    for _, stage in c.STAGES[:-1]:
        odd = written(stage(spark, odd, SF), "t")
        assert odd.columns == docs.columns
    assert {None, 1, 2, 8, 9} <= {r["doc_id"] for r in odd.collect()}
    assert c.pack_sequences(spark, odd, SF).count() >= odd.count()
    nothing = empty
    for _, stage in c.STAGES:
        nothing = written(stage(spark, nothing, SF), "t")
    assert nothing.count() == 0


def components(links):
    up = {}
    def find(c):
        while up.setdefault(c, c) != c:
            c = up[c]
        return c
    for a, b in links:
        up[find(a)] = find(b)
    return {frozenset(c for c in up if find(c) == top) for top in {find(c) for c in list(up)}}


def walked(rows, forest, step=70):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    names = ["root", "part", "block", "visits", "comp", "size", "members"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    parts = iter([batch.slice(k, step) for k in range(0, batch.num_rows, step)])
    return [x for out in jaccard._walk(parts, 90, 100, forest) for x in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]


def test_walk_tells_a_forest():
    """Copies that all link with one another, in two tries: joined by fewer links than rows, not by all pairs."""
    _, copies = edited_copies(200, 400)
    rows = [(1, 0, b, v, k, n, s.tobytes()) for b in (0, 1) for v in (False, True) for k, n, s in copies if v or k % 2 == b]
    got = walked(rows, True)
    assert components(got) == components(walked(rows, False)) == {frozenset(range(200))}
    assert len(got) == 199 and len(walked(rows, False)) > 10_000


def test_forest_joins_what_all_links_do():
    r = np.random.default_rng(7)
    for _ in range(40):
        pool = np.unique(r.integers(0, 1 << 62, 50).astype(np.uint64))
        bases = [r.choice(pool, r.integers(20, 40), replace=False) for _ in range(5)]
        rows = []
        for root in range(3):
            for v in (False, True):
                for _ in range(25):
                    k = int(r.integers(0, 60))
                    p = np.sort(r.permutation(bases[k % 5])[int(r.integers(0, 4)) :])
                    rows.append((root, 0, 0, v, k, len(p), p.tobytes()))
        assert components(walked(rows, True)) == components(walked(rows, False))


def test_links_of_many_copies(spark, monkeypatch):
    """900 variants, no two of them alike, each linked with many others but not with the most typical one: links in
    proportion to the variants."""
    told, walks = [], jaccard.walks
    def counted(*args):
        out = walks(*args).persist()
        told.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "walks", counted)
    r = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(900):
        w = list(base)
        for k in r.sample(range(0, 300, 30), 4):
            w[k] = f"x{r.randrange(3)}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100).collect()}
    assert got == plain_groups(rows, 3, 90)
    assert sum(told) < 6 * 900
