"""Operators that treat each text on its own (and their corpus statistics) against plain versions."""

import base64
import hashlib
import io
import math
import re
import zlib

import numpy as np
import pytest
from plain import added_spans, base_spans, redacted
from support import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, jpeg, langid, media, packing, pii, quality, secrets, warc
from tidemark.llm.words import Vocabulary

SETTINGS = settings(max_examples=150, deadline=None)


def by_id(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_file())


@pytest.fixture(scope="module")
def encoder():
    v = Vocabulary(bpe.tokenizer_file())
    return bpe.CachedEncoder(bpe.tokenizer_file(), lambda t: [v.number[x] for x in t])


# ---- BPE


@SETTINGS
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdeéßΣσÅ' \n\t12½²\x1c<|>")), max_size=80))
def test_bpe_equals_the_library(library, encoder, text):
    assert sum(encoder.encode_all([text])[0], []) == library.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, docs, empty, library):
    got = by_id(bpe.encode_digests(docs, bpe.tokenizer_file()))
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids))), "decoded_sha256": sha(library.decode(ids, skip_special_tokens=False))})
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encode_digests(empty, bpe.tokenizer_file()).count() == 0


def test_bpe_round_trip(spark, docs, library):
    enc = bpe.encode_texts(docs, bpe.tokenizer_file())
    ids = {(r["doc_id"], tuple(r["ids"])) for r in enc.collect()}
    assert ids == {(r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()}
    said = sorted(r["decoded"] for r in bpe.decode_ids(enc, bpe.tokenizer_file()).collect())
    assert said == sorted(library.decode(list(i), skip_special_tokens=False) for _, i in [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()])


# ---- packing


@SETTINGS
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20))
def test_bins_hold_everything(counts):
    plan = packing.bins(counts, 64)
    used = {}
    for combination, times in plan:
        assert sum(n * c for n, c in combination.items()) <= 64 and times > 0
        for n, c in combination.items():
            used[n] = used.get(n, 0) + c * times
    assert used == counts


def test_bins_are_few():
    r = np.random.default_rng(0)
    n, c = np.unique(np.clip(r.lognormal(6, 1.2, 20000).astype(int), 1, 2048), return_counts=True)
    total = int((n * c).sum())
    assert sum(t for _, t in packing.bins(dict(zip(n.tolist(), c.tolist(), strict=True)))) <= math.ceil(total / 2048) * 1.002


@SETTINGS
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
def test_each_bin_is_the_fullest(lengths):
    left = sorted(lengths)
    for combination, times in packing.bins({n: lengths.count(n) for n in lengths}, 24):
        for _ in range(times):
            # of all bins that hold the longest piece left
            sums = {left[-1] + sum(x for k, x in enumerate(left[:-1]) if m >> k & 1) for m in range(1 << (len(left) - 1))}
            assert sum(n * c for n, c in combination.items()) == max(x for x in sums if x <= 24)
            for n, c in combination.items():
                for _ in range(c):
                    left.remove(n)
    assert not left


def test_packing_query(spark, docs, empty, library):
    from tidemark.llm.common import written

    for source in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = by_id(packing.pack(written(packing.pieces(source, bpe.tokenizer_file()), "t")))
        want = []
        for r in source.collect():
            ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            want += [(r["doc_id"], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
        assert sorted((tuple(g[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for g in got), key=repr) == sorted(want, key=repr)
        sequences = {}
        for g in got:
            sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(sequences) <= math.ceil(sum(g["length"] for g in got) / 2048) + 1
    assert packing.pack(written(packing.pieces(empty, bpe.tokenizer_file()), "t")).count() == 0


# ---- media


@SETTINGS
@given(st.binary(min_size=1, max_size=3000))
def test_jpeg_round_trip(data):
    payload = data + b"\0" * (-len(data) % 64)
    file = jpeg.encode_payload(payload)
    image = jpeg.decode(file)
    assert jpeg.payload_of(image) == payload
    assert image.rgb().shape == (image.height, image.width, 3)


def bits_of(*parts):
    return "".join(format(v, f"0{n}b") for v, n in parts if n)


def closed(s):
    s += "1" * (-len(s) % 8)
    return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def general_file(zz: np.ndarray, interval: int = 0) -> bytes:
    """A grey progressive file of blocks in a row, written symbol by symbol: runs, long runs of zeros, ends of several
    blocks, and refinement of old and new coefficients."""
    seg = jpeg._segment
    n = len(zz)
    table = lambda kind, to, symbols: jpeg._table(kind, to, {8: bytes(symbols)})  # noqa: E731  all codes of eight bits
    dc_symbols, ac_symbols = list(range(12)), sorted({r << 4 | s for r in range(16) for s in range(11)} | {r << 4 for r in range(15)})
    code = {s: format(i, "08b") for i, s in enumerate(ac_symbols)}
    out = [b"\xff\xd8", jpeg._QUANT, seg(0xC2, bytes([8]) + (8).to_bytes(2, "big") + (8 * n).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])), table(0, 0, dc_symbols), table(1, 0, ac_symbols)]
    if interval:
        out.append(seg(0xDD, interval.to_bytes(2, "big")))
    step = interval or n

    def value(v, size):
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def scan(first, last, high, low, write):
        out.append(jpeg._sos([1], first, last, high, low, 0))
        for k in range(0, n, step):
            if k:
                out.append(bytes([0xFF, 0xD0 + (k // step - 1) % 8]))
            out.append(closed(write(zz[k : k + step], low)))

    def dc(blocks, low):
        s, last = "", 0
        for v in (blocks[:, 0] >> low).tolist():
            size = abs(v - last).bit_length()
            s, last = s + format(size, "08b") + value(v - last, size), v
        return s

    def shifted(v, low):
        return (abs(v) >> low) * (1 if v > 0 else -1)

    def ac(first, last):
        def write(blocks, low):
            s, ends = "", 0

            def flush():
                nonlocal s, ends
                if ends:
                    r = ends.bit_length() - 1
                    s += code[r << 4] + (format(ends - (1 << r), f"0{r}b") if r else "")
                    ends = 0

            for b in blocks:
                run, at = 0, first
                values = [shifted(int(v), low) for v in b[first : last + 1]]
                while values and not values[-1]:
                    values.pop()
                for v in values:
                    at += 1
                    if not v:
                        run += 1
                        continue
                    flush()
                    while run > 15:
                        s += code[0xF0]
                        run -= 16
                    size = abs(v).bit_length()
                    s += code[run << 4 | size] + value(v, size)
                    run = 0
                if len(values) < last - first + 1:
                    ends += 1
            flush()
            return s

        return write

    def refine(first, last):
        def write(blocks, low):
            s = ""
            for b in blocks:
                old = [abs(int(v)) >> (low + 1) for v in b[first : last + 1]]
                now = [abs(int(v)) >> low for v in b[first : last + 1]]
                newest = max((i for i, (o, v) in enumerate(zip(old, now, strict=True)) if v and not o), default=-1)
                run, held = 0, ""
                for i, (o, v) in enumerate(zip(old, now, strict=True)):
                    if i > newest:
                        break
                    if o:
                        held += str(v & 1)
                    elif not v:
                        run += 1
                        if run == 16:
                            s += code[0xF0] + held
                            run, held = 0, ""
                    else:
                        s += code[run << 4 | 1] + ("1" if b[first + i] > 0 else "0") + held
                        run, held = 0, ""
                if newest < last - first:
                    rest = held + "".join(str(v & 1) for o, v in list(zip(old, now, strict=True))[newest + 1 :] if o)
                    s += code[0x00] + rest
                else:
                    s += ""
            return s

        return write

    scan(0, 0, 0, 1, dc)
    scan(1, 5, 0, 1, ac(1, 5))
    scan(6, 63, 0, 1, ac(6, 63))
    scan(0, 0, 1, 0, lambda blocks, low: "".join(str(v & 1) for v in blocks[:, 0].tolist()))
    scan(1, 63, 1, 0, refine(1, 63))
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("interval", [0, 3])
@pytest.mark.parametrize("density", [0.02, 0.2, 0.7])
def test_jpeg_general_scans(density, interval):
    r = np.random.default_rng(5)
    for _ in range(8):
        zz = (r.integers(-40, 41, (7, 64)) * (r.random((7, 64)) < density)).astype(np.int32)
        image = jpeg.decode(general_file(zz, interval))
        assert (image.components[0].zz == zz).all()
        assert image.rgb().shape == (8, 56, 3)


def test_inverse_transform():
    zz = np.zeros((1, 64), np.int32)
    zz[0, 0], zz[0, 1] = 80, 16
    p = jpeg.decode(general_file(zz)).rgb()[:, :, 0]
    x = np.arange(8)
    want = np.clip(np.rint(128 + 80 / 8 + 16 * np.sqrt(0.125) * 0.5 * np.cos((2 * x + 1) * np.pi / 16)), 0, 255)
    assert (p == want[None, :]).all()


def test_media_query(spark, docs, empty):
    got = by_id(media.digests(media.store(docs)))
    for r in docs.collect():
        payload, n = media.padded(r["text"])
        want = {"doc_id": r["doc_id"], "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}
        assert any(want.items() <= g.items() for g in got)
    assert len(got) == docs.count() and media.digests(media.store(empty)).count() == 0
    tensors = by_id(media.load(media.store(docs)))
    assert all(len(t["rgb"]) == t["height"] * t["width"] * 3 for t in tensors)
    whole = jpeg.encode_payload(b"x" * 640)
    frame = jpeg._segment(0xC2, b"\x08\xff\xff\xff\xff\x03\x01\x22\0\x02\x11\0\x03\x11\0")
    bad = [b"nothing", None, b"", b"\xff\xd8\xff\xc2", b"\xff\xd8" + frame + b"\xff\xd9", *(whole[:n] for n in range(0, len(whole) - 2, 37)), whole.replace(b"\x08\0", b"\x0c\0", 1)]
    loaded = media.load(spark.createDataFrame(list(enumerate(bad)), "doc_id bigint, media binary")).collect()
    assert len(loaded) == len(bad) and all(r["rgb"] is None for r in loaded)


def test_colour_against_a_direct_transform():
    """Three components at 4:2:0, each sample from the sum that defines the transform."""
    r = np.random.default_rng(9)
    image = jpeg.decode(jpeg.encode_payload(b"\0" * 64 * 12))
    for c in image.components:
        c.zz[:] = r.integers(-60, 61, c.zz.shape) * (r.random(c.zz.shape) < 0.15)
        c.zz[:, 0] = r.integers(-300, 300, len(c.zz))
    order = sorted(range(64), key=lambda k: (k // 8 + k % 8, k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8))
    cosine = lambda x, u: (math.sqrt(0.125) if u == 0 else 0.5 * math.cos((2 * x + 1) * u * math.pi / 16))
    planes = []
    for c in image.components:
        p = np.zeros((c.rows * 8, c.cols * 8))
        for k, zz in enumerate(c.zz):
            f = [0.0] * 64
            for place, v in zip(order, zz.tolist(), strict=True):
                f[place] = v
            for y in range(8):
                for x in range(8):
                    p[k // c.cols * 8 + y, k % c.cols * 8 + x] = sum(f[8 * v + u] * cosine(y, v) * cosine(x, u) for v in range(8) for u in range(8) if f[8 * v + u])
        planes.append(np.clip(np.rint(p + 128), 0, 255))
    h, w = image.height, image.width
    full = [planes[0][:h, :w], *(np.repeat(np.repeat(q, 2, 0), 2, 1)[:h, :w] for q in planes[1:])]
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)
    assert np.abs(image.rgb().astype(float) - want).max() <= 2.5


# ---- PII and secrets

def test_pii_query(spark, docs, empty):
    r = np.random.default_rng(3)
    letters = list("0123456789" * 3 + "....@@--++  ()ab%é😀_")
    odd = [(100 + i, "".join(r.choice(letters, 60))) for i in range(400)]
    for source in (docs, spark.createDataFrame(odd, "doc_id bigint, text string"), spark.read.parquet(f"{SF}/documents.parquet")):
        texts = [(r["doc_id"], r["text"]) for r in source.collect()]
        got = sorted((g["doc_id"], g["base_sha256"]) if g["doc_id"] is not None else (-1, g["base_sha256"]) for g in by_id(pii.digest(pii.detect(source))))
        assert got == sorted((-1 if i is None else i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t)).encode()).hexdigest()) for i, t in texts)
    assert pii.detect(empty).count() == 0


def test_pii_method_adds(spark):
    rows = [(1, "My IBAN is GB82 WEST 1234 5698 7654 32 here"), (2, "iban GB82 WEST 1234 5698 7654 33"), (3, "my social security number 123-45-6789"), (4, "part 123-45-6789 of it")]
    got = {g["doc_id"]: g["spans"] for g in by_id(pii.digest(pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string"))))}
    assert "iban:11:38" in got[1] and "iban" not in got[2] and "national_id:26:37" in got[3] and "national_id" not in got[4]


def test_ibans_and_what_follows(spark):
    uk, de = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    rows = [(1, f"{uk} USED"), (2, f"{uk} 2024"), (3, f"to {uk} and {de}."), (4, f"{uk}{de}"), (5, f"{de} {uk} 1"), (6, f"x{de}"), (7, f"{de}0"), (8, "ZZ89370400440532013000"), (9, f"{uk}a")]
    got = {g["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in g["spans"] if s["kind"] == "iban"] for g in by_id(pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string")))}
    assert got == {i: [s for s in added_spans(t) if s[0] == "iban"] for i, t in rows}
    assert [len(got[i]) for i in range(1, 10)] == [1, 1, 2, 0, 2, 0, 0, 0, 0]


def test_redaction_equals_a_plain_one(spark, docs):
    for source in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = sorted(((r["doc_id"], redacted(r["text"])) for r in source.collect()), key=repr)
        assert sorted(((r["doc_id"], r["text"]) for r in pii.redact(source).collect()), key=repr) == want


def test_pii_context_on_both_sides(spark):
    n, dots = "123-45-6789", "." * 50
    rows = [
        (1, f"SSN: {n}, 234-56-7890"), (2, f"{n} is my SSN"), (3, f"{n} {dots} SSN"), (4, f"SSN {dots} {n}"), (5, f"ssn {n} {dots} {n} {dots} {n}"),
        (6, f"{n}, {n}, {n} ssn"), (7, f"ssn {n}, {n}, {n}, {n}, {n}"), (8, f"{n}{' ' * 37}ssn"), (9, f"{n}{' ' * 38}ssn"), (10, f"ssn{' ' * 37}{n}"), (11, f"ssn{' ' * 38}{n}"),
        (12, f"{'😀' * 37}ssn {n}"), (13, f"ssn{'😀' * 36} {n}"),
    ]
    got = {}
    for g in by_id(pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string"))):
        got[g["doc_id"]] = [(s["start"], s["end"]) for s in g["spans"] if s["kind"] == "national_id"]
    for i, text in rows:
        near = lambda a, b: "ssn" in text[max(0, a - 40) : a].lower() or "ssn" in text[b : b + 40].lower()  # noqa: B023, E731
        assert got[i] == [m.span() for m in re.finditer(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", text) if near(*m.span())], i
    assert len(got[1]) == 2 and len(got[2]) == 1 and len(got[7]) == 3 and not got[3] and not got[4]
    card = f"card {'12,' * 10} 4111 1111 1111 1111"  # matches of its own kind between
    assert [s["score"] for s in pii.detect(spark.createDataFrame([(1, card)], "doc_id bigint, text string")).first()["spans"]] == [1.0]
    assert pii.redact(spark.createDataFrame([(1, f"{n} or 234-56-7890 is my SSN")], "doc_id bigint, text string")).first()["text"] == "[NATIONAL_ID] or [NATIONAL_ID] is my SSN"


def test_redaction(spark, docs):
    rows = [(1, "é mail a@b.cc now"), (2, None), (3, ""), (4, "no data"), (5, "call +1 212 555 0101, 4111 1111 1111 1111!")]
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {1: "é mail [EMAIL] now", 2: None, 3: "", 4: "no data", 5: "call [PHONE], [CARD]!"}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_long_runs_take_linear_time(spark):
    rows = [(1, "a" * 200_000 + " x"), (2, "1" * 200_000), (3, "a.b@" + "c." * 60_000 + "d"), (4, "1.2.3.4." * 30_000)]
    assert pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 4


def test_secrets_query(spark, docs, empty):
    pattern = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    want = []
    for r in docs.collect():
        t = r["text"] or ""
        f = [(m.start(), 0, m.end(), "assign") for m in pattern.finditer(t) if len(m[2]) >= 8]
        f += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want.append((r["doc_id"] or 0, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(f)).encode()).hexdigest()))
    got = by_id(secrets.digest(secrets.scan_secrets(docs)))
    assert sorted((g["doc_id"] or 0, g["base_sha256"]) for g in got) == sorted(want)
    assert secrets.scan_secrets(empty).count() == 0


def test_secret_ownership(spark):
    shared, own = "password: Qw7Tz9LmKp2Xv", "token = 8fJk2LqPz0Rt5Yw"
    rows = [(i, shared, f"o{i}") for i in range(4)] + [(9, own, "o1"), (9, own, "o1")]
    got = {g["doc_id"]: (g["n_copied"], g["n_live"]) for g in by_id(secrets.digest(secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))))}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 0), 3: (1, 0), 9: (0, 1)}


def test_ownership_equals_a_plain_count(spark):
    r = np.random.default_rng(11)
    values = [f"token = k{i}Zq8Lm2Xv{i * 7919}Rt" for i in range(12)]
    rows = [(int(i), " ; ".join(r.choice(values, 3)), None if i % 7 == 0 else f"o{r.integers(0, 4)}", None if i % 5 == 0 else f"r{r.integers(0, 3)}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, owner string, repo string")
    owners, repos = {}, {}
    for _, text, owner, repo in rows:
        for v in text.split(" ; "):
            owners.setdefault(v, set()).add(owner)
            repos.setdefault(v, set()).add((owner, repo))
    got = by_id(secrets.scan_secrets(df, owner_col="owner", repo_col="repo"))
    assert len(got) == len(rows)
    texts = {i: t for i, t, _, _ in rows}
    for g in got:
        assert [(s["n_owners"], s["n_repos"]) for s in g["spans"]] == [(len(owners[v]), len(repos[v])) for v in texts[g["doc_id"]].split(" ; ")]
        assert all((s["verdict"] == "copied") == (s["n_owners"] >= 3) for s in g["spans"])


# ---- language


def test_language(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d.filter(~langid.held_out()))
    out = langid.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, model).collect()]
    assert {i for i, p in got if p == "und"} == {4, 5, 6, 7} and len(got) == docs.count()
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_filter_equals_exact_sets(spark):
    """The filter knows every n-gram of a language's exact set, and others at the rate of its fill alone."""
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL")
    model = langid.fit(d, size=1 << 16)
    held = {}
    for r in d.collect():
        for g in set(langid.grams(r["text"]).tolist()):
            held.setdefault(r["lang"], {}).setdefault(g, []).append(1)
    exact = {x: np.array(sorted(g for g, n in own.items() if len(n) >= langid.LEAST_TEXTS), np.uint64) for x, own in held.items()}
    assert model.languages == sorted(exact)
    every = np.unique(np.concatenate([langid.grams(r["text"]) for r in d.collect()]))
    masks = model.languages_of(every)
    for b, x in enumerate(model.languages):
        said, true = (masks >> np.uint64(b) & np.uint64(1)).astype(bool), np.isin(every, exact[x])
        assert said[true].all()
        assert abs(said[~true].mean() - model.chance[b]) <= 0.02 + 0.3 * model.chance[b]

    def plain(text):
        g = langid.grams(text)
        hits = [int(np.isin(g, exact[x]).sum()) for x in model.languages]
        return model.languages[int(np.argmax(hits))] if len(g) else "und"

    rows = [r for r in d.collect() if len(r["text"]) > 100]
    assert sum(plain(r["text"]) == model.decide(r["text"])[0] for r in rows) >= 0.99 * len(rows)


def test_language_ties_go_to_the_first(spark):
    text = "exactly the same words in both of them"
    both = spark.createDataFrame([(i, text, lang) for i in range(4) for lang in ("xx", "aa")], "doc_id bigint, text string, lang string")
    model = langid.fit(both, least_texts=1)
    assert model.languages == ["aa", "xx"] and model.decide(text)[0] == "aa" and model.decide("1234") == ("und", 0.0, 0.0)


# ---- quality


def plain_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n}


def test_quality_query(spark, docs, empty):
    for source in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = by_id(quality.quality_rules(source))
        want = [(r["doc_id"] or 0, sorted(plain_quality(r["text"]).items())) for r in source.collect()]
        assert sorted((g["doc_id"] or 0, sorted((k, g[k]) for k in plain_quality(""))) for g in got) == sorted(want)
        assert not any(g["kept"] for g in got if g["base_failed"])
    assert quality.quality_rules(empty).count() == 0


def test_quality_depletes_boilerplate(spark):
    line = "cookies are used on this site, and by going on you agree to all of that and to some more things besides"
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)  # noqa: E731  no digits, which are all the same to the rule
    words = lambda p, n: " ".join(f"{p}{name(k)}" for k in range(n))
    rows = [(i, f"{line}\nown {chr(97 + i)}", "h") for i in range(8)] + [(50, f"{line.upper()} \n{words('w', 60)}", "h"), (60, f"{line}\nother", "g")]
    rows += [(70 + i, words(f"c{name(i)}x", 30), "h") for i in range(60)] + [(200 + i, f"{line}\n{words('z', 5)}", None) for i in range(5)]
    rows += [(300, words("r", 30), "r")] * 20  # one document, however often it stands there
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {g["doc_id"]: (g["n_heavy_words"], g["kept"]) for g in by_id(quality.quality_rules(df))}
    assert got[0] == (22, False) and got[50] == (22, True) and got[60] == (0, True)
    assert got[70] == (0, True) and got[200] == (0, True) and got[300] == (0, True)
    # the same share of ten times as many documents
    more = df.filter("doc_id < 200").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select((F.col("doc_id") + 1000 * F.col("k")).alias("doc_id"), "text", "source")
    again = {g["doc_id"]: (g["n_heavy_words"], g["kept"]) for g in by_id(quality.quality_rules(more.filter("source = 'h'")))}
    assert all(again[i + 1000 * k] == got[i] for i in (0, 50, 70) for k in range(10))


def test_line_rule_acts_on_the_tables(spark):
    rows = quality.op9_line_frequency(spark, SF.replace("0.001", "0.01")).filter("n_heavy_words > 0")
    assert rows.count() > 0


# ---- WARC


def test_warc_round_trip(spark):
    from tidemark.llm.common import scratch

    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000), (None, "n", "x" * 300_000), (6, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = scratch(spark, "warc-test")
    mono = warc.write_monolithic(warc.with_revisits(pages), folder)
    members = warc.normalise(mono, folder)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_records(members, folder).collect())
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    x = "x" * 300_000
    want = [(0, "revisit", 5, len(x), sha(x)), (1, "revisit", 2, 9, sha("<p>é</p>")), (2, "response", None, 9, sha("<p>é</p>")), (3, "revisit", 4, 0, sha("")), (4, "response", None, 0, sha("")), (5, "response", None, len(x), sha(x)), (5, "response", None, len(x), sha(x)), (6, "response", None, 12, sha("WARC/1.1\r\n\r\n"))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    store = warc.Store(folder)
    for r in members.collect():
        with store.read(r["name"]) as f:
            whole = f.read()
        starts = 0
        while whole:
            z = zlib.decompressobj(31)
            z.decompress(whole)
            whole, starts = z.unused_data, starts + 1
        assert starts == r["n_records"]


def test_warc_records_are_valid(spark):
    from tidemark.llm.common import scratch

    rows = [(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (None, None, None), (3, "http://c/", "y")]
    folder = scratch(spark, "warc-test")
    mono = warc.write_monolithic(warc.with_revisits(spark.createDataFrame(rows, "page_id bigint, url string, html string")), folder)
    seen = []
    store = warc.Store(folder)
    for r in mono.collect():
        with store.read(r["name"]) as f:
            for head, body in warc.records(warc.inflated(f)):
                h = warc.headers(head)
                assert head.startswith(b"WARC/1.1\r\n") and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(h)
                assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", h["WARC-Record-ID"]) and re.fullmatch(r"\d{4}(-\d\d){2}T\d\d:\d\d:\d\dZ", h["WARC-Date"])
                assert h["Content-Type"] == "application/http; msgtype=response" and body.startswith(b"HTTP/1.1 200 OK\r\n")
                assert not any(k.startswith("WARC-") and k not in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Profile", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date") for k in h)
                if h["WARC-Type"] == "revisit":
                    assert h["WARC-Refers-To-Target-URI"] == "http://b/" and h["X-Refers-To-Page"] == "2"
                seen.append(h["WARC-Record-ID"])
    assert len(seen) == len(set(seen)) == 5


def test_gzip_ends():
    data = b"".join(warc.member(bytes([65 + k]) * 1000) for k in range(3))
    said = lambda raw: b"".join(warc.inflated(io.BytesIO(raw)))
    whole = b"A" * 1000 + b"B" * 1000 + b"C" * 1000
    assert said(data) == whole == said(data + b"\0" * 700_000) and said(b"") == b""
    for cut in (1, 4, 8, 12):
        with pytest.raises((ValueError, zlib.error)):
            said(data[:-cut])


def test_warc_empty(spark):
    from tidemark.llm.common import scratch

    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = scratch(spark, "warc-test")
    assert warc.read_records(warc.normalise(warc.write_monolithic(warc.with_revisits(pages), folder), folder), folder).count() == 0


def test_warc_query(spark, tables):
    from support import rows_of

    df = warc.op7_gzip_normaliser(spark, SF)
    rel = tables.sql(warc.ORACLE)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
