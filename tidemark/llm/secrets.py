"""Secret scan with corpus-wide ownership frequency.

One pass over the text proposes spans by pattern. Each candidate value is then reduced to a hash, and the hashes are
counted over the whole corpus by distinct owner and distinct repository: a value that many owners have is a copied
example, one that a single owner has and that looks random is live-looking.

Null and empty texts have no spans. Repeated rows stay repeated rows. A null owner or repository counts as one owner
or repository of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash64, small_batches, texts, written

BASE_KINDS = ("assign", "access", "hex")
#: Kinds that this method adds to the base kinds.
ADDED_KINDS = ("issued", "jwt", "pem")
KINDS = BASE_KINDS + ADDED_KINDS

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs: shorter ones fail, so a minimum in the pattern finds the same spans.
_HEX = re.compile(r"[0-9a-f]{32,}")
_ISSUED = re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
_PLACEHOLDER = re.compile(r"example|sample|placeholder|changeme|dummy|your|xxxx|0000|1234|<|\*\*\*", re.IGNORECASE)


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; positions in code points, end exclusive."""
    if not text:
        return []
    found = [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    if "_" in text or "-" in text:
        found += [("issued", *m.span(), m[0]) for m in _ISSUED.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", *m.span(), m[0]) for m in _JWT.finditer(text)]
    if "-----BEGIN " in text:
        found += [("pem", *m.span(), m[0]) for m in _PEM.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


_SPAN = "struct<kind:string,start:long,end:long,value_hash:long,random:boolean>"


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source") -> DataFrame:
    """doc_id, owner, repo, spans array<struct<kind, start, end, value_hash, random>>; values leave only as hashes."""
    own = texts(docs.withColumns({"_owner": F.col(owner_col).cast("string"), "_repo": F.col(repo_col).cast("string")}), id_col, text_col, "_owner", "_repo")

    def work(batches):
        for b in small_batches(batches):
            spans = []
            for text in b.column("text").to_pylist():
                spans.append([
                    {"kind": k, "start": s, "end": e, "value_hash": hash64(v.encode("utf-8", "surrogatepass")), "random": entropy(v) >= 3.0 and not _PLACEHOLDER.search(v)}
                    for k, s, e, v in scan(text)
                ])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_hash", pa.int64()), ("random", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_owner"), b.column("_repo"), pa.array(spans, kind)], ["doc_id", "owner", "repo", "spans"])

    return own.mapInArrow(work, f"doc_id long, owner string, repo string, spans array<{_SPAN}>")


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n_spans, n_owners, n_repos over the whole corpus. Hot values shrink map-side before each shuffle."""
    spans = candidates.select("owner", "repo", F.explode("spans").alias("s")).select("owner", "repo", F.col("s.value_hash").alias("value_hash"))
    # null is an owner of its own, which count(distinct) would leave out
    known = spans.select("value_hash", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"), F.coalesce(F.concat(F.lit("="), "repo"), F.lit("")).alias("repo"))
    pairs = known.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return owners.groupBy("value_hash").agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", copied_from: int = 3, salts: int = 16) -> DataFrame:
    """doc_id, spans (each with n_owners, n_repos and verdict: copied, live or unclear), one row per input row.

    copied: at least `copied_from` owners hold the value. live: one owner holds it and it looks random. Repositories are
    counted within their owner. Each value's statistics are dealt over `salts` partitions, since one value may be in a
    third of all documents.
    """
    found = written(find_candidates(docs, id_col, text_col, owner_col, repo_col), "secrets")
    stats = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # equal rows share one verdict, so they are judged once and joined back by their whole content
    judged = found.filter(F.size("spans") > 0).select("doc_id", "owner", "repo", "spans").distinct()
    keyed = judged.withColumns({"row_hash": F.xxhash64("doc_id", "owner", "repo", F.to_json("spans")), "s": F.explode("spans")})
    keyed = keyed.select("doc_id", "owner", "repo", "row_hash", "s", F.col("s.value_hash").alias("value_hash"), F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(salts)).cast("int").alias("salt"))
    verdict = F.when(F.col("n_owners") >= copied_from, "copied").when((F.col("n_owners") == 1) & F.col("s.random"), "live").otherwise("unclear")
    told = keyed.hint("merge").join(stats, ["value_hash", "salt"]).select(
        "doc_id", "row_hash", F.struct("s.start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("s.kind")).alias("rank"), "s.end", "s.kind", "n_owners", "n_repos", verdict.alias("verdict")).alias("t")
    )
    told = told.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_list("t")).alias("told"))
    rows = found.select("doc_id", F.when(F.size("spans") > 0, F.xxhash64("doc_id", "owner", "repo", F.to_json("spans"))).alias("row_hash"))
    match = rows["doc_id"].eqNullSafe(told["doc_id"]) & (rows["row_hash"] == told["row_hash"])
    return rows.hint("merge").join(told, match, "left").select(rows["doc_id"], F.coalesce("told", F.array().cast(told.schema["told"].dataType)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The result of the query: counts, digest and span list per document."""
    count = lambda k, of="kind": F.size(F.filter("spans", lambda s: s[of] == k)).cast("long")
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        count("copied", "verdict").alias("n_copied"), count("live", "verdict").alias("n_live"),
    )


def op3_secret_ownership(spark, sf_dir: str) -> DataFrame:
    """Owner: source. Repository: source and language, the finest grouping that documents carry."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(scan_secrets(docs.withColumn("repo", F.concat_ws("/", "source", "lang")), owner_col="source", repo_col="repo"))


QUERIES = {"op3_secret_ownership": op3_secret_ownership}
ORACLES: dict[str, str] = {}
