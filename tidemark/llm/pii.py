"""Personal data in DataFrame operations alone.

Patterns propose spans, validators (Luhn, mod-97, number ranges) confirm them, and words of context on either side of a
span raise its score. The base kinds stay whatever their score; the added kinds must reach `least_score`.

Positions come without a Python function: a pattern's matches and the text between them (the text split at the same
pattern) have running lengths in code points. The patterns are possessive and start at a run's first letter or at the
last match's end, so each takes time in proportion to the text, and no pattern recurses on a long match.

Null and empty texts have no spans. Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, let, quoted, texts, whole_row, written

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_id")
KINDS = BASE_KINDS + ADDED_KINDS

# The letters and digits of an account number (IBAN) by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_LOCAL = "[A-Za-z0-9._%+-]"
#: A country's numbers have one length, so a word or number that follows is not taken for a part of it.
_IBAN = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: For Java's engine. (?<!x)|\G: a run of x is tried once from its start, and again where the last match ended in it.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: What a text must hold before a kind's pattern is run over it.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Score of a confirmed span without context, and what a context word nearby adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.3}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|server|host|address|login",
    "card": "card|visa|master|amex|credit|payment|pay",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|transfer",
    "national_id": "ssn|social|security|national",
}
CONTEXT_GAIN = 0.35
CONTEXT_WIDTH = 40
#: Matches of one kind that CONTEXT_WIDTH characters may touch: a match and the gap after it hold three at least.
CONTEXT_MATCHES = 14


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled, digits of the products summed."""
    value = lambda d: F.when(d > 9, d - 9).otherwise(d)
    terms = F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(c.try_cast("int") * (1 + i % 2)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether country, check digits and account, with the first four letters last and letters as numbers, leave 1."""
    code = lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    digits = F.concat_ws("", F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), code))
    return F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), lambda a, d: (a * 10 + F.coalesce(d.try_cast("int"), F.lit(0))) % 97) == 1


def confirmed(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.split(match, r"\.")
    low = lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3
    small = F.forall(parts, lambda p: low(p) & (F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .when(kind == "iban", mod97(F.regexp_replace(match, " ", "")))
        .otherwise(~F.substring(match, 1, 3).isin("000", "666") & ~match.startswith("9"))
    )


def proposals(text: Column, kind: str) -> Column:
    """array<struct<gap, match, before, after>>: each match with the length of the text between it and the match before it,
    the end of that text, and the start of the text between it and the next match."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    width = F.lit(CONTEXT_WIDTH)
    pair = lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("match"), F.right(gap, width).alias("before"))
    both = lambda p, gap: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), p["before"].alias("before"), F.left(gap, width).alias("after"))
    none = F.array().cast("array<struct<gap:int,match:string,before:string,after:string>>")
    gaps = lambda m: let(F.split(text, PATTERNS[kind], -1), lambda g: F.zip_with(F.zip_with(F.slice(g, 1, F.size(m)), m, pair), F.slice(g, 2, F.size(m)), both))
    pairs = F.when(F.regexp_like(text, F.lit(PATTERNS[kind])), let(found, gaps)).otherwise(none)
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), pairs) if kind in _NEEDS else pairs


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, text_length, found: proposals by kind. One pass over the text."""
    t = texts(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    per = F.array(*[F.struct(F.lit(i).alias("rank"), F.coalesce(proposals(text, k), F.array()).alias("list")) for i, k in enumerate(KINDS)])
    found = F.filter(per, lambda x: F.size(x["list"]) > 0)
    return t.select("doc_id", F.xxhash64("text").alias("text_hash"), F.length(text).alias("text_length"), found.alias("found"))


def find_spans(found: DataFrame, least_score: float = 0.5) -> DataFrame:
    """text_hash, text_length, spans array<struct<rank, start, end, kind, score>> of the texts that have any, one row for
    equal texts. `found` is what candidates() gives, written."""
    own = ["text_hash", "text_length"]
    one = found.filter(F.size("found") > 0).groupBy(*own).agg(F.first("found").alias("found"))
    m = one.select(*own, F.explode("found").alias("f")).select(*own, F.col("f.rank").alias("rank"), F.posexplode("f.list").alias("n", "m"))
    run = Window.partitionBy(*own, "rank").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    # what stands within CONTEXT_WIDTH characters, matches between included: pieces cut to that width on the far side
    width = F.lit(CONTEXT_WIDTH)
    near = lambda piece, a, z: F.array_join(F.collect_list(piece).over(run.rowsBetween(a, z)), "")
    earlier = near(F.concat("m.before", F.right("m.match", width)), -CONTEXT_MATCHES, -1)
    later = near(F.concat(F.left("m.match", width), "m.after"), 1, CONTEXT_MATCHES)
    m = m.withColumns({
        "end": F.sum(F.col("m.gap") + F.length("m.match")).over(run).cast("long"),
        "before": F.right(F.concat(earlier, "m.before"), width),
        "after": F.left(F.concat("m.after", later), width),
    })
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    by_kind = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("kind"))
    m = m.select(*own, "rank", kind.alias("kind"), F.col("m.match").alias("match"), F.lower("before").alias("before"), F.lower("after").alias("after"), "end")
    near = F.coalesce(*[F.when(F.col("kind") == k, F.col("before").rlike(p) | F.col("after").rlike(p)) for k, p in CONTEXT.items()])
    score = F.least(F.lit(1.0), by_kind(SCORES) + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0)))
    m = m.filter(confirmed(F.col("kind"), F.col("match"))).withColumn("score", score)
    m = m.filter(F.col("kind").isin(*BASE_KINDS) | (F.col("score") >= least_score))
    span = F.struct("rank", (F.col("end") - F.length("match")).alias("start"), "end", "kind", "score")
    return m.groupBy(*own).agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _with_spans(left: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.select(F.col("text_hash").alias("_h"), F.col("text_length").alias("_l"), "spans")
    joined = left.join(s, (F.col("text_hash") == F.col("_h")) & (F.col("text_length") == F.col("_l")), "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))).drop("_h", "_l")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """doc_id, spans; one row per input row."""
    found = written(candidates(docs, id_col, text_col), "pii")
    return _with_spans(found.drop("found"), find_spans(found, least_score)).select("doc_id", "spans")


def redact(docs: DataFrame, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows with each span replaced by its kind in brackets; where spans meet, the one that starts first (then the
    longest) names the whole stretch. Other columns stay as they are, whatever their names."""
    found = written(candidates(docs.select(F.lit(0).alias("doc_id"), quoted(text_col).alias("text"))), "pii")
    spans = find_spans(found, least_score).withColumn("s", F.explode("spans")).select("text_hash", "text_length", "s.start", "s.end", "s.kind")
    own = ["text_hash", "text_length"]
    order = Window.partitionBy(*own).orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("g", F.when(reach > F.col("start"), 0).otherwise(1)).withColumn("g", F.sum("g").over(order))
    merged = marked.groupBy(*own, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    before = F.lag("end", 1, 0).over(Window.partitionBy(*own).orderBy("start"))
    steps = merged.withColumn("from", before).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("from", "start", "end", "kind"))).alias("_steps"))
    steps = steps.select(F.col("text_hash").alias("_h"), F.col("text_length").alias("_l"), "_steps")
    own_text = quoted(text_col).cast("string")
    keyed = docs.select(whole_row(docs), F.xxhash64(own_text).alias("_th"), F.length(F.coalesce(own_text, F.lit(""))).alias("_tl"))
    text = F.col("row").getField(text_col).cast("string")
    out = keyed.join(steps, (F.col("_th") == F.col("_h")) & (F.col("_tl") == F.col("_l")), "left")
    piece = lambda s: F.concat(F.substr(text, (s["from"] + 1).cast("int"), (s["start"] - s["from"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    tail = F.substr(text, (F.element_at("_steps", -1)["end"] + 1).cast("int"))
    rebuilt = F.when(F.col("_steps").isNull(), text).otherwise(F.concat(F.array_join(F.transform("_steps", piece), ""), tail))
    return out.select(*fields(docs, **{text_col: rebuilt}))


def digest(detected: DataFrame) -> DataFrame:
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return detected.select("doc_id", *map(count, BASE_KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op2_pii_spans(spark, sf_dir: str) -> DataFrame:
    return digest(detect(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op2_pii_spans": op2_pii_spans}
ORACLES: dict[str, str] = {}
