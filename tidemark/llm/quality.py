"""Quality rules with cross-document line frequency, in DataFrame operations alone.

Rules on one text: word and symbol counts, lines and 8-word windows that the text repeats. Rule across texts: lines are
normalised and hashed, the distinct documents of a host that hold each line are counted, lines held by more than
`line_share` of the host's documents (and by more than `least_documents`) are taken out, and a document that keeps too few
of its words is rejected as depleted.

Null texts have no words. Empty texts, and texts without a word, fail the word rule. A null host is a host of its own.
Rows equal in id, host and text are one document and give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, texts, written

SPACE = r"[\x20\x09-\x0D]"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: A line in more than this share of a host's documents is taken out, and in more than so many of a small host.
LINE_SHARE = 0.1
LEAST_DOCUMENTS = 5
#: A document is depleted if fewer than this share of its words, or fewer than LEAST_KEPT words, stay.
LEAST_SHARE = 0.2
LEAST_KEPT = 5
#: Heavy lines are broadcast up to so many rows (of 24 bytes); beyond that the join shuffles.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def window_hashes(w: Column) -> Column:
    """A hash of each window of 8 words, from the words' own hashes; null with fewer words."""
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) >= WINDOW, windows(h)))


def normal_lines(text: Column) -> Column:
    """array<struct<line, words>>: hash and words of each line with a word. Lines are in lower case, digits are 0, runs of
    space are one space; all but the trimming is done on the whole text at once."""
    plain = F.regexp_replace(F.translate(F.lower(text), "0123456789\t\x0b\x0c\r", "0000000000    "), " {2,}", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).cast("long").alias("words")))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One narrow row a document: counts, hashes of its repeated windows' places, and hashes of its lines with their words."""
    t = texts(docs.withColumn("_host", F.col(host_col).cast("string")), id_col, text_col, "_host")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    got = t.select(
        "doc_id", F.col("_host").alias("host"), words(F.col("text")).alias("w"), lines.alias("l"), normal_lines(text).alias("nl"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.xxhash64("text").alias("text_hash"), F.length(text).alias("text_length"),
    )
    # only texts with an equal pair of windows carry them on
    repeated = lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), h)
    of_words = let(F.col("w"), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), let(window_hashes(w), repeated).alias("h")))
    return got.select(
        "doc_id", "host", "text_hash", "text_length", of_words.alias("of_words"), "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.col("nl").alias("l"),
    ).select("doc_id", "host", "text_hash", "text_length", F.col("of_words.n").alias("n_words"), F.col("of_words.chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("of_words.h").alias("h"), "l")


#: What tells documents apart; rows equal in all of it are one document.
KEY = ["doc_id", "host", "text_hash", "text_length"]


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Equal keys; those of `right` have names that end in an underscore."""
    out = None
    for c in KEY:
        same = F.col(c).eqNullSafe(F.col(f"{c}_"))
        out = same if out is None else out & same
    return out


def _by_key(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy(*[F.col(c).alias(f"{c}_") for c in KEY]).agg(value)


def repeated_words(measured: DataFrame) -> DataFrame:
    """The key and n_repeat_words of the documents that repeat a window: the union of the windows' places."""
    from pyspark.sql import Window

    places = measured.filter(F.col("h").isNotNull()).dropDuplicates(KEY).select(*KEY, F.posexplode("h").alias("at", "window"))
    twice = places.withColumn("n", F.count("*").over(Window.partitionBy(*KEY, "window"))).filter(F.col("n") > 1)
    nearest = F.lead("at").over(Window.partitionBy(*KEY).orderBy("at")) - F.col("at")
    new = F.least(F.lit(WINDOW), F.coalesce(nearest, F.lit(WINDOW))).cast("long")
    return _by_key(twice.withColumn("new", new), F.sum("new").alias("n_repeat_words"))


def heavy_lines(documents: DataFrame, line_share: float = LINE_SHARE, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """host, line of the lines in more than line_share of a host's documents. Counts shrink map-side, so a line in a third
    of all documents moves one row a partition; what is left to compare with a host's size is past the floor already."""
    hosts = documents.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("documents"))
    lines = documents.select("host", F.explode(F.array_distinct(F.transform("l", lambda x: x["line"]))).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > least_documents)
    return often.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > line_share * F.col("documents")).select("host", "line")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_share: float = LINE_SHARE, least_documents: int = LEAST_DOCUMENTS, least_share: float = LEAST_SHARE, least_kept: int = LEAST_KEPT) -> DataFrame:
    """doc_id, the counts, base_failed, n_heavy_words (words on lines taken out), kept; one row per input row."""
    measured = written(measure(docs, id_col, text_col, host_col), "quality")
    documents = measured.groupBy(*KEY).agg(F.first("l").alias("l"))
    heavy = written(heavy_lines(documents, line_share, least_documents), "heavy-lines").select(F.col("host").alias("of"), F.col("line").alias("heavy"))
    if heavy.count() <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    lines = documents.select(*KEY, F.explode("l").alias("x"))
    met = lines.join(heavy, F.col("host").eqNullSafe(F.col("of")) & (F.col("x.line") == F.col("heavy")))
    lost = _by_key(met, F.sum("x.words").alias("n_heavy_words"))
    m = measured.drop("h", "l")
    out = m.join(lost, _same(m, lost), "left").drop(*[f"{c}_" for c in KEY])
    repeats = repeated_words(measured)
    out = out.join(repeats, _same(out, repeats), "left")
    repeated, taken = F.coalesce("n_repeat_words", F.lit(0)).cast("long"), F.coalesce("n_heavy_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * F.col("n_words"))
    stays = F.col("n_words") - taken
    depleted = (taken > 0) & ((stays < least_kept) | (stays < least_share * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), failed.alias("base_failed"), taken.alias("n_heavy_words"), (~failed & ~depleted).alias("kept"))


def op9_line_frequency(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows in DuckDB SQL; the fixed values are those above.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS r
  FROM documents),
win AS (SELECT r, p, array_to_string(w[p:p+7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS t(p) WHERE len(w) >= 8),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least(8, coalesce(nxt - p, 8)))::BIGINT AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM twice) GROUP BY r),
x AS (SELECT r, doc_id, host, text, unnest(l) AS line FROM d),
y AS (SELECT r, doc_id, host, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
             len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda z: z <> '')) AS n FROM x),
hosts AS (SELECT host, count(DISTINCT {'i': doc_id, 't': text}) AS documents FROM d GROUP BY host),
often AS (SELECT host, line, count(DISTINCT {'i': doc_id, 't': text}) AS n FROM y GROUP BY host, line),
heavy AS (SELECT often.host, line FROM often JOIN hosts ON often.host IS NOT DISTINCT FROM hosts.host WHERE n > 5 AND n > 0.1 * documents),
lost AS (SELECT r, sum(n)::BIGINT AS n FROM y JOIN heavy ON y.host IS NOT DISTINCT FROM heavy.host AND y.line = heavy.line GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_heavy_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_heavy_words,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND NOT (n_heavy_words > 0 AND (n_words - n_heavy_words < 5 OR n_words - n_heavy_words < 0.2 * n_words)) AS kept
FROM m
"""

QUERIES = {"op9_line_frequency": op9_line_frequency}
ORACLES = {"op9_line_frequency": ORACLE}
