"""Entity resolution: an ambiguous match is no match, and a contradiction stops the ladder.

Keys are name and postcode columns already normalised. Each tier takes the rows that earlier tiers left open; a tier that
rejects a row closes it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stands_alone
from .nearest import nearest


def unique_candidates(reference: DataFrame, keys: list[str], entity: str = "cn") -> DataFrame:
    """keys, entity where exactly one entity has the keys; null keys match nothing."""
    known = reference.dropna(subset=keys).groupBy(*keys).agg(F.min(entity).alias(entity), F.max(entity).alias("_max"))
    return known.filter(F.col(entity) == F.col("_max")).drop("_max")


def resolve(rows: DataFrame, reference: DataFrame, keys: list[str], universe: DataFrame | None = None, entity: str = "cn") -> DataFrame:
    """rows with the entity of a unique candidate, else null. Uniqueness is judged on the whole reference; the universe
    restricts afterwards."""
    found = unique_candidates(reference, keys, entity)
    if universe is not None:
        found = found.join(universe.select(entity).distinct(), entity, "left_semi")
    return rows.join(found, keys, "left")


def _nearest(names: DataFrame, ref: DataFrame, least: float) -> DataFrame:
    """nm, pc, f (r_cn, score): the most similar entity of the same postcode and first word, null if none is similar enough;
    ties by entity. Each name is looked up once, however many rows have it."""
    first = lambda c: F.coalesce(F.split_part(c, F.lit(" "), F.lit(1)), F.lit(""))
    left = names.select("nm", "pc", first(F.col("nm")).alias("w"))
    right = ref.select("r_cn", "r_nm", F.col("r_pc").alias("pc"), first(F.col("r_nm")).alias("w"))
    return nearest(left, right, ["pc", "w"], least, every=True).select("nm", "pc", "f")


def _dealt(by: str, key: str, *more: str) -> Column:
    """Joined on ahead of a key: a hash of it, which sorts faster than texts. A row without the key meets nothing, and goes to
    a task by another column instead of all to one."""
    return F.when(F.col(key).isNull(), F.xxhash64(by)).otherwise(F.xxhash64(key, *more))


def ladder(rows: DataFrame, reference: DataFrame, least: float = 0.9, key: str = "id", number: str = "number", name: str = "nm", area: str = "pc", entity: str = "cn") -> DataFrame:
    """key, entity, confidence, method; every row of `rows` once (key is unique).

    number 1.0: the row's number is an entity. exact 0.95: one entity has name and postcode. rejected: entities have the
    name, none of them the postcode that the row states. unconfirmed 0.6: no postcode, one entity has the name.
    ambiguous: no postcode, several have it. fuzzy: no entity has the name; one of the same first word and postcode is
    similar enough, confidence 0.9 times the similarity. none: nothing."""
    same = rows.schema[number].dataType == reference.schema[entity].dataType
    as_key = lambda c: F.col(c) if same else F.col(c).cast("string")
    ref = reference.select(F.col(entity).alias("r_cn"), F.col(name).alias("r_nm"), F.col(area).alias("r_pc")).filter("r_cn IS NOT NULL")
    r = rows.select(F.col(key).alias("k"), as_key(number).alias("number"), F.col(name).alias("nm"), F.col(area).alias("pc"))
    none = lambda kind: F.lit(None).cast(kind)
    # what a name is known by: with each of its postcodes, and with none
    known = ref.filter("r_nm IS NOT NULL").select(F.col("r_nm").alias("nm"), F.explode(F.array("r_pc", none(ref.schema["r_pc"].dataType))).alias("pc"), "r_cn")
    known = known.groupBy("nm", "pc").agg(F.min("r_cn").alias("lo"), F.max("r_cn").alias("hi"))
    numbers = ref.select(as_key("r_cn").alias("number")).select(F.xxhash64("number").alias("dealt"), "number")
    # names that nobody has, of rows whose number nobody has: each is told once, with its nearest one or without
    strange = r.filter("nm IS NOT NULL AND pc IS NOT NULL").select("number", "nm", "pc").withColumn("dealt", F.xxhash64("nm")).join(ref.select(F.xxhash64("r_nm").alias("dealt"), F.col("r_nm").alias("nm")), ["dealt", "nm"], "left_anti")
    strange = strange.withColumn("dealt", _dealt("nm", "number")).join(numbers, ["dealt", "number"], "left_anti").select("nm", "pc").distinct()
    near = _nearest(strange, ref, least)
    told = known.withColumn("f", none(near.schema["f"].dataType)).withColumn("strange", F.lit(False)).unionByName(near.withColumn("strange", F.lit(True)), allowMissingColumns=True)
    x = r.withColumn("dealt", _dealt("k", "number")).join(numbers.distinct().withColumn("n_cn", F.col("number")), ["dealt", "number"], "left")
    # one look-up with name and postcode; a postcode is missing on its own account
    x = x.select("k", F.when(F.col("n_cn").isNotNull(), F.col("number")).alias("n_cn"), F.when(F.col("n_cn").isNull(), F.col("nm")).alias("nm"), "pc").withColumn("dealt", _dealt("k", "nm", "pc"))
    told = told.select(F.col("nm").alias("t_nm"), F.col("pc").alias("t_pc"), "lo", "hi", "f", "strange", F.xxhash64("nm", "pc").alias("t_dealt"))
    x = x.join(told, (F.col("dealt") == F.col("t_dealt")) & (F.col("nm") == F.col("t_nm")) & F.col("pc").eqNullSafe(F.col("t_pc")), "left")
    placed, one = F.col("pc").isNotNull(), F.col("lo") == F.col("hi")
    tiers = [
        ("number", F.col("n_cn").isNotNull(), F.col("n_cn").cast(reference.schema[entity].dataType), F.lit(1.0)),
        ("exact", placed & one, F.col("lo"), F.lit(0.95)),
        ("rejected", F.col("nm").isNotNull() & placed & ~F.coalesce("strange", F.lit(False)), None, None),
        ("unconfirmed", one, F.col("lo"), F.lit(0.6)),
        ("ambiguous", F.col("lo").isNotNull(), None, None),
        ("fuzzy", F.col("f").isNotNull(), F.col("f.r_cn"), F.round(F.col("f.score") * 0.9, 6)),
    ]
    method, found, sure = None, None, None
    for label, when, who, how in tiers:
        who = F.lit(None).cast(reference.schema[entity].dataType) if who is None else who
        how = F.lit(None).cast("double") if how is None else how
        method, found, sure = ((F.when(when, v) if acc is None else acc.when(when, v)) for acc, v in ((method, F.lit(label)), (found, who), (sure, how)))
    return x.select(F.col("k").alias(key), found.alias(entity), sure.alias("confidence"), method.otherwise("none").alias("method"))


def best_per_entity(matches: DataFrame, entity: str = "cn", key: str = "id") -> DataFrame:
    """The most confident match of each entity; ties by key."""
    alike = [c for c in matches.columns if c != key]  # of rows that differ in nothing else the smallest key stands for all
    w = Window.partitionBy(entity).orderBy(F.desc("confidence"), F.asc(key))
    first = matches.filter(F.col(entity).isNotNull()).groupBy(*alike).agg(F.min(key).alias(key))
    return first.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(matches.columns)


def two_tier(rows: DataFrame, reference: DataFrame, name: str, tiers: list[tuple[str, float]], entity: str = "cn") -> DataFrame:
    """rows with entity and confidence of the first tier (column, confidence) whose name-and-column key is unique."""
    out, found, sure = rows, [], []
    for i, (column, confidence) in enumerate(tiers):
        u = unique_candidates(reference, [name, column], entity).withColumnRenamed(entity, f"_cn{i}")
        out = out.join(u, [name, column], "left")
        found.append(F.col(f"_cn{i}"))
        sure.append(F.when(F.col(f"_cn{i}").isNotNull(), F.lit(confidence)))
    return out.withColumns({entity: F.coalesce(*found), "confidence": F.coalesce(*sure)}).drop(*[f"_cn{i}" for i in range(len(tiers))])


def precision(rows: DataFrame, reference: DataFrame, strategies: dict[str, list[str]], truth: str = "true_cn", entity: str = "cn") -> DataFrame:
    """strategy, n, matched, right: hide the truth, match, compare."""
    out = None
    for label, keys in strategies.items():
        m = rows.join(unique_candidates(reference, keys, entity), keys, "left")
        one = m.agg(F.lit(label).alias("strategy"), F.count("*").alias("n"), F.count(entity).alias("matched"), F.count_if(F.col(entity) == F.col(truth)).alias("right"))
        out = one if out is None else out.unionByName(one)
    return out


def verify_articles(articles: DataFrame, sector_words: dict[str, list[str]], business: list[str], blocked: list[str]) -> DataFrame:
    """articles: k, summary, body, name, town, sector and others, texts in lower case. Adds whether the name stands alone in
    the summary (phrase), the town or a word of the sector anywhere, business words are there, the name is one word
    (single_word) or on the block list (unsearchable), and what follows: verified. The texts are dropped."""
    held = lambda x: F.coalesce(x, F.lit(False))
    words = F.lit(False)
    for sector, own in sector_words.items():
        hit = reduce(or_, [stands_alone(F.col("body"), F.lit(w)) for w in own])
        words = F.when(F.col("sector") == sector, hit).otherwise(words)
    town = held((F.length("town") > 1) & stands_alone(F.col("body"), F.col("town")))
    flags = {
        "phrase": held(stands_alone(F.col("summary"), F.col("name"))), "town": town, "sector": held(words), "context": held(reduce(or_, [F.contains("body", F.lit(w)) for w in business])),
        "single_word": F.size(F.regexp_extract_all("name", F.lit("[a-z0-9]+"), F.lit(0))) <= 1, "unsearchable": F.col("name").isin(*blocked),
    }
    rest = [c for c in articles.columns if c not in ("summary", "body", "name", "town", "sector")]
    out = articles.select(*rest, *[v.alias(k) for k, v in flags.items()])
    return out.withColumn("verified", ~F.col("unsearchable") & F.col("phrase") & (F.col("town") | F.col("sector") | F.col("context")))
