"""Mixing sources to target weights, with DataFrame functions only.

Words per source are summed, targets follow from the weights, and a document is taken floor(rate) times plus one
more time with probability rate - floor(rate), decided by a hash of its id. These copies are drawn systematically:
documents of a source are strata of like length, and in hash order within a stratum as many are taken as keep the
source's count at its fraction. Each copy has the fraction as its probability, as independent draws have, but the
words taken stay within about one long document of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, cut, documents

WEIGHTS = (5, 2, 1)
CAP = 3


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source with its size, weight and target, from rows of (source, size).

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes by weight; one
    that would pass ``cap`` times its source's size stops there and the rest is shared again. The level at which
    that ends is found in one pass over sources ordered by how soon they fill. The windows see one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = by_source.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1).cast("long"))
    fill = Window.orderBy(F.col("cap_words") / F.col("weight"), "rank")
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        weighted.withColumn("cap_words", F.col("source_size") * cap)
        .withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap_words").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_words").cast("double") / F.col("left_weight").cast("double"))
        .withColumn("order", F.row_number().over(fill))
    )
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap_words"), F.struct("order", "level"))).over(whole)
    return level.select("source", "source_size", "weight", F.least(F.col("cap_words").cast("double"), final["level"] * F.col("weight")).alias("target"))


def _key():
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def _hash(seed: str, value):
    """60 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mix"), F.lit(seed), value)), 1, 15), 16, 10).cast("long")


def _draw(seed: str):
    """A document's place in its stratum, by a hash of its id."""
    return _hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


def _stratum():
    """Texts of about one length: a class is 1.28 times as long as the one before it. Some dozens of classes."""
    return F.floor(F.log(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1.0)) * 4).cast("int")


def _plan(docs: DataFrame, weights, cap: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Sizes per document, and per source and stratum what decides its documents' copies: rate and last draw taken.

    A stratum takes floor(part * documents up to it + start) less the same before it, with one hash-seeded start per
    source: so each document is taken with probability ``part``, and strata make up for each other. Those with the
    least draws are taken. The last of them is found from counts of the draws' first 12 bits and an order of the
    documents that share them with it, so no stratum is sorted as a whole.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", "source", size.alias("size"), _key().alias("key"), _stratum().alias("stratum"), _draw(seed).alias("draw")))
    rate = F.least(F.lit(float(cap)), F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)))
    start = _hash(seed + "-start", _key()).cast("double") / F.lit(2.0**60)
    rates = source_targets(sized, weights, cap).select(_key().alias("key"), "source_size", "target", rate.alias("rate"), start.alias("start"))
    by_length = Window.partitionBy("key").orderBy("stratum")  # some dozens of rows a source
    part = F.col("rate") - F.floor("rate")
    taken = lambda upto: F.floor(part * upto + F.col("start"))
    strata = sized.groupBy("key", "stratum").agg(F.count("*").alias("n")).join(rates, "key").withColumn("upto", F.sum("n").over(by_length))
    strata = strata.withColumn("many", taken(F.col("upto")) - taken(F.col("upto") - F.col("n")))
    first = F.shiftright("draw", 48).alias("first")
    by_draw = Window.partitionBy("key", "stratum").orderBy("first")  # 4,096 rows at most
    counts = sized.groupBy("key", "stratum", first).agg(F.count("*").alias("c")).withColumn("below", F.sum("c").over(by_draw) - F.col("c"))
    last = counts.join(strata.select("key", "stratum", "many"), ["key", "stratum"]).where("below < many and many <= below + c").select("key", "stratum", "first", (F.col("many") - F.col("below")).alias("rank"))
    near = sized.select("key", "stratum", first, "draw").join(last, ["key", "stratum", "first"])
    place = F.row_number().over(Window.partitionBy("key", "stratum").orderBy("draw"))  # one in 4,096 of a stratum
    limit = near.withColumn("place", place).where("place = rank").select("key", "stratum", F.col("draw").alias("limit"))
    plan = strata.join(limit, ["key", "stratum"], "left").select("key", "stratum", "source_size", "target", "rate", F.coalesce("limit", F.lit(-1)).alias("limit"))
    return sized, cut(plan)


#: Names the draws; the same seed gives the same mix.
SEED = "0"


def _copies(rate, draw, limit):
    return (F.floor(rate) + F.when(draw <= limit, 1).otherwise(0)).cast("long")


def mix_ledger(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every row of ``docs``.

    Needs doc_id, text and source; other columns are ignored. A null text has size 0; a null source is a source of
    its own, ordered last; a null doc_id draws as the word 'null'. Equal rows draw alike and are all taken alike. An
    empty table gives an empty result; where all sizes are 0, targets and copies are 0. No document is taken more
    than ``cap`` times. Another ``seed`` gives another mix.
    """
    sized, plan = _plan(docs, weights, cap, seed)
    drawn = sized.join(plan, ["key", "stratum"]).withColumn("copies", _copies(F.col("rate"), F.col("draw"), F.col("limit")))
    return drawn.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as often as ``mix_ledger`` takes it.

    Nulls, ties and repeated rows are as there; an empty table gives none. Columns may have any names: they travel in
    a struct of their own. Texts meet one row per source and stratum, which Spark broadcasts while it is small, so
    they need not be shuffled.
    """
    _, plan = _plan(docs, weights, cap, seed)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key().alias("key"), _stratum().alias("stratum"), _draw(seed).alias("draw"))
    copies = _copies(F.col("rate"), F.col("draw"), F.col("limit")).cast("int")
    taken = held.join(plan, ["key", "stratum"]).withColumn("copies", copies).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_mixing(spark, sf_dir):
    return mix_ledger(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def oracle(table: str = "documents", seed: str = SEED) -> str:
    bits = "('0x' || substr(md5('mix:{seed}:' || {value}), 1, 15))::BIGINT"
    draw, start = bits.format(seed=seed, value="coalesce(cast(doc_id AS VARCHAR), 'null')"), bits.format(seed=seed + "-start", value="coalesce('s' || source, 'n')")
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, floor(ln(coalesce(strlen(text), 0) + 1.0::DOUBLE) * 4)::INTEGER AS stratum, {draw} AS draw FROM {table}),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap_words FROM by_source),
ordered AS (SELECT *, row_number() OVER (ORDER BY cap_words::DOUBLE / weight, rank) AS pos FROM weighted),
levels AS (SELECT *, ((SELECT sum(source_size) FROM weighted) - coalesce(sum(cap_words) OVER before, 0))::DOUBLE / ((SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ordered WINDOW before AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level FROM levels WHERE level * weight <= cap_words ORDER BY pos LIMIT 1),
targets AS (SELECT source, source_size, least(cap_words::DOUBLE, (SELECT level FROM final) * weight) AS target FROM weighted),
rates AS (SELECT *, least(3.0::DOUBLE, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size::DOUBLE END) AS rate, {start}::DOUBLE / 1152921504606846976.0::DOUBLE AS start FROM targets),
placed AS (SELECT d.*, r.source_size, r.target, r.rate, r.start, row_number() OVER (PARTITION BY d.source, d.stratum ORDER BY d.draw) AS place FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
strata AS (SELECT source, stratum, any_value(rate) AS rate, any_value(start) AS start, count(*) AS n, sum(count(*)) OVER (PARTITION BY source ORDER BY stratum) AS upto FROM placed GROUP BY source, stratum),
many AS (SELECT source, stratum, (floor((rate - floor(rate)) * upto::DOUBLE + start) - floor((rate - floor(rate)) * (upto - n)::DOUBLE + start))::BIGINT AS many FROM strata),
last AS (SELECT p.source, p.stratum, p.draw AS last FROM placed p JOIN many m ON p.source IS NOT DISTINCT FROM m.source AND p.stratum = m.stratum AND p.place = m.many),
counted AS (SELECT p.*, (floor(rate) + CASE WHEN p.draw <= l.last THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed p LEFT JOIN last l ON p.source IS NOT DISTINCT FROM l.source AND p.stratum = l.stratum)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM counted"""
