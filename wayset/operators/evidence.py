"""Evidence for designations: sources that fall through until their region vouches for them, and other data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .aggregate import top_one
from .ordinal import ranked

#: Sources of a claim, the most trusted first.
SOURCES = ("relation", "name", "tag")


def _next(level: Column) -> Column:
    """The first source beyond ``level`` that says something; the number of sources if none does."""
    out = F.lit(len(SOURCES))
    for k in reversed(range(len(SOURCES))):
        out = F.when((level < k) & F.col(SOURCES[k]).isNotNull(), F.lit(k)).otherwise(out)
    return out


def _value() -> Column:
    return F.coalesce(*(F.when(F.col("level") == k, F.col(s)) for k, s in enumerate(SOURCES)))


def _source() -> Column:
    return F.coalesce(*(F.when(F.col("level") == k, F.lit(s)) for k, s in enumerate(SOURCES)))


def fall_through(claims: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Judged designations (id, region, ref, src), and the ledger of rejections (round, id, region, ref, src).

    ``claims`` are (id, region, relation, name, tag). A claim stands on its first source. What fewer than ``least``
    claims of its region stand on, no one vouches for: it is rejected, and its claims fall through to their next
    source. That changes what others can lean on, so judging and rejecting alternate until nothing is rejected. A
    source that was rejected is not tried again, so a claim moves at most once a source and rounds end. A claim whose
    sources are all rejected, or null, has no designation. Support never crosses a region; a null region is one of its
    own. Every round counts by (region, ref) before rows meet, and only counts too small are joined.
    """
    now = stored(claims.select("id", "region", *SOURCES).withColumn("level", _next(F.lit(-1))), "claims")
    ledger = []
    while True:
        standing = now.where(F.col("level") < len(SOURCES)).withColumn("ref", _value())
        weak = standing.groupBy("region", "ref").agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.col("region").alias("__region"), F.col("ref").alias("__ref"))
        is_weak = F.col("region").eqNullSafe(F.col("__region")) & (_value() == F.col("__ref"))
        judged = stored(now.join(weak, is_weak, "left").withColumn("rejected", F.col("__ref").isNotNull()).drop("__region", "__ref"), "judged")
        lost = judged.where("rejected").select(F.lit(len(ledger) + 1).alias("round"), "id", "region", _value().alias("ref"), _source().alias("src"))
        if lost.isEmpty():
            break
        ledger.append(lost)
        now = judged.withColumn("level", F.when(F.col("rejected"), _next(F.col("level"))).otherwise(F.col("level"))).drop("rejected")
    final = now.select("id", "region", _value().alias("ref"), _source().alias("src"))
    empty = final.limit(0).select(F.lit(0).alias("round"), "id", "region", "ref", "src")
    return final, reduce(DataFrame.unionByName, ledger, empty)


def rejections(judged: DataFrame, ledger: DataFrame) -> DataFrame:
    """src, now, n, ids: rejections by the source that was rejected and the one that stands in the end ('none')."""
    final = judged.select("id", F.coalesce("src", F.lit("none")).alias("now"))
    per_id = ledger.join(final, "id").groupBy("src", "now", "id").agg(F.count("*").alias("n"))
    return per_id.groupBy("src", "now").agg(F.sum("n").alias("n"), F.count("*").alias("ids"))


def guaranteed(judged: DataFrame) -> DataFrame:
    """region, ref: what each region vouches for."""
    return judged.where("ref is not null").select("region", "ref").distinct()


def near_pairs(here: DataFrame, there: DataFrame, tx: float, ty: float) -> DataFrame:
    """ax, ay, bx, by, distance of places (x, y) of either side that differ by at most ``tx`` and ``ty``.

    Rows at one place count once, however many they are. Buckets are as wide as the tolerances: a place of ``there``
    lies in its own bucket, one of ``here`` in that and the eight around it, so each pair meets once. The distance is
    the larger of both differences in tolerances.
    """
    bucket = lambda c, t: F.floor(F.col(c) / t)
    around = lambda c, t: F.explode(F.sequence(bucket(c, t) - 1, bucket(c, t) + 1))
    places = lambda side, s: side.select(F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")).distinct()
    a = places(here, "a").withColumn("__x", around("ax", tx)).withColumn("__y", around("ay", ty))
    b = places(there, "b").withColumn("__x", bucket("bx", tx)).withColumn("__y", bucket("by", ty))
    dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    return a.join(b, ["__x", "__y"]).where((dx <= tx) & (dy <= ty)).select("ax", "ay", "bx", "by", F.greatest(dx / tx, dy / ty).alias("distance"))


_A, _B = ["ax", "ay"], ["bx", "by"]


def _numbered(side: DataFrame, s: str) -> DataFrame:
    """id, place and ``rank`` (from 0, by id) of each row at its place; no task ranks a whole place."""
    placed = stored(ranked(side.select("id", "x", "y"), "x", "y", "id"), "ranks")
    first = placed.groupBy("x", "y").agg(F.min("pos").alias("__first"))
    rank = (F.col("pos") - F.col("__first")).alias(f"{s}rank")
    return placed.join(first, ["x", "y"]).select(F.col("id").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"), rank)


def one_to_one(here: DataFrame, there: DataFrame, tx: float, ty: float) -> DataFrame:
    """a, b, distance: the nearest-first choice among rows (id, x, y) of both sides; no a and no b comes twice.

    Ties go to the smaller place, then to the smaller id. Places are matched with as many rows as both have: a pair of
    places that is the best of both would be taken by that choice whatever else is, so all such pairs are taken at
    once and places without a row left fall away, until no pair is left.
    """
    whole = "id is not null and x is not null and y is not null"
    here, there = here.where(whole), there.where(whole)
    left, taken = stored(near_pairs(here, there, tx, ty), "pairs"), []
    counts = {s: side.groupBy(F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")).agg(F.count("*").alias(f"n{s}")).withColumn(f"used{s}", F.lit(0).cast("long")) for s, side in (("a", here), ("b", there))}
    while not left.isEmpty():
        best = top_one(left, _A, "distance", *_B).join(top_one(left, _B, "distance", *_A).select(*_A, *_B), [*_A, *_B])
        known = best.join(counts["a"], _A).join(counts["b"], _B)
        both = stored(known.withColumn("m", F.least(F.col("na") - F.col("useda"), F.col("nb") - F.col("usedb"))).drop("na", "nb"), "taken")
        taken.append(both)
        full = {}
        for s, key in (("a", _A), ("b", _B)):
            now = counts[s].join(both.select(*key, "m"), key, "left").withColumn(f"used{s}", F.col(f"used{s}") + F.coalesce("m", F.lit(0))).drop("m")
            counts[s] = stored(now.where(f"used{s} < n{s}"), "counts")
            full[s] = both.select(*key).join(counts[s].select(*key), key, "left_anti")
        left = stored(left.join(full["a"], _A, "left_anti").join(full["b"], _B, "left_anti"), "pairs")
    if not taken:
        none = here.select(F.col("id").alias("a")).limit(0)
        return none.select("a", F.col("a").alias("b"), F.lit(0.0).alias("distance"))
    spans = reduce(DataFrame.unionByName, taken)
    a, b = _numbered(here, "a"), _numbered(there, "b")
    met = a.join(spans, _A).where("arank >= useda and arank < useda + m").withColumn("brank", F.col("arank") - F.col("useda") + F.col("usedb"))
    return met.join(b, [*_B, "brank"]).select("a", "b", "distance")


def compared(here: DataFrame, there: DataFrame, tx: float, ty: float) -> DataFrame:
    """state ('matched', 'only here', 'only there'), here, there, distance: two sources without a common key.

    Rows are (id, x, y). A row without a measure matches nothing. Places are compared, not rows, so copies cost nothing;
    places that lie close together are as many candidates as their pairs within the tolerances.
    """
    matched = stored(one_to_one(here, there, tx, ty), "matched")
    only_here = here.select(F.col("id").alias("here")).join(matched.select(F.col("a").alias("here")), "here", "left_anti")
    only_there = there.select(F.col("id").alias("there")).join(matched.select(F.col("b").alias("there")), "there", "left_anti")
    out = matched.select(F.lit("matched").alias("state"), F.col("a").alias("here"), F.col("b").alias("there"), "distance")
    out = out.unionByName(only_here.withColumn("state", F.lit("only here")), allowMissingColumns=True)
    return out.unionByName(only_there.withColumn("state", F.lit("only there")), allowMissingColumns=True)
