"""Set operations, lookups, comparisons and the re-specified build steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import top_one


def known_only(selection: DataFrame, routes: DataFrame) -> DataFrame:
    """Selected designations that exist. If none is left the selection is empty, which means everything."""
    return selection.join(routes.select("ref"), "ref", "left_semi")


def touched(combos: DataFrame, selection: DataFrame, routes: DataFrame) -> DataFrame:
    """Sets that hold a selected designation, each once; all of them where no selected designation exists.

    ``selection`` is a table (ref), so it may be large: members meet it in a semi-join. Whether any of it is known
    is one number, joined to every row.
    """
    known = known_only(selection, routes)
    hit = combos.select("refs", F.explode("refs").alias("ref")).join(known, "ref", "left_semi").select("refs").distinct().withColumn("__hit", F.lit(True))
    any_known = known.agg((F.count("*") > 0).alias("__any"))
    held = combos.join(hit, "refs", "left").join(F.broadcast(any_known))  # one row
    return held.where(F.coalesce("__hit", F.lit(False)) | ~F.col("__any")).drop("__hit", "__any")


def missing_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which side that is; null keys are one key."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.subtract(right).withColumn("only_in", F.lit("first")).unionByName(right.subtract(left).withColumn("only_in", F.lit("second")))


def with_label(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows with the label of ``key``; one without a label shows the key itself."""
    labels = names.select(F.col("key").alias(key), "label")
    return rows.join(labels, key, "left").withColumn("label", F.coalesce("label", key))


def region_or_default(asked: DataFrame, regions: DataFrame, default: DataFrame) -> DataFrame:
    """Each asked region's extent, or the whole extent (``default``, one row)."""
    whole = default.select(*(F.col(c).alias(f"__{c}") for c in "wset"))
    return asked.join(regions, "region", "left").join(F.broadcast(whole)).select("region", *(F.coalesce(c, f"__{c}").alias(c) for c in "wset"))


def full_compare(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Two builds key by key: added, removed, changed or same."""
    a, b = old.select(F.col(key).alias("k"), F.col(value).alias("old"), F.lit(1).alias("in_old")), new.select(F.col(key).alias("k2"), F.col(value).alias("new"), F.lit(1).alias("in_new"))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, F.col("k").eqNullSafe(F.col("k2")), "full_outer").select(F.coalesce("k", "k2").alias(key), "old", "new", state.alias("state"))


def seam_dedup(builds: DataFrame, key: str = "id", order: str = "region") -> DataFrame:
    """One row per key over overlapping regional builds: the first region's."""
    return top_one(builds, key, order)


def all_ends(shared: DataFrame, single: DataFrame) -> DataFrame:
    """Shared and single ends in one list, shared ones first: refs, place, shared, count."""
    a = shared.select("refs", "place", F.lit(1).alias("shared"))
    b = single.select(F.array("ref").alias("refs"), "place", F.lit(0).alias("shared"))
    return a.unionByName(b).withColumn("count", F.size("refs"))


def shared_ends(ends: DataFrame) -> DataFrame:
    """Places where two or more designations end."""
    met = ends.groupBy("place").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    return met.where(F.size("refs") >= 2)


def single_ends(ends: DataFrame) -> DataFrame:
    """Distinct (ref, place) at places where one designation ends."""
    met = ends.groupBy("place").agg(F.min("ref").alias("ref"), F.max("ref").alias("last"))
    return met.where("ref = last").select("ref", "place")


def judge(relation, name, tag):
    """Source priority of a designation: (value, source) from the first that knows one."""
    return F.coalesce(relation, name, tag), F.when(relation.isNotNull(), "relation").when(name.isNotNull(), "name").when(tag.isNotNull(), "tag")


def corroborate(claims: DataFrame, region: str = "region", least: int = 2) -> DataFrame:
    """Claims whose (region, ref) other evidence in the same region supports ``least`` times."""
    sure = claims.groupBy(region, "ref").agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return claims.join(sure.select(region, "ref"), [region, "ref"], "left_semi")


def leaked(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Designations whose extent passes the expected one."""
    e = expected.select("ref", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    return found.groupBy("ref").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).join(e, "ref").where("lo < __lo or hi > __hi").select("ref", "lo", "hi")


def broken_chains(edges: DataFrame) -> DataFrame:
    """Open ends per designation: nodes that only one of its edges touches; more than two mean a broken chain."""
    nodes = edges.select("ref", F.explode(F.array("a", "b")).alias("node")).groupBy("ref", "node").agg(F.count("*").alias("degree"))
    return nodes.where("degree = 1").groupBy("ref").agg(F.count("*").alias("open_ends"))


def extract(segs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Segments of each region: those whose extent meets the region's box, borders included, so overlaps come twice.

    ``boxes`` (region, w, s, e, t) is the region index, some dozens of rows, which Spark broadcasts by its size.
    """
    b = boxes.select("region", *(F.col(c).alias(f"__{c}") for c in "wset"))
    return segs.join(b, F.expr("w <= __e and e >= __w and s <= __t and t >= __s")).drop("__w", "__s", "__e", "__t")


def usable_box(w: Column, s: Column, e: Column, t: Column) -> Column:
    """A box may be a line or a point; only a reversed or incomplete one is unusable."""
    return F.coalesce((w <= e) & (s <= t), F.lit(False))


def against_expected(found: DataFrame, expected: DataFrame) -> DataFrame:
    """region, fact, found, expected, state for every expectation; another region is another row of ``expected``.

    ``found`` and ``expected`` are (region, fact, value). A fact that was not found counts as 0.
    """
    f, e = found.select("region", "fact", F.col("value").alias("found")), expected.select("region", "fact", F.col("value").alias("expected"))
    both = e.join(f, ["region", "fact"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.withColumn("state", F.when(F.col("found") < F.col("expected"), "low").when(F.col("found") > F.col("expected"), "high").otherwise("ok"))


def chain_ends(edges: DataFrame, low: float, high: float) -> DataFrame:
    """ref, node, x of chain ends: nodes that one edge of a designation touches, but for cuts at the box's edge.

    ``edges`` are (ref, a, ax, b, bx): two nodes and where each lies. A node at or beyond ``low`` or ``high`` was cut
    off there and is no end.
    """
    each = edges.select("ref", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ax").alias("x")), F.struct(F.col("b").alias("node"), F.col("bx").alias("x")))).alias("p"))
    met = each.groupBy("ref", F.col("p.node").alias("node")).agg(F.count("*").alias("degree"), F.min("p.x").alias("x"))
    return met.where((F.col("degree") == 1) & (F.col("x") > low) & (F.col("x") < high)).select("ref", "node", "x")
