"""Roll-up by designation set, and the two ways to sum it: once per member, once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import any_ref

LENGTH = "decimal(18,2)"


def top_one(rows: DataFrame, key: str | list[str], *order: str | Column) -> DataFrame:
    """Each key's first row in ``order``, which should be total. Every task keeps one row of a key before rows move."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__first", first).where("__first = 1").drop("__first")


def extents_by_set(segs: DataFrame) -> DataFrame:
    """refs, n, km, arcs and extent of every distinct set."""
    return segs.groupBy("refs").agg(
        F.max("n").alias("n"), F.sum("km").cast(LENGTH).alias("km"), F.count("*").alias("arcs"), F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("t").alias("t"),
    )


def combine(segs: DataFrame) -> DataFrame:
    """One row per distinct set: refs, n, km, arcs, number of distinct names and the first of them, extent.

    Sets must be sorted and without repeats. Names are counted, not gathered; ``with_names`` lists those of rows that
    are shown. Sums and names are aggregated apart, so that sums need no sort.
    """
    summed = extents_by_set(segs)
    names = segs.where("name <> ''").select("refs", "name").distinct()
    counted = names.groupBy("refs").agg(F.count("*").alias("n_names"))
    first = top_one(names, "refs", "name").withColumnRenamed("name", "first_name")
    named = summed.join(counted.join(first, "refs"), "refs", "left").withColumn("n_names", F.coalesce("n_names", F.lit(0)))
    return named.select("refs", "n", "km", "arcs", "n_names", "first_name", "w", "s", "e", "t")


def with_names(shown: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of a display prefix with the sorted distinct names of their sets.

    ``named`` is (set_key, refs, name) in buckets of sets: only the shown sets' names are gathered, in the tasks that
    read them; what is shuffled is the prefix.
    """
    keyed = shown.withColumn("set_key", F.xxhash64("refs"))
    few = named.join(keyed.select("set_key").distinct(), "set_key", "left_semi")  # a display is small, so Spark sends it to all tasks
    gathered = few.groupBy("set_key", F.col("refs").alias("__refs")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    both = (F.col("k.set_key") == F.col("g.set_key")) & (F.col("k.refs") == F.col("g.__refs"))
    return keyed.alias("k").join(gathered.alias("g"), both, "left").select(*(f"k.{c}" for c in shown.columns), "names")


def sums_by_set(segs: DataFrame) -> DataFrame:
    """refs, n, km, arcs only: what sums need. No list is gathered, so it aggregates partially and in hash maps."""
    return segs.groupBy("refs").agg(F.max("n").alias("n"), F.sum("km").cast(LENGTH).alias("km"), F.count("*").alias("arcs"))


def half_up(x: Column, digits: int = 1) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x * 10**digits + F.lit(0.5).cast("decimal(2,1)")) / 10**digits


def routes_of(combos: DataFrame) -> DataFrame:
    """Per member: km and arcs of every set that holds it, and its deepest set (1 at least). Rounded after summing."""
    each = combos.select(F.explode("refs").alias("ref"), "km", "arcs", "n")
    summed = each.groupBy("ref").agg(F.sum("km").alias("km"), F.sum("arcs").cast("long").alias("arcs"), F.greatest(F.lit(1), F.max("n")).alias("max_n"))
    return summed.withColumn("km", half_up(F.col("km")).cast("double")).orderBy("ref")


def stats_for(combos: DataFrame, selected) -> DataFrame:
    """arcs, km, conc over the sets that touch the selection, each once; zeros where none does."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    deep = F.when(F.col("n") >= 2, F.col("arcs")).otherwise(0)
    return combos.where(any_ref(selected)).agg(zero(F.col("arcs")).cast("long").alias("arcs"), zero(F.col("km")).cast("double").alias("km"), zero(deep).cast("long").alias("conc"))


def depth_histogram(segs: DataFrame) -> DataFrame:
    return segs.groupBy("n").agg(F.count("*").alias("arcs"))


def lengths(combos: DataFrame) -> DataFrame:
    """Real length, and length as designated (each member counts)."""
    return combos.agg(F.sum("km").cast("double").alias("real_km"), F.sum(F.col("km") * F.col("n")).cast("double").alias("designated_km"))


def counts_by(segs: DataFrame, column: str) -> DataFrame:
    return segs.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("arcs"), F.count_if(F.col("former")).alias("former"))


def extent(segs: DataFrame) -> DataFrame:
    return segs.agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("t").alias("t"))


def edit_range(segs: DataFrame) -> DataFrame:
    return segs.agg(F.min("updated").cast("string").alias("oldest_edit"), F.max("updated").cast("string").alias("newest_edit"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last in ``order``; of rows that come last together, the greatest."""
    return top_one(rows, key, F.desc(order), *(F.desc(c) for c in rows.columns if c not in (key, order)))


def bucketed(rows: DataFrame, column: str, width: int = 256) -> DataFrame:
    """Members of each range of ``width`` numbers, sorted."""
    return rows.groupBy((F.floor(F.col(column) / width) * width).cast("long").alias("bucket")).agg(F.array_sort(F.collect_set(column)).alias("members"))


def deepest(hits: DataFrame, key: str = "cell", order: str = "id") -> DataFrame:
    """The hit with most designations per key, the first on a tie; depths may come as text."""
    return top_one(hits, key, F.desc_nulls_last(F.col("n").try_cast("int")), F.asc(order))


def concurrencies(combos: DataFrame, selected) -> DataFrame:
    """Sets of two or more that touch the selection; no selection lists all."""
    return combos.where((F.col("n") >= 2) & any_ref(selected))


def ranking(combos: DataFrame, selected, rows: int = 25) -> DataFrame:
    """Deepest first, then longest, then by set: our order, total so that the prefix is stable."""
    return concurrencies(combos, selected).orderBy(F.desc("n"), F.desc("km"), "refs").limit(rows)


def shown_of_total(matching: DataFrame, rows: int) -> DataFrame:
    total = F.count("*")
    return matching.agg(F.least(total, F.lit(rows)).cast("long").alias("shown"), total.alias("total"))


def tally(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rule, passed, failed: how many rows pass each check, in one pass; a null is a failure."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()]
    seen = rows.agg(F.count("*").alias("__all"), *counts)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("passed"), (F.col("__all") - F.col(name)).alias("failed")) for name in checks)))
    return seen.select(each.alias("c")).select("c.*")
