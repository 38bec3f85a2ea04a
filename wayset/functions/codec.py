"""Range lists of numbers ('1-3,5'), delimiter-wrapped sets, and view state as a query string."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The state's switches, all on by default, and the query keys that belong to it.
TOGGLES = ["labels", "termini", "expressway", "special", "ferry"]
MANAGED = ["routes", "conc", *TOGGLES]


@dataclass(frozen=True)
class ViewState:
    """What a view shows: selected designations (none: all), concurrency switch, toggles."""

    selected: frozenset[int] = frozenset()
    conc: str = "off"
    toggles: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(TOGGLES, True))


def parse_refs(text: Column) -> Column:
    """',7,8,' to [7, 8]; empty and null to []; parts that are no number to null."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: p != "")
    return F.transform(parts, lambda p: p.try_cast("int"))


def wrap_refs(refs: Column) -> Column:
    return F.concat(F.lit(","), F.array_join(refs, ","), F.lit(","))


def label_refs(refs: Column) -> Column:
    return F.array_join(F.transform(refs, lambda r: r.cast("string")), "・")


def encode_ranges(rows: DataFrame, key: str, ref: str = "ref") -> DataFrame:
    """Per key, its distinct numbers as sorted runs: 1,2,3,5 to '1-3,5'. Runs are islands of number minus rank."""
    distinct = rows.select(key, ref).where(F.col(ref).isNotNull()).distinct()
    island = F.col(ref) - F.row_number().over(Window.partitionBy(key).orderBy(ref))
    runs = distinct.withColumn("__i", island).groupBy(key, "__i").agg(F.min(ref).alias("a"), F.max(ref).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda r: r["t"]), ",").alias("ranges"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _range_text(a: Column, b: Column) -> Column:
    return F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))


def encode_array(refs: Column) -> Column:
    """The same for an array in one row: a run goes from a number without a predecessor to one without a successor."""

    def runs(r: Column) -> Column:
        first = F.filter(r, lambda x, i: ~F.coalesce(F.get(r, i - 1) == x - 1, F.lit(False)))
        last = F.filter(r, lambda x, i: ~F.coalesce(F.get(r, i + 1) == x + 1, F.lit(False)))
        return F.array_join(F.zip_with(first, last, _range_text), ",")

    return _let(F.array_sort(F.array_distinct(refs)), runs)


#: A part of a range list: a number, or two with a hyphen; nothing around them, no line end after them.
PART = r"\A[0-9]+(-[0-9]+)?\z"
_ENDLESS = 2**63 - 1


def range_bounds(text: Column) -> Column:
    """Valid parts of a range list as [a, b] bounds; malformed and reversed ones are skipped.

    Numbers may have any number of digits: an end beyond 64 bits is the largest such number, and a part that begins
    beyond it is skipped.
    """
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: p.rlike(PART))
    number = lambda p, k: F.substring_index(p, "-", k).try_cast("bigint")
    bounds = F.transform(parts, lambda p: F.struct(number(p, 1).alias("a"), F.coalesce(number(p, -1), F.lit(_ENDLESS)).alias("b")))
    return F.filter(bounds, lambda x: x["b"] >= x["a"])


def decode_ranges(text: Column) -> Column:
    """The numbers of a range list as an array, in its order, repeats kept. For lists that an array can hold;
    ``expand_ranges`` gives rows for any list."""
    return F.flatten(F.transform(range_bounds(text), lambda x: F.sequence(x["a"], x["b"])))


#: Numbers that one step of ``expand_ranges`` holds at once.
_STRETCH = 4096


def expand_ranges(rows: DataFrame, text: str) -> DataFrame:
    """One row per number of each row's range list: ``part`` (from 0, among valid ones) and ``ref``; repeats are kept.

    However wide a range is, no array holds more than a stretch of it; a row without a valid part gives none.
    """
    parts = rows.select("*", F.posexplode(range_bounds(F.col(text))).alias("part", "__r"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__r.b") - F.col("__r.a")) / _STRETCH))
    begun = parts.withColumn("__at", F.explode(steps)).withColumn("__from", F.col("__r.a") + F.col("__at") * _STRETCH)
    numbers = F.sequence(F.col("__from"), F.least(F.col("__r.b"), F.col("__from") + (_STRETCH - 1)))
    return begun.withColumn("ref", F.explode(numbers)).drop("__r", "__at", "__from")


def merge_ranges(text: Column) -> Column:
    """A range list in its one canonical form: sorted, with ranges that touch or overlap joined; nothing is expanded."""

    def grow(runs: Column, x: Column) -> Column:
        def joined(last: Column) -> Column:
            longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
            return F.when(F.coalesce(last["b"] >= x["a"] - 1, F.lit(False)), longer).otherwise(F.concat(runs, F.array(x)))

        return _let(F.try_element_at(runs, F.lit(-1)), joined)

    runs = F.aggregate(F.array_sort(range_bounds(text)), F.array().cast("array<struct<a:bigint,b:bigint>>"), grow)
    return F.array_join(F.transform(runs, lambda x: _range_text(x["a"], x["b"])), ",")


#: Levels of halved number ranges: designations are 32-bit.
_LEVELS = 31


def _blocks(a: Column, b: Column) -> Column:
    """The fewest aligned blocks of 2 ** level numbers that make up a..b: two a level at most, however wide it is."""

    def at(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.ceil(a / width).cast("long"), F.floor((b + 1) / width).cast("long")
        left = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("block")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), at))


def decode_known(rows: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """Rows with each known ``ref`` that their range list covers, once.

    A range is cut into aligned blocks (64 at most) and a known number stands for the blocks that hold it, so the
    two meet in an equi-join and no range is expanded.
    """
    top = 2**_LEVELS - 1
    part = F.explode(F.filter(range_bounds(F.col(text)), lambda x: x["a"] <= top)).alias("__r")
    cut = rows.select("*", part).select("*", F.explode(_blocks(F.col("__r.a"), F.least(F.col("__r.b"), F.lit(top)))).alias("__b"))
    level = F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("__level")
    held = known.select("ref", level).select("ref", "__level", F.call_function("shiftright", F.col("ref").cast("long"), F.col("__level")).alias("__block"))
    met = cut.join(held, (F.col("__b.level") == F.col("__level")) & (F.col("__b.block") == F.col("__block")))
    return met.select(*rows.columns, "ref").distinct()


def decoded(text: Column) -> Column:
    """URL-decoded text; one with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def _pairs(search: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.coalesce(search, F.lit("")), r"\A\?", ""), "&"), lambda p: p != "")


def query_value(search: Column, key: str) -> Column:
    """The first value of a key in a query string ('' for a bare key), decoded; null where the key is absent."""
    first = F.get(F.filter(_pairs(search), lambda p: decoded(F.substring_index(p, "=", 1)) == key), F.lit(0))
    return F.when(first.contains("="), decoded(F.regexp_replace(first, r"\A[^=]*=", ""))).otherwise(F.when(first.isNotNull(), ""))


def decode_state(search: Column) -> list[Column]:
    """A query string's difference from the defaults; null means untouched. ``selected`` is a canonical range list."""
    found = [F.nullif(merge_ranges(query_value(search, "routes")), F.lit("")).alias("selected"), F.when(query_value(search, "conc") == "all", "all").alias("conc")]
    return found + [(query_value(search, k) != "0").alias(k) for k in TOGGLES]


def encode_state(selected: Column, conc: Column, toggles: dict[str, Column]) -> Column:
    """Only what differs from the defaults, as a query string."""
    items = [F.when(F.size(selected) > 0, F.concat(F.lit("routes="), F.url_encode(encode_array(selected)))), F.when(conc != "off", F.concat(F.lit("conc="), conc))]
    items += [F.when(~toggles[k], F.lit(f"{k}=0")) for k in TOGGLES]
    return F.concat_ws("&", *items)


def overlay(diff: Column, current: Column) -> Column:
    return F.coalesce(diff, current)


def replace_managed(search: Column, ours: Column) -> Column:
    """Someone else's keys stay, ours are written anew."""
    others = F.filter(_pairs(search), lambda p: ~decoded(F.substring_index(p, "=", 1)).isin(MANAGED))
    return F.array_join(F.array_compact(F.concat(others, F.array(F.nullif(ours, F.lit(""))))), "&")
