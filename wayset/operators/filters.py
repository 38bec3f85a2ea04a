"""Membership, category and selection filters, and a small expression tree compiled to Columns."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds, and the layers that the shared filter is applied to (id, kinds, negated, toggle).
FOOT, CONSTRUCTION, UNOPENED, FERRY, EXPRESSWAY = ["foot", "steps"], ["construction"], ["unopened"], ["ferry"], ["expressway"]
SPECIAL = [*CONSTRUCTION, *UNOPENED, *FOOT, *FERRY]
NOT_ROADS = [*SPECIAL, *EXPRESSWAY]
LAYERS = [
    ("casing", NOT_ROADS, True, None),
    ("roads", NOT_ROADS, True, None),
    ("expressway-casing", EXPRESSWAY, False, "expressway"),
    ("expressway", EXPRESSWAY, False, "expressway"),
    ("construction", CONSTRUCTION, False, "special"),
    ("unopened", UNOPENED, False, "special"),
    ("foot", FOOT, False, "special"),
    ("ferry", FERRY, False, "ferry"),
    ("route-labels", None, False, "labels"),
]
CLICKABLE = ["roads", "expressway", "construction", "unopened", "foot", "ferry"]
MINZOOM = {"route-labels": 8, "termini-label": 9}


def has_ref(ref: int) -> Column:
    return F.array_contains("refs", ref)


def has_ref_text(ref: int, column: str = "refs_s") -> Column:
    """The same on the delimiter-wrapped form; ',4,' never matches ',14,'."""
    return F.col(column).contains(f",{ref},")


def any_ref(selected) -> Column:
    """Any of the selected designations; no selection means everything."""
    return F.arrays_overlap("refs", F.array(*map(F.lit, sorted(selected)))) if selected else F.lit(True)


def shared_filter(selected, conc: str = "off") -> Column:
    """Selection and concurrency; depth belongs to the segment, not to the selection."""
    parts = [any_ref(selected)] if selected else []
    if conc == "all":
        parts.append(F.col("n") >= 2)
    return reduce(and_, parts, F.lit(True))


def of_kind(kinds: list[str], negate: bool = False) -> Column:
    """Kind in a list; a null kind is in no list, so the negation keeps it."""
    inside = F.coalesce(F.col("kind").isin(kinds), F.lit(False))
    return ~inside if negate else inside


def nothing() -> Column:
    """Matches no row."""
    return F.lit(False)


def picked(base: Column, id_: int | None) -> Column:
    return nothing() if id_ is None else base & (F.col("id") == id_)


def layer_filter(layer: tuple, base: Column, toggles: dict[str, bool]) -> Column:
    """A layer's filter: nothing if its toggle is off, else the base narrowed by its kinds if it has any."""
    _, kinds, negate, toggle = layer
    if toggle is not None and not toggles.get(toggle, True):
        return nothing()
    return base if kinds is None else base & of_kind(kinds, negate)


def dispatch(segs: DataFrame, base: Column, toggles: dict[str, bool] | None = None) -> DataFrame:
    """Segments with the layers that draw them, one row each; one pass, no join."""
    hits = [F.when(layer_filter(layer, base, toggles or {}), F.lit(layer[0])) for layer in LAYERS]
    return segs.withColumn("layer", F.explode(F.array_compact(F.array(*hits))))


def layer_sums(segs: DataFrame, base: Column, toggles: dict[str, bool] | None = None, layers: list[str] | None = None) -> DataFrame:
    """layer, arcs, ids: how many segments each layer draws and the sum of their ids, in one pass without a row per layer.

    Layers that draw nothing are left out, as are those not in ``layers``.
    """
    shown = [layer for layer in LAYERS if layers is None or layer[0] in layers]
    tests = {layer[0]: layer_filter(layer, base, toggles or {}) for layer in shown}
    totals = segs.agg(*(F.struct(F.count_if(t).alias("arcs"), F.sum(F.when(t, F.col("id"))).alias("ids")).alias(name) for name, t in tests.items()))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("layer"), F.col(f"`{name}`.arcs").alias("arcs"), F.col(f"`{name}`.ids").alias("ids")) for name in tests)))
    return totals.select(each.alias("l")).select("l.*").where("arcs > 0")


def ends_filter(selected, shown: bool = True) -> Column:
    """Ends follow the selection only, never the concurrency switch."""
    return any_ref(selected) if shown else nothing()


def visible(zoom: float, layer: str) -> Column:
    return F.lit(zoom) >= F.lit(MINZOOM.get(layer, 0))


def prefix_search(column: str, query: str) -> Column:
    """Numbers that begin with the trimmed query; an empty one keeps all."""
    return F.col(column).cast("string").startswith(query.strip()) if query.strip() else F.lit(True)


def allowed(column: Column, values: list[str], default: str) -> Column:
    """The value if it is in the list, else the default."""
    return F.when(column.isin(values), column).otherwise(F.lit(default))


def interpolate(x: Column, stops: list[tuple[float, Column]]) -> Column:
    """Piecewise linear between stops, constant outside them."""
    out = F.when(x <= stops[0][0], stops[0][1])
    for (a, u), (b, v) in zip(stops, stops[1:], strict=False):
        out = out.when(x <= b, u + (v - u) * ((x - a) / (b - a)))
    return out.otherwise(stops[-1][1])


def compile_expr(tree, zoom: Column | None = None) -> Column:
    """A JSON expression tree as a Column. Comparisons and memberships with a null are false, not null."""
    if not isinstance(tree, list):
        return F.lit(tree)
    op, *args = tree
    sub = lambda t: compile_expr(t, zoom)
    sure = lambda c: F.coalesce(c, F.lit(False))
    if op == "get":
        return F.col(args[0])
    if op == "zoom":
        return zoom
    if op == "literal":
        return F.array(*map(F.lit, args[0])) if isinstance(args[0], list) else F.lit(args[0])
    if op == "in":
        if isinstance(args[1], list) and args[1][0] == "literal":
            return sure(sub(args[0]).isin(args[1][1]))
        return sure(F.contains(sub(args[1]), sub(args[0])))
    if op in ("any", "all"):
        return reduce(or_ if op == "any" else and_, map(sub, args), F.lit(op == "all"))
    if op == "!":
        return ~sub(args[0])
    if op in ("==", ">="):
        a, b = map(sub, args)
        return sure(a == b if op == "==" else a >= b)
    if op in ("*", "+", "-"):
        a, b = map(sub, args)
        return a * b if op == "*" else a + b if op == "+" else a - b
    if op == "match":
        out, x = None, sub(args[0])
        for key, value in zip(args[1:-1:2], args[2:-1:2], strict=True):
            out = (F if out is None else out).when(x == F.lit(key), sub(value))
        return out.otherwise(sub(args[-1]))
    if op == "case":
        out = None
        for test, value in zip(args[:-1:2], args[1:-1:2], strict=True):
            out = (F if out is None else out).when(sub(test), sub(value))
        return out.otherwise(sub(args[-1]))
    if op == "interpolate":
        return interpolate(sub(args[1]), [(z, sub(v)) for z, v in zip(args[2::2], args[3::2], strict=True)])
    raise ValueError(f"unknown operator {op!r}")
