"""Chains that the segments of each designation make: connected pieces, their ends, rings and gaps, ranked for audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .ordinal import followed, ranked

LENGTH = "decimal(18,2)"


#: Turns in which one half of a node's number is combined with a hash of the other.
_TURNS = 3


def _scattered(node: str, kind: str) -> Column:
    """A label in an order that has nothing to do with the node's own, another one for every node.

    Every turn on a whole number can be undone, so no two numbers become one; other kinds keep the node beside its hash.
    """
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("node"))
    half = F.lit((1 << 32) - 1)
    x = F.col(node).cast("long")
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(half)
    for turn in range(_TURNS):
        high, low = low, high.bitwiseXOR(F.xxhash64(low, F.lit(turn)).bitwiseAND(half))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _contracted(edges: DataFrame) -> DataFrame:
    """ref, u, root of every node (``u``, its label) that an edge (ref, u, v) joins with another.

    In each round a node becomes the least label among itself and its neighbours, and edges join what their nodes became;
    those within one label are gone. As labels are scattered, a round leaves some half of the nodes of a chain, so all
    rounds together move a small multiple of the edges. Every round is written, so a lost executor costs one round.
    """
    now, steps = stored(edges.where("u <> v").select("ref", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"), []
    while not now.isEmpty():
        both = now.unionByName(now.select("ref", F.col("v").alias("u"), F.col("u").alias("v")))
        step = stored(both.groupBy("ref", "u").agg(F.min("v").alias("m")).select("ref", "u", F.least("u", "m").alias("m")), "steps")
        steps.append(step)
        of = lambda c: step.select("ref", F.col("u").alias(f"k{c}"), F.col("m").alias(f"m{c}"))  # noqa: B023, E731  both renamed alike: Spark moves them once
        ends = now.select("ref", F.col("u").alias("ku"), F.col("v").alias("kv"))
        moved = ends.join(of("u"), ["ref", "ku"]).join(of("v"), ["ref", "kv"]).where("mu <> mv")
        now = stored(moved.select("ref", F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct(), "edges")
    found = steps.pop() if steps else now.withColumnRenamed("v", "m")
    for step in reversed(steps):  # later steps are smaller, and a label that takes no part in them stays
        later = found.select("ref", F.col("u").alias("m"), F.col("m").alias("root"))
        found = step.join(later, ["ref", "m"], "left").select("ref", "u", F.coalesce("root", "m").alias("m"))
    return found.withColumnRenamed("m", "root")


def _usable(edges: DataFrame) -> DataFrame:
    """Edges with a designation and two nodes, the labels of these beside them."""
    known = edges.where("ref is not null and a is not null and b is not null")
    kinds = dict(edges.dtypes)
    return known.withColumn("u", _scattered("a", kinds["a"])).withColumn("v", _scattered("b", kinds["b"]))


def components(edges: DataFrame) -> DataFrame:
    """ref, node, piece: the smallest node that the designation's edges (ref, a, b) connect each node with.

    Edges without a designation or a node are left out. Both ends are of one kind.
    """
    usable = _usable(edges)
    side = lambda node, u: F.struct(F.col(node).alias("node"), F.col(u).alias("u"))
    nodes = usable.select("ref", F.explode(F.array(side("a", "u"), side("b", "v"))).alias("p")).select("ref", "p.*").distinct()
    rooted = stored(nodes.join(_contracted(usable), ["ref", "u"], "left").select("ref", "node", F.coalesce("root", "u").alias("root")), "roots")
    least = rooted.groupBy("ref", "root").agg(F.min("node").alias("piece"))
    return rooted.join(least, ["ref", "root"]).select("ref", "node", "piece")


def _sided(edges: DataFrame, *also: str) -> DataFrame:
    """Every edge from both of its ends: ref, ``also``, node, x, and v, the other end's label if both ends are known."""
    kinds = dict(edges.dtypes)
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    side = lambda node, x, other: F.struct(F.col(node).alias("node"), F.col(x).alias("x"), F.when(whole, _scattered(other, kinds["a"])).alias("v"))
    return edges.where("ref is not null").select("ref", *also, F.explode(F.array(side("a", "ax", "b"), side("b", "bx", "a"))).alias("p")).where("p.node is not null").select("ref", *also, "p.*")


def _neared(met: DataFrame, kind: str) -> DataFrame:
    """``met`` with m, the least label of a node and its neighbours (whose least is v); nodes of no whole edge are left out."""
    return met.where("v is not null").withColumn("m", F.least(_scattered("node", kind), "v")).drop("v")


def _first_round(edges: DataFrame) -> DataFrame:
    """ref, u, v: edges (ref, a, b) between what their nodes become in the first round; most have become one.

    It works on the nodes as they are, which are shorter than their labels when they move, and stores nothing.
    """
    near = _neared(_sided(edges).groupBy("ref", "node").agg(F.min("v").alias("v")), dict(edges.dtypes)["a"])
    of = lambda c: near.select("ref", F.col("node").alias(f"k{c}"), F.col("m").alias(f"m{c}"))  # noqa: E731  as in _contracted
    ends = edges.where("ref is not null and a <> b").select("ref", F.col("a").alias("ka"), F.col("b").alias("kb"))
    return ends.join(of("a"), ["ref", "ka"]).join(of("b"), ["ref", "kb"]).select("ref", F.col("ma").alias("u"), F.col("mb").alias("v"))


def _summed(parts: DataFrame, by: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("nodes", "degree", "km", "ends", "junctions")]
    return parts.groupBy("ref", by).agg(F.min("piece").alias("piece"), *sums, F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def pieces(edges: DataFrame) -> DataFrame:
    """ref, piece, nodes, edges, km, ends, junctions, kind, lo, hi of every connected piece, named by its smallest node.

    ``edges`` are (ref, a, ax, b, bx, km). A ring has no end and no junction, a chain two ends and no junction; what
    else there is has branches. An edge from a node to itself is a ring. Edges without a designation or a node connect
    nothing.

    Nodes are summed by what they become in the first round. Most sums are whole pieces then; only those that edges
    still join move on to their root.
    """
    roots = stored(_contracted(_first_round(edges)), "roots")
    met = _sided(edges, "km").groupBy("ref", "node").agg(F.count("*").alias("degree"), F.min("x").alias("x"), F.sum("km").alias("km"), F.min("v").alias("v"))
    nodes = _neared(met, dict(edges.dtypes)["a"]).select(
        "ref", "m", F.col("node").alias("piece"), F.lit(1).alias("nodes"), "degree", "km", (F.col("degree") == 1).cast("int").alias("ends"), (F.col("degree") > 2).cast("int").alias("junctions"),
        F.col("x").alias("lo"), F.col("x").alias("hi"),
    )
    parts = _summed(nodes.where("m is not null"), "m")
    joined = roots.select("ref", F.col("u").alias("m"), "root").hint("shuffle_hash")  # a row a key, and fewer than the parts: those are not sorted
    found = parts.join(joined, ["ref", "m"], "left_anti").drop("m").unionByName(_summed(parts.join(joined, ["ref", "m"]), "root").drop("root"))
    kind = F.when(F.col("junctions") > 0, "branched").when(F.col("ends") == 0, "ring").otherwise("chain")
    return found.select("ref", "piece", "nodes", (F.col("degree") / 2).cast("long").alias("edges"), (F.col("km") / 2).cast(LENGTH).alias("km"), "ends", "junctions", "lo", "hi").withColumn("kind", kind)


def gaps(found: DataFrame) -> DataFrame:
    """ref, piece, after, gap: how far each piece begins beyond the one before it, in the order of their beginnings.

    The first piece of a designation has none; pieces that overlap have a gap of 0.
    """
    placed = followed(found.select("ref", "lo", "piece", "hi"), ["ref", "lo", "piece"], "ref", "piece", "hi")
    return placed.where("ref = prev_ref").select("ref", "piece", F.col("prev_piece").alias("after"), F.greatest(F.col("lo") - F.col("prev_hi"), F.lit(0)).alias("gap"))


def audit(found: DataFrame) -> DataFrame:
    """Designations of ``pieces``, the most suspicious first (``place`` from 1): the ranking's order is ours.

    A whole designation is one piece. Suspicion is the number of pieces, then the length outside the longest piece,
    then the widest gap.
    """
    whole = found.groupBy("ref").agg(F.count("*").alias("pieces"), F.sum("ends").alias("open_ends"), F.count_if(F.col("kind") == "ring").alias("rings"), F.sum("km").cast(LENGTH).alias("km"), F.max("km").alias("main"))
    widest = gaps(found).groupBy("ref").agg(F.count_if(F.col("gap") > 0).alias("gaps"), F.max("gap").alias("widest"))
    both = whole.join(widest, "ref", "left").withColumn("stray_km", (F.col("km") - F.col("main")).cast(LENGTH))
    counted = both.withColumn("gaps", F.coalesce("gaps", F.lit(0))).withColumn("widest", F.coalesce("widest", F.lit(0.0)))
    order = (F.desc("pieces"), F.desc("stray_km"), F.desc("widest"), F.asc("ref"))
    return ranked(counted, *order).select((F.col("pos") + 1).alias("place"), "ref", "pieces", "open_ends", "rings", "gaps", "widest", "km", "stray_km")
