"""Chains, evidence and comparison against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayset.operators import chains, evidence

EDGES = "ref string, a long, ax double, b long, bx double, km double"


def edges(spark, rows):
    return spark.createDataFrame([(r, a, float(a), b, float(b), float(km)) for r, a, b, km in rows], EDGES)


def union_find(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r, a, b, _ in rows:
        u, v = find((r, a)), find((r, b))
        up[max(u, v)] = min(u, v)
    return {x: find(x)[1] for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("xy"), r.randint(0, 150), r.randint(0, 150), 1) for _ in range(120)]
    rows += [("long", k, k + 1, 1) for k in range(200)]  # a long chain takes few rounds
    found = {(x["ref"], x["node"]): x["piece"] for x in chains.components(edges(spark, rows)).collect()}
    assert found == union_find(rows)


def test_pieces_and_gaps(spark):
    rows = [("r", 1, 2, 5), ("r", 2, 3, 5), ("r", 10, 11, 1), ("r", 11, 12, 1), ("r", 12, 10, 1), ("r", 20, 21, 2), ("r", 20, 22, 2), ("r", 20, 23, 2), ("s", 7, 7, 3)]
    found = {(x["ref"], x["piece"]): x for x in chains.pieces(edges(spark, rows)).collect()}
    assert {k: (x["nodes"], x["edges"], float(x["km"]), x["ends"], x["junctions"], x["kind"]) for k, x in found.items()} == {
        ("r", 1): (3, 2, 10.0, 2, 0, "chain"), ("r", 10): (3, 3, 3.0, 0, 0, "ring"), ("r", 20): (4, 3, 6.0, 3, 1, "branched"), ("s", 7): (1, 1, 3.0, 0, 0, "ring"),
    }
    gaps = chains.gaps(chains.pieces(edges(spark, rows)))
    assert sorted((x["ref"], x["piece"], x["after"], x["gap"]) for x in gaps.collect()) == [("r", 10, 1, 7.0), ("r", 20, 10, 8.0)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pieces_of_any_shape(spark, kind):
    """Chains, rings, branches, hubs, doubled edges, loops and edges without an end, against a dictionary."""
    r = random.Random(5)
    rows = [(r.choice("xy"), r.randint(100, 400), r.randint(100, 400), r.randint(1, 9)) for _ in range(220)] + [("x", 250, 250, 4), ("y", 999, 999, 4)]
    rows += [("hub", 500, 501 + k % 40, k) for k in range(60)] + [("long", 100 + k, 101 + k, 1) for k in range(150)] + [("ring", 600 + k, 600 + (k + 1) % 9, 2) for k in range(9)]
    half = [("x", 101 + k, None, 3) for k in range(0, 300, 7)] + [("z", 1, None, 3)]
    made = spark.createDataFrame([(x, a, float(a), b, float(b) if b else None, float(km)) for x, a, b, km in rows + half], EDGES)
    found = {(x["ref"], int(x["piece"])): tuple(x)[2:] for x in chains.pieces(made.withColumns({c: F.col(c).cast(kind) for c in "ab"})).collect()}
    degree, km, members = Counter(), Counter(), defaultdict(list)
    for x, a, b, length in rows + half:
        for node in (a, b):
            if node is not None:
                degree[x, node] += 1
                km[x, node] += length
    for (x, node), piece in union_find(rows).items():
        members[x, piece].append((x, node))
    expected = {}
    for (x, piece), of in members.items():
        ends, junctions = sum(degree[n] == 1 for n in of), sum(degree[n] > 2 for n in of)
        name = "branched" if junctions else "chain" if ends else "ring"
        expected[x, piece] = (len(of), sum(degree[n] for n in of) // 2, sum(km[n] for n in of) / 2, ends, junctions, float(min(of)[1]), float(max(of)[1]), name)
    assert {k: (*v[:2], float(v[2]), *v[3:]) for k, v in found.items()} == expected


def test_pieces_of_one_round_are_not_stored(spark, monkeypatch):
    """Pieces that are whole after the first round take no part in the rounds, so nothing of them is written there."""
    written = []
    monkeypatch.setattr(chains, "stored", lambda df, name: written.append(df.localCheckpoint()) or written[-1])
    rows = [("r", 10 * k, 10 * k + 1, 1) for k in range(200)]
    found = chains.pieces(edges(spark, rows)).collect()
    assert sorted((x["piece"], x["nodes"], x["edges"], x["ends"]) for x in found) == [(10 * k, 2, 1, 2) for k in range(200)]
    assert sum(w.count() for w in written) == 0


def test_audit_puts_the_most_broken_first(spark):
    rows = [("whole", k, k + 1, 1) for k in range(5)] + [("two", 1, 2, 1), ("two", 5, 6, 4)] + [("three", k, k + 1, 1) for k in (1, 10, 20)]
    found = chains.audit(chains.pieces(edges(spark, rows))).orderBy("place").collect()
    assert [(x["place"], x["ref"], x["pieces"], x["gaps"], x["widest"], float(x["stray_km"])) for x in found] == [(1, "three", 3, 2, 9.0, 2.0), (2, "two", 2, 1, 3.0, 1.0), (3, "whole", 1, 0, 0.0, 0.0)]
    assert chains.audit(chains.pieces(edges(spark, rows).where("false"))).collect() == []


def fall(claims, least):
    level = {c[0]: next((k for k in range(3) if c[2 + k] is not None), 3) for c in claims}
    ledger = []
    while True:
        support = Counter((c[1], c[2 + level[c[0]]]) for c in claims if level[c[0]] < 3)
        weak = [c for c in claims if level[c[0]] < 3 and support[c[1], c[2 + level[c[0]]]] < least]
        if not weak:
            return {c[0]: c[2 + level[c[0]]] if level[c[0]] < 3 else None for c in claims}, ledger
        for c in weak:
            ledger.append((c[0], evidence.SOURCES[level[c[0]]]))
            level[c[0]] = next((k for k in range(level[c[0]] + 1, 3) if c[2 + k] is not None), 3)


@pytest.mark.parametrize("least", [1, 3, 6])
def test_fall_through_reaches_the_same_fixed_point(spark, least):
    r = random.Random(least)
    some = lambda p, n: r.randint(1, n) if r.random() < p else None
    claims = [(i, r.choice(["n", "s", None]), some(0.6, 12), some(0.6, 8), some(0.7, 5)) for i in range(200)]
    judged, ledger = evidence.fall_through(spark.createDataFrame(claims, "id long, region string, relation int, name int, tag int"), least)
    expected, rejected = fall(claims, least)
    assert {x["id"]: x["ref"] for x in judged.collect()} == expected
    assert Counter((x["id"], x["src"]) for x in ledger.collect()) == Counter(rejected)
    assert sum(x["n"] for x in evidence.rejections(judged, ledger).collect()) == len(rejected)


def test_a_region_vouches_for_itself_alone(spark):
    claims = [(1, "n", 7, None, None), (2, "s", 7, None, None), (3, "s", 7, None, None), (4, "n", None, None, None)]
    judged, ledger = evidence.fall_through(spark.createDataFrame(claims, "id long, region string, relation int, name int, tag int"), 2)
    assert sorted((x["id"], x["ref"]) for x in judged.collect() if x["ref"]) == [(2, 7), (3, 7)]
    assert [(x["round"], x["id"]) for x in ledger.collect()] == [(1, 1)]
    assert [(x["region"], x["ref"]) for x in evidence.guaranteed(judged).collect()] == [("s", 7)]


def greedy(here, there, tx, ty):
    pairs = sorted((max(abs(a[1] - b[1]) / tx, abs(a[2] - b[2]) / ty), a[1:], b[1:], a[0], b[0]) for a in here for b in there if abs(a[1] - b[1]) <= tx and abs(a[2] - b[2]) <= ty)
    out, used = {}, set()
    for *_, a, b in pairs:
        if a not in out and b not in used:
            out[a] = b
            used.add(b)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_to_one_is_nearest_first(spark, seed):
    r = random.Random(seed)
    here, there = ([(k, float(r.randint(0, 100)), float(r.randint(0, 20))) for k in range(60)] for _ in range(2))
    here += [(100 + k, 50.0, 10.0) for k in range(7)]  # many at one place
    there += [(100 + k, 50.0, 10.0) for k in range(4)] + [(200 + k, 51.0, 10.0) for k in range(2)]
    schema = "id long, x double, y double"
    found = evidence.compared(spark.createDataFrame(here, schema), spark.createDataFrame(there, schema), 6.0, 2.0).collect()
    states = defaultdict(list)
    for x in found:
        states[x["state"]].append((x["here"], x["there"]))
    matched = greedy(here, there, 6.0, 2.0)
    assert dict(states["matched"]) == matched
    assert {a for a, _ in states["only here"]} == {a[0] for a in here} - matched.keys()
    assert {b for _, b in states["only there"]} == {b[0] for b in there} - set(matched.values())


def test_copies_on_both_sides_are_not_paired(spark):
    """A third of both sides at one place: candidates are places, and each row has one partner at most."""
    n = 3000
    side = spark.range(n).select("id", (F.when(F.col("id") % 3 == 0, 5000.0).otherwise(F.col("id") * 40.0)).alias("x"), F.lit(1.0).alias("y"))
    assert evidence.near_pairs(side, side, 3.0, 1.0).count() <= n
    found = evidence.one_to_one(side, side.where("id % 6 <> 0"), 3.0, 1.0)
    assert found.count() == found.select("a").distinct().count() == found.select("b").distinct().count() == side.where("id % 6 <> 0").count()


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    one = spark.createDataFrame([(1, None, 1.0)], "id long, x double, y double")
    assert evidence.compared(none, none, 1.0, 1.0).collect() == []
    assert [tuple(x) for x in evidence.compared(one, none, 1.0, 1.0).collect()] == [("only here", 1, None, None)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_round_leaves_few_nodes_of_a_chain(spark, kind, monkeypatch):
    """Rounds shrink, also when neighbours have neighbouring numbers: written rows are a small multiple of the edges."""
    written = []
    monkeypatch.setattr(chains, "stored", lambda df, name: written.append(df.localCheckpoint()) or written[-1])
    rows = spark.range(400).select(F.lit("r").alias("ref"), F.col("id").cast(kind).alias("a"), (F.col("id") + 1).cast(kind).alias("b"))
    found = chains._contracted(chains._usable(rows))
    assert found.count() == 401 and found.select("root").distinct().count() == 1
    assert sum(w.count() for w in written) <= 6 * 400
