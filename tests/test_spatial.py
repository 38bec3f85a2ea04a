"""Covering joins and tiled views against plain comparisons, and what they read and join."""

import random

import pytest
from pyspark.sql import functions as F

from wayset.operators import spatial
from wayset.operators.spatial import World

WORLD = World(0.0, 0.0, 1000.0, 10.0)
BOXES = "id long, w double, s double, e double, t double"


def boxes(seed, n, wide, high):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w, s = r.uniform(0, 1000), r.uniform(0, 10)
        out.append((i, w, s, w + r.choice([0.0, r.uniform(0, wide)]), s + r.choice([0.0, r.uniform(0, high)])))
    return out


def points(seed, n):
    r = random.Random(seed)
    return [(i, r.uniform(-5, 1005), r.uniform(-1, 11)) for i in range(n)]


def inside(p, b):
    return b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4]


@pytest.mark.parametrize(("wide", "high"), [(900, 9), (3, 9), (900, 0.02), (5, 0.05)])
def test_hits_of_any_shape(spark, wide, high):
    given, asked = boxes(1, 120, wide, high), points(2, 150)
    asked += [(1000 + b[0], b[1], b[2]) for b in given[:40]] + [(2000 + b[0], b[3], b[4]) for b in given[:40]]  # corners
    found = spatial.point_hits(spark.createDataFrame(asked, "point long, x double, y double"), spark.createDataFrame(given, BOXES))
    assert sorted((r["point"], r["id"]) for r in found.collect()) == sorted((p[0], b[0]) for p in asked for b in given if inside(p, b))


def test_few_rows_beside_the_hits(spark):
    """Small extents: a million possible pairs, joined rows at most three times the hits."""
    r = random.Random(4)
    given = [(i, x, y, x + r.uniform(1, 9), y + r.uniform(0.01, 0.09)) for i, (x, y) in enumerate((r.uniform(0, 990), r.uniform(0, 9.9)) for _ in range(2000))]
    asked = [(i, r.uniform(b[1], b[3]), r.uniform(b[2], b[4])) for i, b in enumerate(r.choice(given) for _ in range(4000))]
    p, s = spark.createDataFrame(asked, "point long, x double, y double"), spark.createDataFrame(given, BOXES)
    hits = spatial.point_hits(p, s).count()
    assert hits >= 4000
    assert spatial.candidates(p, s).count() <= 3 * hits


def test_heavy_cells_are_split(spark):
    """A third of all points at one place, a third of all boxes over it: no join key has over 1 % of either side."""
    given = [(i, 500.0, 5.0, 500.0, 5.0) for i in range(1000)] + boxes(3, 2000, 4, 0.04)
    asked = [(i, 500.0, 5.0) for i in range(1000)] + points(5, 2000)
    p, s = spark.createDataFrame(asked, "point long, x double, y double"), spark.createDataFrame(given, BOXES)
    world = spatial.world_of(s)
    cells = spatial.coverings(s, world)
    levels = sorted({(r[0], r[1]) for r in cells.select("__lx", "__ly").distinct().collect()})
    dealt, at = spatial._split(cells.drop("__lx", "__ly", "__x", "__y"), spatial.probes(p, world, levels))
    for side in (dealt, at):
        largest = side.groupBy("__key", "__p", "__q").count().agg(F.max("count")).first()[0]
        assert largest <= 0.01 * side.count()
    assert spatial.point_hits(p, s).where("x = 500 and w = 500").count() == 1_000_000


def test_odd_points_and_boxes(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, 1.0, None), (1, 1.0, 1.0)], "point long, x double, y double")
    s = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 2.0, 0.0, 0.0, 2.0), (3, None, 0.0, 2.0, 2.0), (4, 1.0, 1.0, 1.0, 1.0)], BOXES)
    found = spatial.point_hits(p, s).collect()
    assert sorted((r["point"], r["id"]) for r in found) == [(1, 1), (1, 1), (1, 4), (1, 4)]
    assert spatial.point_hits(p, s.where("false")).count() == 0 == spatial.point_hits(p.where("false"), s).count()


def _copies(n_points, n_segs):
    """Points at 4 places, and 5 extents of segments, each in many copies, in mixed order."""
    r = random.Random(9)
    asked = [(i, float(100 * (i % 4)), float(i % 4)) for i in range(n_points)]
    given = [(i, 100.0 * (i % 5) - 150, 0.0, 100.0 * (i % 5) + 50, float(i % 5)) for i in range(n_segs)]
    r.shuffle(asked)
    r.shuffle(given)
    return asked, given


def test_hits_come_as_runs_of_a_segment(spark):
    """A segment's hits at one place follow one another, so that files hold them as a run."""
    asked, given = _copies(400, 200)
    p, s = spark.createDataFrame(asked, "point long, x double, y double").repartition(3), spark.createDataFrame(given, BOXES).repartition(3)
    found = [r["id"] for r in spatial.point_hits(p, s).select("point", "id").collect()]
    assert len(found) == sum(inside(a, b) for a in asked for b in given) > 10_000
    assert 1 + sum(a != b for a, b in zip(found, found[1:], strict=False)) <= len(found) / 100  # a place has 100 points


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_hits_carry_all_columns_whatever_is_gathered(spark, monkeypatch, chunk):
    """Chunks of any size, repeated rows, null ids, arrays, and points of coordinates alone."""
    monkeypatch.setattr(spatial, "CHUNK", chunk)
    asked, given = _copies(30, 25)
    asked = [(None if a[0] % 7 == 0 else a[0], *a[1:], f"p{a[0] % 3}") for a in asked + asked[:5]] + [(99, None, 1.0, "n"), (98, 1.0, None, "n")]
    given = [(None if b[0] % 6 == 0 else b[0], [b[0] % 2, 5], *b[1:]) for b in given + given[:4]] + [(77, [1], 9.0, 0.0, 1.0, 9.0)]
    p, s = spark.createDataFrame(asked, "point long, x double, y double, tag string"), spark.createDataFrame(given, "id long, refs array<int>, w double, s double, e double, t double")
    found = spatial.point_hits(p, s)
    assert found.columns == [*p.columns, *s.columns]
    expected = [(*a, *b) for a in asked for b in given if None not in a[1:3] and inside(a, (b[0], *b[2:]))]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected)) and expected
    assert spatial.point_hits(p.select("y", "x"), s.select("w", "s", "e", "t")).count() == len(expected)


def test_deepest_hits_pair_places_and_extents(spark):
    """Copies on both sides: the rows are those of all pairs, the plan sends no side to all tasks."""
    r = random.Random(6)
    given = [(i, r.randint(1, 3), *b[1:]) for i, b in enumerate(boxes(7, 20, 300, 3) * 4)]
    asked = [(i, x, y) for i, (_, x, y) in enumerate(points(8, 30) * 5)] + [(900, None, 1.0)]
    p, s = spark.createDataFrame(asked, "point long, x double, y double"), spark.createDataFrame(given, "id long, n int, w double, s double, e double, t double")
    expected = []
    for point, x, y in asked:
        met = [b for b in given if x is not None and inside((point, x, y), (b[0], *b[2:]))]
        if met:
            best = min(met, key=lambda b: (-b[1], b[0]))
            expected.append((point, len(met), best[0], best[1]))
    assert sorted(tuple(x) for x in spatial.deepest_hits(p, s).select("point", "hits", "id", "n").collect()) == sorted(expected)
    plan = spatial.candidates(p, s)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [__key" in plan
    assert spatial.deepest_hits(p.where("false"), s).count() == 0 == spatial.deepest_hits(p, s.where("false")).count()


def drawn(b, zoom, box):
    side = max((b[3] - b[1]) / WORLD.width(), (b[4] - b[2]) / WORLD.height())
    meets = b[1] <= box[2] and b[3] >= box[0] and b[2] <= box[3] and b[4] >= box[1]
    return meets and (zoom + spatial.GRAIN >= spatial.LEVELS or side * 2 ** (zoom + spatial.GRAIN) >= 1)


def test_views_equal_plain_filters(spark, tmp_path):
    given = boxes(7, 400, 300, 2) + boxes(8, 400, 5, 0.05)
    given = [(i, *b[1:]) for i, b in enumerate(given)] + [(9000, 0.0, 0.0, 1000.0, 10.0), (9001, 250.0, 2.5, 500.0, 5.0)]
    path = str(tmp_path / "tiles")
    spatial.write_tiles(spark.createDataFrame([*given, (9002, None, 0.0, 1.0, 1.0), (9003, 5.0, 0.0, 1.0, 1.0)], BOXES), path, WORLD, 4)
    r = random.Random(9)
    views = [(z, (x, y, x + r.choice([0, 40, 600]), y + r.choice([0, 0.4, 6]))) for z in (0, 3, 7, 12) for x, y in [(r.uniform(-50, 950), r.uniform(-0.5, 9.5)) for _ in range(3)]]
    for zoom, box in views:
        found = [x["id"] for x in spatial.read_view(spark, path, WORLD, zoom, box).collect()]
        assert sorted(found) == sorted(b[0] for b in given if drawn(b, zoom, box)), (zoom, box)


def scanned(df):
    """Rows that came out of the scan, after files and row groups were pruned."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            found += node.metrics().get("numOutputRows").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found, plan


def test_a_tile_is_computed_once(spark):
    """Steps of bit spreading are not nested into one another: a cell's place is in the plan once for each axis."""
    plan = spatial.tiled(spark.createDataFrame(boxes(7, 5, 300, 2), BOXES), WORLD)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("FLOOR") <= 6


def test_a_view_reads_in_proportion_to_it(spark, tmp_path):
    """Files by level and stretch of the Z-order: smaller views read fewer rows, low zooms fewer levels."""
    given = spark.range(40_000).select("id", (F.col("id") % 200 * 5.0).alias("w"), (F.floor(F.col("id") / 200) * 0.05).alias("s")).withColumn("e", F.col("w") + 2.0).withColumn("t", F.col("s") + 0.02)
    path = str(tmp_path / "tiles")
    spatial.write_tiles(given, path, WORLD, 64)
    whole, _ = scanned(spatial.read_view(spark, path, WORLD, 12, (0.0, 0.0, 1000.0, 10.0)))
    quarter, plan = scanned(spatial.read_view(spark, path, WORLD, 12, (0.0, 0.0, 499.0, 4.99)))
    small, _ = scanned(spatial.read_view(spark, path, WORLD, 12, (300.0, 3.0, 360.0, 3.6)))
    assert whole == 40_000 and quarter <= 0.45 * whole and small <= 0.1 * whole
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(tile" in plan
    none, _ = scanned(spatial.read_view(spark, path, WORLD, 0, (0.0, 0.0, 1000.0, 10.0)))
    assert none == 0  # nothing is large enough to be drawn, and no folder is read
