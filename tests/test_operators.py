"""Fixed examples and laws of the two sums, filters, ranking, sets and ends."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wayset.operators import aggregate, filters, sets
from wayset.plans import catalog
from wayset.sources import segments as model
from wayset.sources import store
from wayset.streaming import refresh

COMBOS = [([7], 1, 100, 1000), ([8], 1, 200, 2000), ([17], 1, 300, 3000), ([7, 8], 2, 10, 100), ([7, 8, 17, 49, 403, 459], 6, 4, 40)]
SCHEMA = "refs array<int>, n int, km decimal(18,2), arcs long"


@pytest.fixture
def combos(spark):
    return spark.createDataFrame([(r, n, Decimal(k), a) for r, n, k, a in COMBOS], SCHEMA)


def stats(combos, *chosen):
    return tuple(aggregate.stats_for(combos, chosen).first())


def test_fan_out(combos):
    found = {r["ref"]: (r["km"], r["arcs"], r["max_n"]) for r in aggregate.routes_of(combos).collect()}
    assert list(found) == [7, 8, 17, 49, 403, 459]
    assert found[7] == (114, 1140, 6)
    assert found[459] == (4, 40, 6)


def test_fan_out_differs_from_real_length(combos):
    row = aggregate.lengths(combos).first()
    assert (row["real_km"], row["designated_km"]) == (614, 644)
    assert sum(r["km"] for r in aggregate.routes_of(combos).collect()) == 644


def test_no_rows(spark, combos):
    none = combos.where("false")
    assert aggregate.routes_of(none).collect() == []
    assert stats(none) == (0, 0, 0)


def test_count_once(combos):
    assert stats(combos) == (6140, 614, 140)
    assert stats(combos, 459) == (40, 4, 40)
    assert stats(combos, 7, 8)[1] == 314
    assert stats(combos, 999) == (0, 0, 0)


def test_one_ref_has_its_own_sum(combos):
    for r in aggregate.routes_of(combos).collect():
        assert stats(combos, r["ref"])[:2] == (r["arcs"], r["km"])


def test_rounding_goes_up_after_summing(spark):
    rows = spark.createDataFrame([([1], 1, Decimal("0.02"), 1), ([1, 2], 2, Decimal("0.03"), 1)], SCHEMA)
    assert {r["ref"]: r["km"] for r in aggregate.routes_of(rows).collect()} == {1: 0.1, 2: 0.0}


@pytest.mark.parametrize(("chosen", "expected"), [((), [[7, 8], [7, 8, 17, 49, 403, 459]]), ((49,), [[7, 8, 17, 49, 403, 459]]), ((999,), [])])
def test_concurrencies(combos, chosen, expected):
    assert sorted(r["refs"] for r in aggregate.concurrencies(combos, chosen).collect()) == expected


def test_ranking_is_deepest_then_longest(combos):
    assert [r["n"] for r in aggregate.ranking(combos, ()).collect()] == [6, 2]
    assert tuple(aggregate.shown_of_total(aggregate.concurrencies(combos, ()), 1).first()) == (1, 2)


@pytest.mark.parametrize(("hits", "expected"), [([(1, 1), (2, 4), (3, 2)], 2), ([(1, 6), (2, 1)], 1), ([(1, 4), (2, 4)], 1), ([(1, "9"), (2, "10")], 2)])
def test_deepest(spark, hits, expected):
    rows = spark.createDataFrame([(0, i, str(n)) for i, n in hits], "cell int, id int, n string")
    assert aggregate.deepest(rows).first()["id"] == expected


def test_membership_is_not_substring(spark):
    rows = spark.createDataFrame([(",14,400,",), (",4,18,",)], "refs_s string")
    assert [r[0] for r in rows.where(filters.has_ref_text(4)).collect()] == [",4,18,"]
    assert [r[0] for r in rows.where(filters.compile_expr(["in", ",4,", ["get", "refs_s"]])).collect()] == [",4,18,"]


def test_null_kind_survives_negation(spark):
    rows = spark.createDataFrame([("road",), ("ferry",), (None,)], "kind string")
    assert [r[0] for r in rows.where(filters.of_kind(filters.NOT_ROADS, negate=True)).collect()] == ["road", None]
    tree = ["!", ["in", ["get", "kind"], ["literal", filters.NOT_ROADS]]]
    assert [r[0] for r in rows.where(filters.compile_expr(tree)).collect()] == ["road", None]


def test_picked(spark):
    rows = spark.createDataFrame([(0, 1), (1, 2)], "id int, n int")
    assert rows.where(filters.picked(F.lit(True), None)).count() == 0
    assert rows.where(filters.picked(F.lit(True), 0)).count() == 1
    assert rows.where(filters.picked(F.col("n") >= 2, 0)).count() == 0


def test_unknown_operator():
    with pytest.raises(ValueError, match="unknown operator"):
        filters.compile_expr(["sqrt", 2])


def test_expression_tree(spark):
    rows = spark.range(5).select(F.col("id").cast("int").alias("n"))
    tree = ["+", ["case", [">=", ["get", "n"], 3], 10, 0], ["*", 2, ["-", ["get", "n"], 1]]]
    assert [r[0] for r in rows.select(filters.compile_expr(tree)).collect()] == [-2, 0, 2, 14, 16]
    width = filters.compile_expr(["interpolate", ["linear"], ["zoom"], 0, 1.0, 10, 3.0], zoom=F.col("n") * 5.0)
    assert [r[0] for r in rows.select(width).collect()] == [1.0, 2.0, 3.0, 3.0, 3.0]


def test_layers_overlap_and_toggles(spark):
    rows = spark.createDataFrame([(1, "road"), (2, "ferry"), (3, None), (4, "expressway")], "id int, kind string")
    drawn = lambda **t: sorted((r["id"], r["layer"]) for r in filters.dispatch(rows, F.lit(True), t).collect())
    assert (2, "ferry") in drawn() and (1, "roads") in drawn() and (3, "casing") in drawn()
    off = drawn(ferry=False, expressway=False)
    assert (2, "ferry") not in off and (2, "route-labels") in off and (4, "roads") not in off


def test_every_special_kind_has_a_layer():
    shown = {k for _, kinds, negate, _ in filters.LAYERS if kinds and not negate for k in kinds}
    assert set(filters.NOT_ROADS) <= shown


def test_ends(spark):
    ends = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("c", "q")], "ref string, place string")
    shared, single = sets.shared_ends(ends), sets.single_ends(ends)
    assert [tuple(r) for r in shared.collect()] == [("p", ["a", "b"])]
    assert [tuple(r) for r in single.collect()] == [("c", "q")]
    every = sets.all_ends(shared, single).orderBy(F.desc("shared")).collect()
    assert [(r["shared"], r["count"]) for r in every] == [(1, 2), (0, 1)]
    assert sets.all_ends(shared.where("false"), single.where("false")).count() == 0


def test_full_compare_with_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "w"), (None, "z")], "id int, v string")
    found = {(r["id"], r["state"]) for r in sets.full_compare(a, b, "id", "v").collect()}
    assert found == {(1, "same"), (2, "removed"), (3, "added"), (None, "same")}


def test_metadata_document(spark, tmp_path):
    path = tmp_path / "meta.json"
    path.write_text('{"osm_timestamp": "2026-08-16T20:21:06Z", "combinations": [{"refs": [7, 8], "n": 2, "km": 1.5, "arcs": 3, "names": [], "bbox": {"w": 1, "s": 2, "e": 3, "n": 4}}], "termini": [], "shared_termini": [{"refs": [7, 8], "lon": 1.0, "lat": 2.0}]}')
    meta = model.read_metadata(spark, str(path))
    assert [(r["pos"], r["refs"], r["arcs"]) for r in model.relation(meta, "combinations").collect()] == [(0, [7, 8], 3)]
    assert model.relation(meta, "termini").count() == 0
    (tmp_path / "regions.json").write_text("[]")
    with pytest.raises(ValueError, match="no region"):
        model.read_regions(spark, str(tmp_path / "regions.json"))


def test_bridge_pushes_membership_down(spark, sf_dir, tmp_path):
    segs = model.segments(spark, sf_dir, "nation")
    model.write_bridge(segs, str(tmp_path / "bridge"))
    found = spark.read.parquet(str(tmp_path / "bridge")).where("ref = 4")
    assert "EqualTo(ref,4)" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == segs.where(filters.has_ref(4)).count()


def test_merged_sums(spark, sf_dir):
    segs = model.segments(spark, sf_dir)
    halves = [aggregate.sums_by_set(segs.where(f"id % 2 = {k}")) for k in (0, 1)]
    merged = {tuple(r["refs"]): (r["km"], r["arcs"]) for r in refresh.merge_sums(*halves).collect()}
    assert merged == {tuple(r["refs"]): (r["km"], r["arcs"]) for r in aggregate.sums_by_set(segs).collect()}


def test_streamed_sums(spark, sf_dir, tmp_path):
    segs = model.segments(spark, sf_dir)
    segs.write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(segs.schema).parquet(str(tmp_path / "in"))
    run = refresh.keep_sums(feed, aggregate.sums_by_set, str(tmp_path / "sums"), str(tmp_path / "state"))
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(str(tmp_path / "sums")).agg(F.sum("arcs")).first()[0] == segs.count()


def test_windowed_counts(spark, sf_dir):
    events = model.table(spark, sf_dir, "events")
    assert refresh.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_every_label_has_its_place(spark, sf_dir):
    expected = sorted(((r["n"], r["id"]) for r in model.segments(spark, sf_dir, "nation").collect()), key=lambda r: (-r[0], r[1]))
    assert len(expected) > 50
    assert [tuple(r) for r in catalog.QUERIES["label_order"](spark, sf_dir).collect()] == expected


def test_every_point_is_probed(spark, sf_dir):
    points = [(r["p_partkey"], float(r["p_size"]), r["p_partkey"] % 10 / 100.0) for r in model.table(spark, sf_dir, "part").collect()]
    segs = [(r["id"], r["w"], r["s"], r["e"], r["t"]) for r in model.segments(spark, sf_dir, "nation").collect()]
    expected = sorted((p, i) for p, x, y in points for i, w, s, e, t in segs if w <= x <= e and s <= y <= t)
    assert len({p for p, _ in expected}) > 100
    assert sorted(tuple(r) for r in catalog.QUERIES["point_hits"](spark, sf_dir).collect()) == expected


def test_written_once_follows_its_inputs(spark, tmp_path):
    given = str(tmp_path / "in.parquet")
    read = lambda: store.written_once(spark, "t", [given], lambda: spark.read.parquet(given)).count()
    spark.range(3).write.parquet(given)
    assert read() == 3 == read()
    spark.range(5).write.mode("overwrite").parquet(given)
    assert read() == 5


def test_no_folder_on_a_cluster(spark, monkeypatch):
    class Away:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Away)


def test_selection_table(spark):
    combos = spark.createDataFrame([([7], 1), ([7, 8], 2), ([9], 3)], "refs array<int>, arcs int")
    routes = spark.createDataFrame([(7,), (8,), (9,)], "ref int")
    found = lambda *chosen: sorted(r["arcs"] for r in sets.touched(combos, spark.createDataFrame([(c,) for c in chosen], "ref int"), routes).collect())
    assert found(7, 8, 999) == [1, 2] and found(8) == [2] and found(999) == [1, 2, 3] and found() == [1, 2, 3]


def test_deepest_and_seams_keep_whole_rows(spark):
    hits = spark.createDataFrame([(1, "2", 4), (1, "10", 9), (1, "10", 3), (2, None, 1), (None, "1", 5)], "cell int, n string, id int")
    assert sorted((r["cell"] or 0, r["id"]) for r in aggregate.deepest(hits).collect()) == [(0, 5), (1, 3), (2, 1)]
    builds = spark.createDataFrame([(1, "b", None), (1, "a", "x"), (2, "c", "y")], "id int, region string, name string")
    assert sorted(map(tuple, sets.seam_dedup(builds).collect())) == [(1, "a", "x"), (2, "c", "y")]


def test_chain_ends_without_cuts(spark):
    edges = spark.createDataFrame([("r", 1, 0.0, 2, 5.0), ("r", 2, 5.0, 3, 6.0), ("s", 3, 6.0, 4, 10.0)], "ref string, a int, ax double, b int, bx double")
    assert sorted(map(tuple, sets.chain_ends(edges, 0, 10).collect())) == [("r", 3, 6.0), ("s", 3, 6.0)]


def test_telling_queries_give_rows(spark, sf_dir):
    for name in ("set_except", "broken_chain", "kind_coverage", "missing_both_ways", "chain_ends", "selection_all_dropped"):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0, name
    assert {r["state"] for r in catalog.QUERIES["region_expectations"](spark, sf_dir).collect()} >= {"low", "high"}


def test_sets_as_bits(spark):
    """Sets of numbers of any size, gathered as bits and given back as sorted arrays."""
    rows = spark.createDataFrame([(1, 0), (1, 200), (1, 62), (1, 63), (1, 63), (2, None), (3, 130)], "id int, ref int")
    merged, numbers = model._set_of("ref", 200)
    found = {r["id"]: r["refs"] for r in rows.groupBy("id").agg(*merged).select("id", numbers).collect()}
    assert found == {1: [0, 62, 63, 200], 2: [], 3: [130]}


def test_stored_names_are_not_shuffled(spark, sf_dir):
    """Names lie in buckets of sets: between their scan and what gathers them there is no exchange."""
    found = catalog.QUERIES["ranking_names"](spark, sf_dir)
    assert found.count() == 25
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    scans = [k for k, line in enumerate(lines) if "Scan parquet" in line and "names_" in line]
    assert scans and all("Bucketed: true" in lines[k] for k in scans)
    for k in scans:
        depth, above = len(lines[k]) - len(lines[k].lstrip(" :+-*()0123456789")), []
        for line in reversed(lines[:k]):
            at = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if at < depth:
                above.append(line)
                depth = at
        gathered = next(i for i, line in enumerate(above) if "collect_set" in line and "partial" not in line)
        assert not any("Exchange" in line for line in above[:gathered])
