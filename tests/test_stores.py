"""Stored ranks, the document and regional builds."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_spatial import scanned
from wayset.operators import aggregate, ordinal, sets
from wayset.plans import stores
from wayset.sources import document, regional
from wayset.sources import segments as model


def test_ranks_equal_a_sort(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 5), i) for i in range(3000)]
    found = ordinal.ranked(spark.createDataFrame(rows, "n int, id int").repartition(7), F.desc("n"), F.asc("id")).collect()
    assert sorted((x["pos"], x["n"], x["id"]) for x in found) == [(k, *row) for k, row in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))]
    assert ordinal.ranked(spark.createDataFrame([], "n int"), "n").collect() == []


def test_no_task_ranks_all_rows(spark):
    plan = ordinal.ranked(spark.range(100), "id")._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_a_prefix_reads_one_row_group(spark, tmp_path):
    path = str(tmp_path / "ranks")
    ordinal.write_ranked(spark.range(400_000).select(F.xxhash64("id").alias("h"), "id", F.sha2(F.col("id").cast("string"), 512).alias("pad")), path, "h")
    rows, plan = scanned(ordinal.prefix(spark, path, 25))
    assert "LessThan(pos,25)" in plan and rows <= 40_000
    assert [x["pos"] for x in ordinal.prefix(spark, path, 25).collect()] == list(range(25))


def test_before_is_the_row_one_place_earlier(spark):
    found = ordinal.before(ordinal.ranked(spark.range(10).select((F.col("id") * 3).alias("v")), "v"), "v")
    assert sorted((x["v"], x["prev_v"]) for x in found.collect() if x["v"]) == [(v, v - 3) for v in range(3, 30, 3)]


def test_followed_rows_move_once(spark):
    """Each row has the one before it, across tasks and from the first on; one shuffle by ranges, no join of places."""
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v")).repartition(5)
    found = ordinal.followed(rows, ["k"], "k", "v")
    of = {k: f"v{i}" for i, k in ((i, i * 7 % 1000) for i in range(1000))}
    assert sorted((x["k"], x["prev_k"], x["prev_v"]) for x in found.where("k > 0").collect()) == [(k, k - 1, of[k - 1]) for k in range(1, 1000)]
    assert [tuple(x) for x in found.where("k = 0").collect()] == [(0, "v0", None, None)]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert ordinal.followed(rows.where("false"), ["k"], "v").collect() == []


# The document


def test_a_document_is_read_back_whole(spark, sf_dir):
    doc = stores.written(spark, sf_dir)
    head = doc.head.first()
    assert head["rows"]["combinations"] == doc.relation("combinations").count() > 0
    assert head["rows"]["names"] == doc.relation("names").count() > 0
    assert head["endpoints"] and head["bbox"]["w"] <= head["bbox"]["e"] and head["oldest_edit"] <= head["newest_edit"]
    assert [r["pos"] for r in doc.relation("combinations").orderBy("pos").collect()] == list(range(head["rows"]["combinations"]))


def test_a_document_without_a_head_is_an_error(spark, tmp_path):
    (tmp_path / "head").mkdir()
    (tmp_path / "head" / "part.json").write_text("")
    with pytest.raises(ValueError, match="no document"):
        document.read_document(spark, str(tmp_path))


def test_a_half_written_document_is_not_seen(spark, tmp_path):
    box = "struct<w:double,s:double,e:double,n:double>"
    head = spark.createDataFrame([(None, None, None, ["a"], (1.0, 2.0, 3.0, 4.0))], f"osm_timestamp timestamp, oldest_edit date, newest_edit date, endpoints array<string>, bbox {box}")
    one = lambda n: spark.createDataFrame([(k, str(k)) for k in range(n)], "pos long, name string")
    empty = {k: spark.createDataFrame([], s) for k, s in document.RELATIONS.items()}
    document.write_document(str(tmp_path), head, empty | {"names": one(2)})
    bad = one(3).withColumn("name", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        document.write_document(str(tmp_path), head, empty | {"names": bad})
    assert document.read_document(spark, str(tmp_path)).relation("names").count() == 2
    document.write_document(str(tmp_path), head, empty | {"names": one(5)})
    assert document.read_document(spark, str(tmp_path)).relation("names").count() == 5
    assert document.read_document(spark, str(tmp_path)).relation("termini").count() == 0


# Regional builds

SEGS = "id long, refs array<int>, n int, km decimal(18,2), region string"


def build(seed, region, ids, shift=0):
    r = random.Random(f"{seed}{region}")
    return [(i, refs, len(refs), round(1.5 + (i + shift) % 7, 2), region) for i in ids for refs in [sorted(r.sample(range(6), r.randint(1, 3)))]]


def frame(spark, rows):
    return spark.createDataFrame([(i, refs, n, float(km), region) for i, refs, n, km, region in rows], "id long, refs array<int>, n int, km double, region string").withColumn("km", F.col("km").cast("decimal(18,2)"))


def files(path, name):
    return {str(p) for p in (path / name).glob("*.parquet")}


def test_one_region_is_built_anew(spark, tmp_path):
    builds, roll = tmp_path / "builds", tmp_path / "roll"
    rows = build(1, "a", range(0, 60)) + build(1, "b", range(40, 120)) + build(1, "c", range(100, 160))
    regional.write_regional(frame(spark, rows), str(builds))
    regional.write_roll_up(spark, str(builds), str(roll))
    kept = {k: files(builds, f"region={k}") for k in "abc"}
    buckets = {p.name: files(roll, p.name) for p in roll.glob("bucket=*")}
    new = build(2, "b", range(50, 90), shift=3)
    regional.replace_regions(spark, str(builds), str(roll), frame(spark, new))
    assert files(builds, "region=a") == kept["a"] and files(builds, "region=c") == kept["c"] and not files(builds, "region=b") & kept["b"]
    whole = [r for r in rows if r[4] != "b"] + new
    expected = {tuple(r["refs"]): (r["n"], r["km"], r["arcs"]) for r in aggregate.sums_by_set(sets.seam_dedup(frame(spark, whole))).collect()}
    assert {tuple(r["refs"]): (r["n"], r["km"], r["arcs"]) for r in regional.read_roll_up(spark, str(roll)).collect()} == expected
    before = {tuple(r["refs"]): (r["km"], r["arcs"]) for r in aggregate.sums_by_set(sets.seam_dedup(frame(spark, rows))).collect()}
    after = {k: v[1:] for k, v in expected.items()}
    changed = [k for k in before.keys() | after.keys() if before.get(k) != after.get(k)]
    touched = {f"bucket={r['b']}" for r in spark.createDataFrame([(list(k),) for k in changed], "refs array<int>").select(regional._bucket().alias("b")).collect()}
    assert {k for k, v in buckets.items() if files(roll, k) != v} == touched & buckets.keys()


def test_the_same_build_again_touches_no_set(spark, tmp_path):
    builds, roll = tmp_path / "builds", tmp_path / "roll"
    rows = build(1, "a", range(30)) + build(1, "b", range(20, 50))
    regional.write_regional(frame(spark, rows), str(builds))
    regional.write_roll_up(spark, str(builds), str(roll))
    before = {p.name: files(roll, p.name) for p in roll.glob("bucket=*")}
    regional.replace_regions(spark, str(builds), str(roll), frame(spark, [r for r in rows if r[4] == "b"]))
    assert {p.name: files(roll, p.name) for p in roll.glob("bucket=*")} == before


def test_a_region_without_a_name_is_an_error(spark, tmp_path):
    builds = tmp_path / "builds"
    regional.write_regional(frame(spark, build(1, "a", range(5))), str(builds))
    with pytest.raises(ValueError, match="name"):
        regional.replace_regions(spark, str(builds), str(builds), frame(spark, build(1, "a", range(3))).withColumn("region", F.lit(None).cast("string")))


def test_plans_need_no_sort_aggregate(spark, sf_dir):
    from wayset.plans import catalog

    for name in ("combos_nation", "deepest_per_cell", "last_wins", "seam_dedup"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan, name


def test_line_items_do_not_move_to_their_suppliers(spark, sf_dir, monkeypatch):
    """Whatever size Spark takes suppliers for: some are sent to all tasks, and very many are joined with the same rows."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = model.designated(spark, sf_dir)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_suppkey" not in plan
        monkeypatch.setattr(model, "SENT_ROWS", 0)
        assert found.exceptAll(model.designated(spark, sf_dir)).count() == 0 < found.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_the_document_sums_without_counting_names(spark, sf_dir, tmp_path, monkeypatch):
    def unwanted(segs):
        raise AssertionError("names are counted for columns that the document has not")

    monkeypatch.setattr(aggregate, "combine", unwanted)
    stores._write(spark, sf_dir, str(tmp_path / "doc"))
    assert document.read_document(spark, str(tmp_path / "doc")).relation("combinations").count() > 0
