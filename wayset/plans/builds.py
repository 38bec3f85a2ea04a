"""Queries over documents, regional builds and checks, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregate, sets
from ..sources import files, regional
from ..sources import segments as model
from ..sources.segments import ENDPOINTS_SQL, segments, sums, table
from ..sources.store import fresh_path, once
from .registry import COMBOS, LIST, NATION_COMBOS, NATIONS, REGION_COMBOS, REGIONS, joined, km, query, rows


# Documents and layouts

POINTS = "SELECT ref, place, substr(place, 9, 2)::INTEGER AS lon, substr(place, 12, 2)::INTEGER AS lat FROM points"


def placed(ends):
    return ends.withColumn("lon", F.substring("place", 9, 2).cast("double")).withColumn("lat", F.substring("place", 12, 2).cast("double"))


@query("ends_features", ENDPOINTS_SQL + f""", placed AS ({POINTS}), met AS (SELECT place, lon, lat, list_sort(list_distinct(list(ref))) AS refs FROM placed GROUP BY 1, 2, 3)
SELECT CASE WHEN len(refs) >= 2 THEN 1 ELSE 0 END::INTEGER AS shared, '{{"type":"Feature","properties":{{"refs":",' || array_to_string(refs, ',') || ',","label":"' || array_to_string(refs, '・') || '","shared":' || CASE WHEN len(refs) >= 2 THEN 1 ELSE 0 END || ',"count":' || len(refs) || '}},"geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}}}}' AS feature FROM met""")
def ends_features(spark, sf_dir):
    """All ends as GeoJSON features, shared ones first."""
    ends = model.endpoints(spark, sf_dir)
    every = placed(sets.all_ends(sets.shared_ends(ends), sets.single_ends(ends)))
    return model.features(every.withColumn("lon", F.col("lon").cast("int")).withColumn("lat", F.col("lat").cast("int"))).orderBy(F.desc("shared"), "feature")


@query("region_index", "SELECT r_name AS region, r_regionkey::DOUBLE AS w, 0.0::DOUBLE AS s, (r_regionkey + 1)::DOUBLE AS e, 1.0::DOUBLE AS north FROM region")
def region_index(spark, sf_dir):
    path = fresh_path(spark, "regions")
    boxes = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.col("r_regionkey").cast("double").alias("w"), F.lit(0.0).alias("s"), (F.col("r_regionkey") + 1).cast("double").alias("e"), F.lit(1.0).alias("t"))
    model.write_regions(boxes, path)
    return model.read_regions(spark, path).select("region", "bbox.w", "bbox.s", "bbox.e", F.col("bbox.n").alias("north"))


# Regional builds

#: Overlapping boxes over the extent of the segments: quantity, and discount in whole hundredths.
_BOXES = (("north", 1.0, 0.0, 12.0, 0.04), ("south", 10.0, 0.03, 25.0, 0.07), ("east", 20.0, 0.0, 40.0, 0.05), ("west", 5.0, 0.06, 8.0, 0.1))
BOX_SQL = "boxes AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {w}, {s}, {e}, {t})" for r, w, s, e, t in _BOXES) + ") v(region, bw, bs, be, bt))"
#: Segments are small here: each has the least quantity and discount of its order as its place.
_SMALL = "small AS (SELECT * REPLACE (w AS e, s AS t) FROM seg)"
CUT = f", {_SMALL}, {BOX_SQL}, cut AS (SELECT region, small.* FROM small JOIN boxes ON w <= be AND e >= bw AND s <= bt AND t >= bs)"


def extracts(spark, sf_dir):
    small = segments(spark, sf_dir).withColumn("e", F.col("w")).withColumn("t", F.col("s"))
    return sets.extract(small, rows(spark, "region string, w double, s double, e double, t double", *_BOXES))


@query("regional_extract", REGIONS + CUT + " SELECT region, id FROM cut")
def regional_extract(spark, sf_dir):
    return extracts(spark, sf_dir).select("region", "id")


@query("regional_roll_up", REGIONS + CUT + ", merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY region) AS r FROM cut) WHERE r = 1), " + COMBOS.replace("FROM seg", "FROM merged") + f" SELECT {LIST}, n, km::DOUBLE AS km, arcs FROM combos")
def regional_roll_up(spark, sf_dir):
    """Each region's build in a folder of its own; all are read as one, seams are removed, then sets are rolled up."""
    path = fresh_path(spark, "builds")
    regional.write_regional(extracts(spark, sf_dir), path)
    return aggregate.sums_by_set(sets.seam_dedup(spark.read.parquet(path))).select(joined("refs"), "n", km(), "arcs")


_EXPECTED = (("north", "arcs", 400), ("north", "deepest", 5), ("south", "arcs", 1), ("south", "deepest", 6), ("east", "deepest", 4), ("nowhere", "arcs", 10))


@query("region_expectations", REGIONS + CUT + ", found AS (SELECT region, 'arcs' AS fact, count(*) AS value FROM cut GROUP BY 1 UNION ALL SELECT region, 'deepest', max(n) FROM cut GROUP BY 1), expected AS (SELECT * FROM (VALUES " + ", ".join(map(repr, _EXPECTED)) + ") v(region, fact, value)) SELECT region, fact, coalesce(f.value, 0)::BIGINT AS found, e.value::BIGINT AS expected, CASE WHEN coalesce(f.value, 0) < e.value THEN 'low' WHEN f.value > e.value THEN 'high' ELSE 'ok' END AS state FROM expected e LEFT JOIN found f USING (region, fact)")
def region_expectations(spark, sf_dir):
    facts = extracts(spark, sf_dir).groupBy("region").agg(F.count("*").alias("arcs"), F.max("n").cast("long").alias("deepest"))
    found = facts.unpivot("region", ["arcs", "deepest"], "fact", "value")
    return sets.against_expected(found, rows(spark, "region string, fact string, value long", *_EXPECTED))


_EDGES = "edges AS (SELECT o_orderstatus AS ref, o_orderkey AS a, (o_orderkey % 1000)::DOUBLE AS ax, o_orderkey + o_custkey % 3 AS b, ((o_orderkey + o_custkey % 3) % 1000)::DOUBLE AS bx FROM orders)"


@query("chain_ends", f"WITH {_EDGES}, each AS (SELECT ref, a AS node, ax AS x FROM edges UNION ALL SELECT ref, b, bx FROM edges), met AS (SELECT ref, node, count(*) AS degree, min(x) AS x FROM each GROUP BY 1, 2) SELECT node, string_agg(ref, ',' ORDER BY ref) AS refs, min(x) AS x, CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END::INTEGER AS shared FROM met WHERE degree = 1 AND x > 100 AND x < 900 GROUP BY node")
def chain_ends(spark, sf_dir):
    """Ends of chains that are no cuts at the box's edge, and whether designations share them."""
    key = F.col("o_orderkey")
    other = key + F.col("o_custkey") % 3
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("ref"), key.alias("a"), (key % 1000).cast("double").alias("ax"), other.alias("b"), (other % 1000).cast("double").alias("bx"))
    ends = sets.chain_ends(edges, 100, 900).groupBy("node").agg(F.array_sort(F.collect_set("ref")).alias("refs"), F.min("x").alias("x"))  # designations at one node
    return ends.select("node", joined("refs"), "x", (F.size("refs") >= 2).cast("int").alias("shared"))


# Selections as tables, checks, order, text

for label, chosen in (("known", (4, 7, 999)), ("all_dropped", (777, 999))):

    @query(f"selection_{label}", NATION_COMBOS + f"SELECT {LIST}, n, arcs FROM combos WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey IN {chosen}) OR list_has_any(refs, (SELECT list(n_nationkey) FROM nation WHERE n_nationkey IN {chosen}))")
    def selection(spark, sf_dir, chosen=chosen):
        known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ref"))
        asked = rows(spark, "ref int", *((c,) for c in chosen))
        return sets.touched(sums(spark, sf_dir, "nation"), asked, known).select(joined("refs"), "n", "arcs")


@query("missing_both_ways", "WITH a AS (SELECT DISTINCT c_nationkey AS ref FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS ref FROM supplier WHERE s_acctbal < 4000) SELECT ref, 'first' AS only_in FROM a WHERE ref NOT IN (SELECT ref FROM b) UNION ALL SELECT ref, 'second' FROM b WHERE ref NOT IN (SELECT ref FROM a)")
def missing_both_ways(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("ref"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal < 4000").select(F.col("s_nationkey").alias("ref"))
    return sets.missing_both_ways(a, b, "ref")


@query("check_tally", NATIONS + "SELECT c AS rule, passed::BIGINT AS passed, (total - passed)::BIGINT AS failed FROM (SELECT count(*) AS total, unnest(['named', 'shared', 'known_kind']) AS c, unnest([count(*) FILTER (name <> ''), count(*) FILTER (n >= 2), count(kind)]) AS passed FROM seg)")
def check_tally(spark, sf_dir):
    return aggregate.tally(segments(spark, sf_dir, "nation"), {"named": F.col("name") != "", "shared": F.col("n") >= 2, "known_kind": F.col("kind").isNotNull()})


@query("draw_order", NATIONS + "SELECT n, id FROM seg ORDER BY n, id")
def draw_order(spark, sf_dir):
    """All segments in the order they are drawn: deepest last, so on top."""
    return segments(spark, sf_dir, "nation").orderBy("n", "id").select("n", "id")


@query("ranking_names", NATION_COMBOS + f"SELECT {LIST}, n, CASE WHEN len(names) > 0 THEN array_to_string(names, ' / ') END AS names FROM (SELECT * FROM combos WHERE n >= 2 ORDER BY n DESC, km DESC, refs LIMIT 25)")
def ranking_names(spark, sf_dir):
    """The ranking's rows with the names of their segments."""
    shown = aggregate.ranking(sums(spark, sf_dir, "nation"), ())
    return aggregate.with_names(shown, model.names(spark, sf_dir)).select(joined("refs"), "n", scalar.names_text(F.col("names")).alias("names"))


@query("payload_numbers", REGION_COMBOS + f"SELECT {LIST}, w::BIGINT || ',' || e::BIGINT || ',' || n AS payload, w, e, n::DOUBLE AS depth, 3 AS parts FROM combos")
def payload_numbers(spark, sf_dir):
    """Numbers as a row's payload carries them, parsed back."""
    found = aggregate.combine(segments(spark, sf_dir)).select("refs", scalar.numbers_text(F.col("w"), F.col("e"), F.col("n")).alias("payload"))
    back = found.withColumn("v", scalar.parse_numbers(F.col("payload")))
    return back.select(joined("refs"), "payload", F.get("v", F.lit(0)).alias("w"), F.get("v", F.lit(1)).alias("e"), F.get("v", F.lit(2)).alias("depth"), F.size("v").alias("parts"))


@query("camera_boxes", NATION_COMBOS + f"SELECT {LIST}, w <= e AND s <= t AS usable, w = e OR s = t AS degenerate, 14 AS max_zoom FROM combos")
def camera_boxes(spark, sf_dir):
    """Boxes to point a view at: one without extent is usable, at the closest zoom."""
    found = aggregate.combine(segments(spark, sf_dir, "nation"))
    usable = sets.usable_box(*(F.col(c) for c in "wset"))
    return found.select(joined("refs"), usable.alias("usable"), ((F.col("w") == F.col("e")) | (F.col("s") == F.col("t"))).alias("degenerate"), F.lit(scalar.BOX_ZOOM).alias("max_zoom"))


#: Task files made of pages: one of fifty files has the pages of a remainder, each as a task of several lines. Pages
#: whose number divides by three name a shell.
_TASK_SQL = """files AS (SELECT page_id % 50 AS name, string_agg('[tasks.p' || page_id || ']' || chr(10) || CASE WHEN page_id % 3 = 0 THEN 'shell = "bash -c"' || chr(10) ELSE '' END || 'run = \"\"\"' || chr(10) || CASE WHEN page_id % 7 = 0 THEN 'one' ELSE url || chr(10) || 'two' END || chr(10) || '\"\"\"' || chr(10), chr(10) ORDER BY page_id) AS t FROM pages GROUP BY 1)"""


def _task_files(spark, sf_dir):
    """The files' folder, written once."""

    def write(path: str) -> None:
        shell = F.when(F.col("page_id") % 3 == 0, 'shell = "bash -c"\n').otherwise("")
        lines = F.when(F.col("page_id") % 7 == 0, F.lit("one")).otherwise(F.concat("url", F.lit("\ntwo")))
        task = F.concat(F.lit("[tasks.p"), F.col("page_id").cast("string"), F.lit("]\n"), shell, F.lit('run = """\n'), lines, F.lit('\n"""\n'))
        each = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("name"), F.struct("page_id", task.alias("t")).alias("p"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n")  # one file's tasks
        files.write_texts(each.groupBy("name").agg(text.alias("text")), path)

    return once(spark, "tasks", [f"{sf_dir}/pages.parquet"], write)


@query("bare_tasks", f"""WITH {_TASK_SQL}, parts AS (SELECT name, unnest(string_split(chr(10) || t, chr(10) || '[tasks.')[2:]) AS p, generate_subscripts(string_split(chr(10) || t, chr(10) || '[tasks.')[2:], 1) AS o FROM files),
found AS (SELECT name, o, split_part(p, ']', 1) AS task, len(list_filter(string_split(split_part(split_part(p, 'run = \"\"\"', 2), '\"\"\"', 1), chr(10)), lambda x: trim(x) <> '')) > 1 AND NOT contains(p, chr(10) || 'shell = ') AS bare FROM parts)
SELECT f.name::BIGINT AS name, coalesce((SELECT string_agg(task, ',' ORDER BY o) FROM found x WHERE x.name = f.name AND bare), '') AS tasks FROM files f""")
def bare_tasks(spark, sf_dir):
    """Tasks of several lines without a shell, in every task file of a folder."""
    read = files.read_texts(spark, _task_files(spark, sf_dir))
    return read.select(F.col("name").cast("long").alias("name"), F.array_join(scalar.bare_tasks(F.col("text")), ",").alias("tasks"))


@query("file_sizes", f"WITH {_TASK_SQL} SELECT name::BIGINT AS name, length(t)::BIGINT AS chars, len(regexp_extract_all(t, '\\[tasks'))::INTEGER AS tasks FROM files")
def file_sizes(spark, sf_dir):
    read = files.read_texts(spark, _task_files(spark, sf_dir))
    return read.select(F.col("name").cast("long").alias("name"), F.length("text").cast("long").alias("chars"), F.regexp_count("text", F.lit(r"\[tasks")).alias("tasks"))
