"""Queries over stored layouts: points and tiles, ranks, the document, regional builds; with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, ordinal, sets, spatial
from ..sources import document, regional
from ..sources import segments as model
from ..sources.segments import ENDPOINTS_SQL, WORLD, segments, sums, table, tiles
from ..sources.store import fresh_path, once, stored
from .builds import CUT, POINTS, extracts, placed
from .registry import COMBOS, LIST, NATION_COMBOS, NATIONS, REGION_COMBOS, REGIONS, joined, km, query

# Points and tiles

_PART = "SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 10) / 100.0::DOUBLE AS y FROM part"


def points(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point"), F.col("p_size").cast("double").alias("x"), ((F.col("p_partkey") % 10).cast("double") / 100.0).alias("y"))


@query("point_probe", NATIONS + f"SELECT point, hits, id, n FROM (SELECT p.p_partkey AS point, seg.id, seg.n, count(*) OVER (PARTITION BY p.p_partkey) AS hits, row_number() OVER (PARTITION BY p.p_partkey ORDER BY n DESC, seg.id) AS r FROM ({_PART}) p JOIN seg ON x BETWEEN w AND e AND y BETWEEN s AND t WHERE seg.e - seg.w <= 2 AND seg.t - seg.s <= 0.02) WHERE r = 1")
def point_probe(spark, sf_dir):
    """What a click at each part's place shows: how many small segments lie there, and the deepest of them."""
    small = segments(spark, sf_dir, "nation").where("e - w <= 2D and t - s <= 0.02D").select("id", "n", "w", "s", "e", "t")
    return spatial.deepest_hits(points(spark, sf_dir), small).select("point", "hits", "id", "n")


#: Views: zoom and box. The lower the zoom, the larger a segment must be to be drawn.
_VIEWS = {"cell_scan": (12, (10.0, 0.02, 29.0, 0.05)), "view_scan_low": (0, (0.0, 0.0, 64.0, 0.125)), "view_scan_middle": (2, (20.0, 0.03, 22.0, 0.04)), "view_scan_point": (12, (7.0, 0.01, 7.0, 0.01))}


def _view_sql(zoom: int, box: tuple[float, float, float, float]) -> str:
    w, s, e, t = box
    drawn = "true" if zoom + spatial.GRAIN >= spatial.LEVELS else f"greatest((e - w) / {WORLD.width()}::DOUBLE, (t - s) / {WORLD.height()}::DOUBLE) * {2 ** (zoom + spatial.GRAIN)} >= 1"
    return NATIONS + f"SELECT id, {LIST}, n FROM seg WHERE w <= {e}::DOUBLE AND e >= {w}::DOUBLE AND s <= {t}::DOUBLE AND t >= {s}::DOUBLE AND {drawn}"


for name, (zoom, box) in _VIEWS.items():

    @query(name, _view_sql(zoom, box))
    def view_scan(spark, sf_dir, zoom=zoom, box=box):
        """A view's segments, from the tiles and levels that it shows."""
        return spatial.read_view(spark, tiles(spark, sf_dir), WORLD, zoom, box).select("id", joined("refs"), "n")


# Ranks

def _ranked(spark, sf_dir: str, name: str, make, *keys) -> str:
    return once(spark, name, [f"{sf_dir}/{t}.parquet" for t in (*model.INPUTS, "events")], lambda path: ordinal.write_ranked(make(), path, *keys))


def ranking_path(spark, sf_dir):
    return _ranked(spark, sf_dir, "ranking", lambda: aggregate.concurrencies(sums(spark, sf_dir, "nation"), ()), F.desc("n"), F.desc("km"), F.asc("refs"))


@query("ranking_stored", NATION_COMBOS + f"SELECT row_number() OVER (ORDER BY n DESC, km DESC, refs) - 1 AS pos, {LIST}, n, km::DOUBLE AS km FROM combos WHERE n >= 2 QUALIFY pos < 25")
def ranking_stored(spark, sf_dir):
    """The top of the ranking, read from its stored order."""
    return ordinal.prefix(spark, ranking_path(spark, sf_dir), 25).select("pos", joined("refs"), "n", km())


@query("ranking_positions", NATION_COMBOS + f"SELECT row_number() OVER (ORDER BY n DESC, km DESC, refs) - 1 AS pos, {LIST} FROM combos WHERE n >= 2")
def ranking_positions(spark, sf_dir):
    return spark.read.parquet(ranking_path(spark, sf_dir)).select("pos", joined("refs"))


@query("draw_positions", NATIONS + "SELECT row_number() OVER (ORDER BY n, id) - 1 AS pos, id, n FROM seg")
def draw_positions(spark, sf_dir):
    """Every segment's place in the order of drawing."""
    path = _ranked(spark, sf_dir, "drawing", lambda: segments(spark, sf_dir, "nation").select("n", "id"), "n", "id")
    return spark.read.parquet(path).select("pos", "id", "n")


_MET = "met AS (SELECT place, list_sort(list_distinct(list(ref))) AS refs FROM points GROUP BY place)"


@query("shared_stored", ENDPOINTS_SQL + f", {_MET} SELECT row_number() OVER (ORDER BY len(refs) DESC, place) - 1 AS pos, place, {LIST} FROM met WHERE len(refs) >= 2 QUALIFY pos < 20")
def shared_stored(spark, sf_dir):
    path = _ranked(spark, sf_dir, "shared", lambda: sets.shared_ends(model.endpoints(spark, sf_dir)), F.desc(F.size("refs")), F.asc("place"))
    return ordinal.prefix(spark, path, 20).select("pos", "place", joined("refs"))


# The document


def written(spark, sf_dir) -> document.Document:
    """The display document of the region sets and of the events' ends, written once and read back."""
    path = once(spark, "document", [f"{sf_dir}/{t}.parquet" for t in (*model.INPUTS, "events")], lambda path: _write(spark, sf_dir, path))
    return document.read_document(spark, path)


def _write(spark, sf_dir, path: str) -> None:
    segs = segments(spark, sf_dir)
    combos = aggregate.extents_by_set(segs).select("refs", "n", F.col("km").cast("double").alias("km"), "arcs", document.box(*"wset"))
    placed_combos, names = document.placed_combinations(combos, segs, [F.desc("n"), F.desc("km"), F.asc("refs")])
    ends = stored(placed(model.endpoints(spark, sf_dir).select(F.ascii("ref").alias("ref"), "place")).distinct(), "ends")  # four readers, and few rows
    where = ends.select("place", "lon", "lat").distinct()
    shared = ordinal.ranked(sets.shared_ends(ends).join(where, "place"), F.desc(F.size("refs")), F.asc("lon"), F.asc("lat"))
    single = ordinal.ranked(sets.single_ends(ends).join(where, "place"), "ref", "lon", "lat")
    dates = segs.agg(F.min("updated").alias("oldest_edit"), F.max("updated").alias("newest_edit"), F.array_sort(F.collect_set("src")).alias("endpoints"), document.box(F.min("w"), F.min("s"), F.max("e"), F.max("t")))  # a handful of kinds of evidence
    stamp = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("osm_timestamp"))
    document.write_document(path, dates.join(stamp), {"combinations": placed_combos, "names": names, "termini": single, "shared_termini": shared})


@query("document_combinations", REGION_COMBOS + f"SELECT row_number() OVER (ORDER BY n DESC, km DESC, refs) - 1 AS pos, {LIST}, n, km::DOUBLE AS km, arcs, w, t AS north FROM combos")
def document_combinations(spark, sf_dir):
    found = written(spark, sf_dir).relation("combinations")
    return found.select("pos", joined("refs"), "n", "km", "arcs", F.col("bbox.w").alias("w"), F.col("bbox.n").alias("north"))


@query("document_names", REGION_COMBOS + "SELECT row_number() OVER (ORDER BY n DESC, km DESC, refs) - 1 AS pos, unnest(names) AS name FROM combos")
def document_names(spark, sf_dir):
    return written(spark, sf_dir).relation("names")


@query("document_ends", ENDPOINTS_SQL + f", placed AS ({POINTS}), met AS (SELECT place, lon, lat, list_sort(list_distinct(list(ascii(ref)))) AS refs FROM placed GROUP BY 1, 2, 3) SELECT {LIST}, lon::DOUBLE AS lon, lat::DOUBLE AS lat, CASE WHEN len(refs) >= 2 THEN 1 ELSE 0 END::INTEGER AS shared FROM met")
def document_ends(spark, sf_dir):
    doc = written(spark, sf_dir)
    shared = doc.relation("shared_termini").select("refs", "lon", "lat", F.lit(1).alias("shared"))
    single = doc.relation("termini").select(F.array("ref").alias("refs"), "lon", "lat", F.lit(0).alias("shared"))
    return shared.unionByName(single).orderBy(F.desc("shared"), "lon", "lat").select(joined("refs"), "lon", "lat", "shared")


@query("document_head", REGION_COMBOS + "SELECT strftime((SELECT max(ts) FROM events), '%Y-%m-%d %H:%M') || 'Z' AS base, min(updated)::VARCHAR AS oldest_edit, max(updated)::VARCHAR AS newest_edit, array_to_string(list_sort(list_distinct(list(src))), ' / ') AS endpoints, min(w) AS w, min(s) AS s, max(e) AS e, max(t) AS north, (SELECT count(*) FROM combos)::BIGINT AS combinations FROM seg")
def document_head(spark, sf_dir):
    """Dates, evidence and extent as the panel shows them."""
    head = written(spark, sf_dir).head
    return head.select(F.concat(F.date_format("osm_timestamp", "yyyy-MM-dd HH:mm"), F.lit("Z")).alias("base"), F.col("oldest_edit").cast("string").alias("oldest_edit"), F.col("newest_edit").cast("string").alias("newest_edit"), F.array_join("endpoints", " / ").alias("endpoints"), "bbox.w", "bbox.s", "bbox.e", F.col("bbox.n").alias("north"), "rows.combinations")


# Regional builds

#: One region is built anew: every seventh segment is gone from it, and lengths are longer.
_CHANGED = "SELECT * REPLACE ((km + 1)::DECIMAL(18, 2) AS km) FROM cut WHERE region = 'south' AND id % 7 <> 0"
_MERGED = "merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY region) AS r FROM now) WHERE r = 1)"


@query("incremental_roll_up", REGIONS + CUT + f", now AS (SELECT * FROM cut WHERE region <> 'south' UNION ALL ({_CHANGED})), {_MERGED}, " + COMBOS.replace("FROM seg", "FROM merged") + f" SELECT {LIST}, n, km::DOUBLE AS km, arcs FROM combos")
def incremental_roll_up(spark, sf_dir):
    """The roll-up after one region changed: what its segments gave is taken off, what they give now is added."""
    builds, roll_up = fresh_path(spark, "builds"), fresh_path(spark, "rollup")
    regional.write_regional(extracts(spark, sf_dir), builds)
    regional.write_roll_up(spark, builds, roll_up)
    old = spark.read.parquet(builds).where("region = 'south' and id % 7 <> 0")
    regional.replace_regions(spark, builds, roll_up, old.withColumn("km", (F.col("km") + 1).cast("decimal(18,2)")))
    return regional.read_roll_up(spark, roll_up).select(joined("refs"), "n", km(), "arcs")
