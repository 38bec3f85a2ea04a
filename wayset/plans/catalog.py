"""Names, queries and SQL of the engine's own operators.

Every entry is a function of (spark, sf_dir) and the DuckDB statement that gives the same rows from the same tables.
Sets are given as joined text and lengths as doubles of exact decimals, so that both engines' values compare.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, scalar
from ..operators import aggregate, filters, sets, spatial
from ..sources.segments import ENDPOINTS_SQL, endpoints, members, segments, segments_sql, sums, table
from . import builds, evidence, stores  # noqa: F401  register their queries
from .registry import LIST, NATION_COMBOS, NATIONS, ORACLES, QUERIES, REGION_COMBOS, REGIONS, joined, km, query, rows

__all__ = ["ORACLES", "QUERIES"]


# Roll-up by set, and the two sums over it


for by, head in (("region", REGION_COMBOS), ("nation", NATION_COMBOS)):

    @query(f"combos_{by}", head + f"SELECT {LIST}, n, km::DOUBLE AS km, arcs, len(names)::BIGINT AS n_names, names[1] AS first_name, w, s, e, t FROM combos")
    def combos(spark, sf_dir, by=by):
        found = aggregate.combine(segments(spark, sf_dir, by))
        return found.select(joined("refs"), "n", km(), "arcs", "n_names", "first_name", "w", "s", "e", "t")

    @query(f"routes_of_{by}", head + "SELECT ref, (floor(sum(km) * 10 + 0.5) / 10)::DOUBLE AS km, sum(arcs)::BIGINT AS arcs, greatest(1, max(n))::INTEGER AS max_n FROM (SELECT unnest(refs) AS ref, km, arcs, n FROM combos) GROUP BY ref ORDER BY ref")
    def routes_of(spark, sf_dir, by=by):
        return aggregate.routes_of(sums(spark, sf_dir, by))


def _stats_sql(where: str) -> str:
    return REGION_COMBOS + f"SELECT coalesce(sum(arcs), 0)::BIGINT AS arcs, coalesce(sum(km), 0)::DOUBLE AS km, coalesce(sum(CASE WHEN n >= 2 THEN arcs ELSE 0 END), 0)::BIGINT AS conc FROM combos WHERE {where}"


for label, chosen in (("all", ()), ("one", (3,)), ("two", (1, 2)), ("unknown", (999,))):

    @query(f"stats_{label}", _stats_sql(f"list_has_any(refs, {list(chosen)})" if chosen else "true"))
    def stats(spark, sf_dir, chosen=chosen):
        return aggregate.stats_for(sums(spark, sf_dir), chosen)


@query("conc_ranking", NATION_COMBOS + f"SELECT {LIST}, n, km::DOUBLE AS km FROM (SELECT * FROM combos WHERE n >= 2 ORDER BY n DESC, km DESC, refs LIMIT 25)")
def conc_ranking(spark, sf_dir):
    return aggregate.ranking(sums(spark, sf_dir, "nation"), ()).select(joined("refs"), "n", km())


@query("conc_ranking_selected", NATION_COMBOS + f"SELECT {LIST}, n, km::DOUBLE AS km FROM (SELECT * FROM combos WHERE n >= 2 AND list_has_any(refs, [4, 7]) ORDER BY n DESC, km DESC, refs LIMIT 25)")
def conc_ranking_selected(spark, sf_dir):
    return aggregate.ranking(sums(spark, sf_dir, "nation"), (4, 7)).select(joined("refs"), "n", km())


@query("conc_count", NATION_COMBOS + "SELECT least(count(*), 25)::BIGINT AS shown, count(*)::BIGINT AS total FROM combos WHERE n >= 2")
def conc_count(spark, sf_dir):
    return aggregate.shown_of_total(aggregate.concurrencies(sums(spark, sf_dir, "nation"), ()), 25)


@query("depth_histogram", NATIONS + "SELECT n, count(*)::BIGINT AS arcs FROM seg GROUP BY n")
def depth_histogram(spark, sf_dir):
    return aggregate.depth_histogram(segments(spark, sf_dir, "nation"))


@query("max_depth", NATIONS + "SELECT n, count(*)::BIGINT AS arcs FROM seg WHERE n = (SELECT max(n) FROM seg) GROUP BY n")
def max_depth(spark, sf_dir):
    return aggregate.depth_histogram(segments(spark, sf_dir, "nation")).orderBy(F.desc("n")).limit(1)


@query("length_identity", REGION_COMBOS + "SELECT sum(km)::DOUBLE AS real_km, sum(km * n)::DOUBLE AS designated_km FROM combos")
def length_identity(spark, sf_dir):
    return aggregate.lengths(sums(spark, sf_dir))


for column in ("kind", "src"):

    @query(f"{column}_counts", REGIONS + f"SELECT coalesce({column}, 'unknown') AS {column}, count(*)::BIGINT AS arcs, count(*) FILTER (former)::BIGINT AS former FROM seg GROUP BY 1")
    def counts(spark, sf_dir, column=column):
        return aggregate.counts_by(segments(spark, sf_dir), column)


@query("extent", REGIONS + "SELECT min(w) AS w, min(s) AS s, max(e) AS e, max(t) AS t FROM seg")
def extent(spark, sf_dir):
    return aggregate.extent(segments(spark, sf_dir))


@query("edit_range", REGIONS + "SELECT min(updated)::VARCHAR AS oldest_edit, max(updated)::VARCHAR AS newest_edit FROM seg")
def edit_range(spark, sf_dir):
    return aggregate.edit_range(segments(spark, sf_dir))


@query("last_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark, sf_dir):
    return aggregate.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("bucket_group", "SELECT (p_partkey // 256 * 256)::BIGINT AS bucket, count(*)::BIGINT AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1")
def bucket_group(spark, sf_dir):
    found = aggregate.bucketed(table(spark, sf_dir, "part"), "p_partkey")
    return found.select("bucket", F.size("members").cast("long").alias("n"), F.array_min("members").alias("first"), F.array_max("members").alias("last"))


@query("alphabet_check", "SELECT DISTINCT c FROM (SELECT unnest(string_split(p_brand, '')) AS c FROM part) WHERE c <> '' AND c NOT IN ('0','1','2','3','4','5','6','7','8','9','#')")
def alphabet_check(spark, sf_dir):
    signs = table(spark, sf_dir, "part").select(F.explode(F.split("p_brand", "")).alias("c")).where("c <> ''").distinct()
    return signs.join(rows(spark, "c string", *((c,) for c in "0123456789#")), "c", "left_anti")


# Filters


def _filtered(name: str, where: str, make, by: str = "nation"):
    @query(name, segments_sql(by) + f"SELECT id, {LIST}, n, kind FROM seg WHERE {where}")
    def filtered(spark, sf_dir):
        return segments(spark, sf_dir, by).where(make()).select("id", joined("refs"), "n", "kind")


_filtered("filter_any", "list_has_any(refs, [4, 14])", lambda: filters.shared_filter((4, 14)))
_filtered("filter_none", "true", lambda: filters.shared_filter(()))
_filtered("filter_conc", "n >= 2", lambda: filters.shared_filter((), "all"))
_filtered("filter_both", "n >= 2 AND list_has_any(refs, [18])", lambda: filters.shared_filter((18,), "all"))
_filtered("filter_kind", "coalesce(kind IN ('ferry', 'construction'), false)", lambda: filters.of_kind(["ferry", "construction"]))
_filtered("filter_not_kind", "NOT coalesce(kind IN ('ferry', 'construction'), false)", lambda: filters.of_kind(["ferry", "construction"], negate=True))
_filtered("filter_nothing", "false", filters.nothing)
_filtered("filter_picked", "id = 7", lambda: filters.picked(F.lit(True), 7))
_filtered("filter_picked_base", "id = 7 AND n >= 2", lambda: filters.picked(filters.shared_filter((), "all"), 7))


@query("filter_member", NATIONS + f"SELECT id, {LIST}, n, kind FROM seg WHERE list_contains(refs, 4)")
def filter_member(spark, sf_dir):
    return members(spark, sf_dir, "nation").where("ref = 4").select("id", joined("refs"), "n", "kind")


@query("filter_member_text", NATIONS + "SELECT id FROM seg WHERE contains(',' || array_to_string(refs, ',') || ',', ',4,')")
def filter_member_text(spark, sf_dir):
    return segments(spark, sf_dir, "nation").withColumn("refs_s", codec.wrap_refs(F.col("refs"))).where(filters.has_ref_text(4)).select("id")


@query("filter_expression", NATIONS + "SELECT id, CASE n WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS style FROM seg WHERE n >= 2 AND (contains(',' || array_to_string(refs, ',') || ',', ',4,') OR contains(',' || array_to_string(refs, ',') || ',', ',18,')) AND NOT coalesce(kind IN ('ferry'), false)")
def filter_expression(spark, sf_dir):
    segs = segments(spark, sf_dir, "nation").withColumn("refs_s", codec.wrap_refs(F.col("refs")))
    tree = ["all", ["any", ["in", ",4,", ["get", "refs_s"]], ["in", ",18,", ["get", "refs_s"]]], [">=", ["get", "n"], 2], ["!", ["in", ["get", "kind"], ["literal", ["ferry"]]]]]
    style = ["match", ["get", "n"], 1, "a", 2, "b", "c"]
    return segs.where(filters.compile_expr(tree)).select("id", filters.compile_expr(style).alias("style"))


def _layer_sql(toggles: dict[str, bool]) -> str:
    parts = []
    for name, kinds, negate, toggle in filters.LAYERS:
        test = "true"
        if toggle is not None and not toggles.get(toggle, True):
            test = "false"
        elif kinds is not None:
            test = f"coalesce(kind IN ({', '.join(repr(k) for k in kinds)}), false)"
            test = f"NOT {test}" if negate else test
        parts.append(f"SELECT '{name}' AS layer, id FROM seg WHERE n >= 2 AND {test}")
    return NATIONS + "SELECT layer, count(*)::BIGINT AS arcs, sum(id)::BIGINT AS ids FROM (" + " UNION ALL ".join(parts) + ") GROUP BY layer"


for label, toggles in (("", {}), ("_toggled", {"ferry": False, "special": False})):

    @query(f"layer_dispatch{label}", _layer_sql(toggles))
    def layer_dispatch(spark, sf_dir, toggles=toggles):
        return filters.layer_sums(segments(spark, sf_dir, "nation"), filters.shared_filter((), "all"), toggles)


@query("clickable_layers", _layer_sql({}).replace("GROUP BY layer", f"WHERE layer IN ({', '.join(repr(c) for c in filters.CLICKABLE)}) GROUP BY layer"))
def clickable_layers(spark, sf_dir):
    return filters.layer_sums(segments(spark, sf_dir, "nation"), filters.shared_filter((), "all"), layers=filters.CLICKABLE)


@query("layer_rows", _layer_sql({"labels": False}).replace("SELECT layer, count(*)::BIGINT AS arcs, sum(id)::BIGINT AS ids FROM", "SELECT layer, id FROM").replace(" GROUP BY layer", ""))
def layer_rows(spark, sf_dir):
    """Every segment with each layer that draws it."""
    return filters.dispatch(segments(spark, sf_dir, "nation"), filters.shared_filter((), "all"), {"labels": False}).select("layer", "id")


@query("label_order", NATIONS + "SELECT n, id FROM seg ORDER BY n DESC, id")
def label_order(spark, sf_dir):
    """All labels of a zoom that shows them, deepest placed first."""
    return segments(spark, sf_dir, "nation").where(filters.visible(10, "route-labels")).orderBy(F.desc("n"), "id").select("n", "id")


@query("prefix_search", "SELECT p_partkey FROM part WHERE starts_with(p_partkey::VARCHAR, '15')")
def prefix_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(filters.prefix_search("p_partkey", " 15 ")).select("p_partkey")


@query("preference", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'view' END AS kept FROM events")
def preference(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", filters.allowed(F.col("event_type"), ["click", "view"], "view").alias("kept"))


# Lookups, joins, sets


@query("deepest_per_cell", NATIONS + "SELECT cell, id, n FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, id) AS r FROM (SELECT id % 50 AS cell, id, n FROM seg)) WHERE r = 1")
def deepest_per_cell(spark, sf_dir):
    return aggregate.deepest(segments(spark, sf_dir, "nation").select((F.col("id") % 50).alias("cell"), "id", "n"))


@query("point_hits", NATIONS + "SELECT p.p_partkey AS point, seg.id FROM (SELECT p_partkey, (p_size)::DOUBLE AS x, (p_partkey % 10) / 100.0::DOUBLE AS y FROM part) p JOIN seg ON x BETWEEN w AND e AND y BETWEEN s AND t")
def point_hits(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point"), F.col("p_size").cast("double").alias("x"), ((F.col("p_partkey") % 10).cast("double") / 100.0).alias("y"))
    return spatial.point_hits(points, segments(spark, sf_dir, "nation").select("id", "w", "s", "e", "t")).select("point", "id")


@query("known_semi", "SELECT ref FROM (VALUES (3), (7), (24), (25), (999)) v(ref) WHERE ref IN (SELECT n_nationkey FROM nation)")
def known_semi(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ref"))
    return sets.known_only(rows(spark, "ref int", (3,), (7,), (24,), (25,), (999,)), known)


@query("label_lookup", REGIONS + "SELECT id, kind, CASE kind WHEN 'road' THEN 'R' WHEN 'ferry' THEN 'F' ELSE kind END AS label FROM seg")
def label_lookup(spark, sf_dir):
    names = rows(spark, "key string, label string", ("road", "R"), ("ferry", "F"))
    return sets.with_label(segments(spark, sf_dir).select("id", "kind"), names, "kind")


@query("region_fallback", "WITH boxes AS (SELECT r_name AS region, r_regionkey::DOUBLE AS w, 0.0::DOUBLE AS s, (r_regionkey + 1)::DOUBLE AS e, 1.0::DOUBLE AS t FROM region), whole AS (SELECT min(w) AS w, min(s) AS s, max(e) AS e, max(t) AS t FROM boxes) SELECT region, coalesce(b.w, a.w) AS w, coalesce(b.s, a.s) AS s, coalesce(b.e, a.e) AS e, coalesce(b.t, a.t) AS t FROM (VALUES ('ASIA'), ('NOWHERE')) v(region) LEFT JOIN boxes b USING (region), whole a")
def region_fallback(spark, sf_dir):
    boxes = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.col("r_regionkey").cast("double").alias("w"), F.lit(0.0).alias("s"), (F.col("r_regionkey") + 1).cast("double").alias("e"), F.lit(1.0).alias("t"))
    return sets.region_or_default(rows(spark, "region string", ("ASIA",), ("NOWHERE",)), boxes, aggregate.extent(boxes))


@query("set_intersect", "SELECT s_nationkey AS ref FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def set_intersect(spark, sf_dir):
    owing = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_nationkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("ref")).intersect(owing)


@query("set_except", "SELECT p_partkey AS ref FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def set_except(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref")).subtract(sold)


@query("full_outer_diff", "SELECT coalesce(a.id, b.id) AS id, a.v AS old, b.v AS new, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS state FROM (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0) b ON a.id = b.id")
def full_outer_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    new = orders.where("id % 11 <> 0").withColumn("v", F.when(F.col("id") % 5 == 0, F.lit("X")).otherwise(F.col("v")))
    return sets.full_compare(orders.where("id % 7 <> 0"), new, "id", "v")


@query("seam_dedup", "SELECT id, min(region) AS region FROM (SELECT o_orderkey AS id, o_orderkey % 4 AS region FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 3 FROM orders) GROUP BY id")
def seam_dedup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    builds = [orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % k).alias("region")) for k in (4, 3)]
    return sets.seam_dedup(builds[0].unionByName(builds[1]))


@query("kind_union", REGIONS + "SELECT cell, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS kinds FROM (SELECT id % 50 AS cell, list(DISTINCT kind) FILTER (src = 'tag' AND kind IS NOT NULL) AS a, list(DISTINCT kind) FILTER (former AND kind IS NOT NULL) AS b FROM seg GROUP BY 1)")
def kind_union(spark, sf_dir):
    """Kinds of each cell that are known from tags or belong to former roads."""
    some = lambda test: F.collect_set(F.when(test, F.col("kind")))  # noqa: E731  a handful of kinds
    lists = segments(spark, sf_dir).groupBy((F.col("id") % 50).alias("cell")).agg(some(F.col("src") == "tag").alias("a"), some(F.col("former")).alias("b"))
    return lists.select("cell", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("kinds"))


_COVERED = " UNION ALL ".join(f"SELECT id FROM seg WHERE {test}" for test in (f"{'NOT ' if negate else ''}coalesce(kind IN ({', '.join(map(repr, kinds))}), false)" for _, kinds, negate, toggle in filters.LAYERS if kinds is not None and toggle != "ferry"))


@query("kind_coverage", REGIONS + f"SELECT coalesce(kind, 'unknown') AS kind, count(*)::BIGINT AS arcs, count(*) FILTER (id NOT IN ({_COVERED}))::BIGINT AS uncovered FROM seg GROUP BY 1")
def kind_coverage(spark, sf_dir):
    """Segments of each kind, and those that no layer of a kind shows while the ferry switch is off."""
    shown = [filters.layer_filter(layer, F.lit(True), {"ferry": False}) for layer in filters.LAYERS if layer[1] is not None]
    covered = F.exists(F.array(*shown), lambda x: x)
    return segments(spark, sf_dir).groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("arcs"), F.count_if(~covered).alias("uncovered"))


_SHARED = ENDPOINTS_SQL + ", met AS (SELECT place, list_sort(list_distinct(list(ref))) AS refs FROM points GROUP BY place)\n"


@query("shared_termini", _SHARED + f"SELECT place, {LIST}, len(refs)::INTEGER AS n FROM met WHERE len(refs) >= 2")
def shared_termini(spark, sf_dir):
    return sets.shared_ends(endpoints(spark, sf_dir)).select("place", joined("refs"), F.size("refs").alias("n"))


@query("shared_ranking", _SHARED + f"SELECT place, {LIST} FROM (SELECT * FROM met WHERE len(refs) >= 2 ORDER BY len(refs) DESC, place LIMIT 20)")
def shared_ranking(spark, sf_dir):
    return sets.shared_ends(endpoints(spark, sf_dir)).orderBy(F.desc(F.size("refs")), "place").limit(20).select("place", joined("refs"))


@query("termini_union", _SHARED + "SELECT place, array_to_string(refs, '・') AS label, CASE WHEN len(refs) >= 2 THEN 1 ELSE 0 END::INTEGER AS shared, len(refs)::INTEGER AS count FROM met")
def termini_union(spark, sf_dir):
    ends = endpoints(spark, sf_dir)
    every = sets.all_ends(sets.shared_ends(ends), sets.single_ends(ends))
    return every.orderBy(F.desc("shared"), "place").select("place", codec.label_refs(F.col("refs")).alias("label"), "shared", "count")


@query("termini_filter", _SHARED + f"SELECT place, {LIST} FROM met WHERE list_has_any(refs, ['click', 'signup'])")
def termini_filter(spark, sf_dir):
    ends = endpoints(spark, sf_dir)
    every = sets.all_ends(sets.shared_ends(ends), sets.single_ends(ends))
    return every.where(filters.ends_filter(("click", "signup"))).select("place", joined("refs"))


@query("judgement", "SELECT o_orderkey AS id, coalesce(a, b, c)::VARCHAR AS value, CASE WHEN a IS NOT NULL THEN 'relation' WHEN b IS NOT NULL THEN 'name' WHEN c IS NOT NULL THEN 'tag' END AS src FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 END::INTEGER AS a, CASE WHEN o_orderkey % 3 = 0 THEN 2 END::INTEGER AS b, CASE WHEN o_orderkey % 5 = 0 THEN 3 END::INTEGER AS c FROM orders)")
def judgement(spark, sf_dir):
    k = F.col("o_orderkey")
    value, src = sets.judge(F.when(k % 2 == 0, 1), F.when(k % 3 == 0, 2), F.when(k % 5 == 0, 3))
    return table(spark, sf_dir, "orders").select(k.alias("id"), value.cast("string").alias("value"), src.alias("src"))


_CLAIMS = "claims AS (SELECT c_custkey AS id, c_nationkey % 5 AS region, c_nationkey AS ref FROM customer)"


@query("corroborate", f"WITH {_CLAIMS}, sure AS (SELECT region, ref FROM claims GROUP BY 1, 2 HAVING count(*) >= 60) SELECT id, region, ref FROM claims JOIN sure USING (region, ref)")
def corroborate(spark, sf_dir):
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("region"), F.col("c_nationkey").alias("ref"))
    return sets.corroborate(claims, least=60).select("id", "region", "ref")


@query("route_extent_leak", "SELECT s_nationkey AS ref, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier GROUP BY 1 HAVING min(s_acctbal) < -500 OR max(s_acctbal) > 9000")
def route_extent_leak(spark, sf_dir):
    found = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("ref"), F.col("s_acctbal").alias("x"))
    expected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ref"), F.lit(-500.0).alias("lo"), F.lit(9000.0).alias("hi"))
    return sets.leaked(found, expected)


@query("broken_chain", "WITH edges AS (SELECT o_orderstatus AS ref, o_orderkey AS a, o_orderkey + o_custkey % 3 AS b FROM orders), nodes AS (SELECT ref, unnest([a, b]) AS node FROM edges) SELECT ref, count(*)::BIGINT AS open_ends FROM (SELECT ref, node FROM nodes GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY ref")
def broken_chain(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("ref"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + F.col("o_custkey") % 3).alias("b"))
    return sets.broken_chains(edges)


# Codecs


@query("encode_ranges", "WITH r AS (SELECT DISTINCT c_nationkey AS k, c_custkey AS ref FROM customer), i AS (SELECT k, ref, ref - row_number() OVER (PARTITION BY k ORDER BY ref) AS g FROM r), runs AS (SELECT k, min(ref) AS a, max(ref) AS b FROM i GROUP BY k, g) SELECT k, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM runs GROUP BY k")
def encode_ranges(spark, sf_dir):
    return codec.encode_ranges(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("ref")), "k")


@query("encode_array", "WITH r AS (SELECT id, unnest(refs) AS ref FROM seg), i AS (SELECT id, ref, ref - row_number() OVER (PARTITION BY id ORDER BY ref) AS g FROM r), runs AS (SELECT id, min(ref) AS a, max(ref) AS b FROM i GROUP BY id, g) SELECT id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM runs GROUP BY id".replace("WITH r", NATIONS + ", r"))
def encode_array(spark, sf_dir):
    return segments(spark, sf_dir, "nation").select("id", codec.encode_array(F.col("refs")).alias("ranges"))


#: Range lists of customers: valid, reversed, repeated, malformed and wide parts. The same text in both engines.
_LIST = "CASE c_custkey % 10 WHEN 0 THEN '1-3,abc,,9-8,' || c_custkey WHEN 1 THEN c_custkey || '-' || (c_custkey + 4) || ', 2' WHEN 2 THEN '1-3,2,' || c_nationkey WHEN 3 THEN '' WHEN 4 THEN 'x' || c_custkey WHEN 5 THEN '9990-' || (10100 + c_nationkey) WHEN 6 THEN '123456789012,' || c_custkey WHEN 7 THEN '5-4,' || c_custkey || '-' || c_custkey WHEN 8 THEN c_custkey || '-' || (c_custkey + 5000 * (CAST(floor(c_custkey % 100 / 98.0) AS INTEGER))) ELSE '007,' || c_nationkey || '-' END"
_BOUNDS = "SELECT i, o, TRY_CAST(split_part(p, '-', 1) AS HUGEINT) AS a, TRY_CAST(split_part(p, '-', CASE WHEN contains(p, '-') THEN 2 ELSE 1 END) AS HUGEINT) AS b FROM (SELECT i, unnest(string_split(t, ',')) AS p, generate_subscripts(string_split(t, ','), 1) AS o FROM {source}) WHERE regexp_full_match(p, '[0-9]+(-[0-9]+)?')"


@query("decode_ranges", f"WITH b AS ({_BOUNDS.format(source=f'(SELECT c_custkey AS i, {_LIST} AS t FROM customer)')}), v AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY o) - 1 AS part FROM b WHERE b >= a) SELECT i AS id, part::INTEGER AS part, unnest(generate_series(a::BIGINT, b::BIGINT)) AS ref FROM v")
def decode_ranges(spark, sf_dir):
    given = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_LIST).alias("t"))
    return codec.expand_ranges(given, "t").select("id", "part", "ref")


@query("decode_array", f"WITH b AS ({_BOUNDS.format(source=f'(SELECT c_custkey AS i, {_LIST} AS t FROM customer)')}), x AS (SELECT i, o, unnest(generate_series(a::BIGINT, b::BIGINT)) AS n FROM b WHERE b >= a), g AS (SELECT i, string_agg(n::VARCHAR, ',' ORDER BY o, n) AS refs FROM x GROUP BY i) SELECT c_custkey AS id, coalesce(refs, '') AS refs FROM customer LEFT JOIN g ON g.i = c_custkey")
def decode_array(spark, sf_dir):
    given = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_LIST).alias("t"))
    return given.select("id", joined(codec.decode_ranges(F.col("t"))))


@query("decode_known", "SELECT DISTINCT c_custkey AS id, n_nationkey AS ref FROM (SELECT c_custkey, c_nationkey AS a, c_nationkey + c_custkey % 7 AS b FROM customer UNION ALL SELECT c_custkey, 20, 999999999999 FROM customer WHERE c_custkey % 3 = 0) JOIN nation ON n_nationkey BETWEEN a AND b")
def decode_known(spark, sf_dir):
    key, first = F.col("c_custkey"), F.col("c_nationkey")
    wide = F.when(key % 3 == 0, F.lit("20-999999999999"))
    given = table(spark, sf_dir, "customer").select(key.alias("id"), F.concat_ws(",", F.concat_ws("-", first, first + key % 7), F.lit("x"), wide).alias("t"))
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ref"))
    return codec.decode_known(given, "t", known).select("id", "ref")


_WRAPPED = "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN ',x,' || {refs} || ',' WHEN 2 THEN NULL ELSE ',' || {refs} || ',' END"


@query("refs_parse", NATIONS + f"SELECT id, array_to_string(list_transform(list_filter(string_split(coalesce(t, ''), ','), lambda x: x <> ''), lambda x: try_cast(x AS INTEGER)), ',') AS refs, len(list_filter(string_split(coalesce(t, ''), ','), lambda x: x <> ''))::INTEGER AS n FROM (SELECT id, {_WRAPPED.format(refs="array_to_string(refs, ',')")} AS t FROM seg)")
def refs_parse(spark, sf_dir):
    given = segments(spark, sf_dir, "nation").select("id", F.expr(_WRAPPED.format(refs="array_join(refs, ',')")).alias("t"))
    return given.select("id", joined(codec.parse_refs(F.col("t"))), F.size(codec.parse_refs(F.col("t"))).alias("n"))


@query("refs_round_trip", NATIONS + f"SELECT id, {LIST}, true AS same FROM seg")
def refs_round_trip(spark, sf_dir):
    """Sets written as range lists and as wrapped text, and read back: the same sets."""
    segs = segments(spark, sf_dir, "nation")
    back = codec.decode_ranges(codec.encode_array(F.col("refs"))).cast("array<int>")
    return segs.select("id", joined(back), (codec.parse_refs(codec.wrap_refs(F.col("refs"))) == F.col("refs")).alias("same"))


_STATES = (
    "routes=1-3%2C18&conc=all", "?conc=nonsense&labels=0", "labels&ferry=1&labels=0", "", "routes=&special=", "other=1&routes=5", "x=1&%ZZ=3&routes=5&routes=6", "x=%E0%A4%A&routes=7,8,9-12&termini=0",
    "routes=1-999999999,5&conc=all", "routes=123456789012,%ZZ,3", "routes=9-2,4-6,1-3,11", "expressway=%30&a=b=c&special=%",
)
#: Customers' query strings: each pattern with the customer's own number, the last with a list of its nation.
_QUERY = f"CASE c_custkey % {len(_STATES) + 1} " + " ".join(f"WHEN {i} THEN {t!r}" for i, t in enumerate(_STATES)) + " ELSE 'conc=all&routes=' || c_nationkey || '-' || (c_nationkey + c_custkey % 4) || '%2C3' END || '&c=' || c_custkey"
#: Escapes that are whole and give UTF-8 are decoded; a text with any other stays as it is.
_DECODED = "CASE WHEN regexp_full_match({0}, '([^%]|%[0-9A-Fa-f]{{2}})*') THEN url_decode(replace({0}, '+', ' ')) ELSE {0} END"
_STATE_SQL = f"""WITH given AS (SELECT c_custkey AS i, {_QUERY} AS q FROM customer),
pairs AS (SELECT i, o, {_DECODED.format("split_part(p, '=', 1)")} AS k, CASE WHEN contains(p, '=') THEN {_DECODED.format("substr(p, strpos(p, '=') + 1)")} ELSE '' END AS v
  FROM (SELECT i, unnest(string_split(regexp_replace(q, '^[?]', ''), '&')) AS p, generate_subscripts(string_split(regexp_replace(q, '^[?]', ''), '&'), 1) AS o FROM given) WHERE p <> ''),
first AS (SELECT i, k, arg_min(v, o) AS v FROM pairs GROUP BY i, k),
routes AS (SELECT i, v AS t FROM first WHERE k = 'routes'),
b AS (SELECT i, a, b FROM ({_BOUNDS.format(source="routes")}) WHERE b >= a),
steps AS (SELECT i, a, b, CASE WHEN a <= 1 + max(b) OVER (PARTITION BY i ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM b),
runs AS (SELECT i, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY i ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM steps) GROUP BY i, g),
chosen AS (SELECT i, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS selected FROM runs GROUP BY i)
SELECT given.i, (SELECT selected FROM chosen c WHERE c.i = given.i) AS selected, (SELECT 'all' FROM first f WHERE f.i = given.i AND k = 'conc' AND v = 'all') AS conc,
  {", ".join(f"(SELECT (v <> '0')::VARCHAR FROM first f WHERE f.i = given.i AND k = '{k}') AS {k}" for k in codec.TOGGLES)} FROM given"""


@query("state_decode", _STATE_SQL)
def state_decode(spark, sf_dir):
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.expr(_QUERY).alias("q")).select("i", *codec.decode_state(F.col("q")))
    return found.select("i", "selected", "conc", *(F.col(k).cast("string").alias(k) for k in codec.TOGGLES))


@query("state_encode", NATIONS + ", r AS (SELECT id, n, unnest(refs) AS ref FROM seg), g AS (SELECT id, n, ref, ref - row_number() OVER (PARTITION BY id ORDER BY ref) AS g FROM r), runs AS (SELECT id, n, min(ref) AS a, max(ref) AS b FROM g GROUP BY id, n, g), t AS (SELECT id, n, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, '%2C' ORDER BY a) AS x FROM runs GROUP BY id, n) SELECT id, 'routes=' || x || CASE WHEN n >= 4 THEN '&conc=all' ELSE '' END || CASE WHEN n % 2 = 0 THEN '&ferry=0' ELSE '' END AS query FROM t")
def state_encode(spark, sf_dir):
    on = F.lit(True)
    toggles = dict.fromkeys(codec.TOGGLES, on) | {"ferry": F.col("n") % 2 != 0}
    conc = F.when(F.col("n") >= 4, "all").otherwise("off")
    return segments(spark, sf_dir, "nation").select("id", codec.encode_state(F.col("refs"), conc, toggles).alias("query"))


_OURS = ", ".join(map(repr, codec.MANAGED))


@query("state_merge", f"SELECT c_custkey AS id, array_to_string(list_concat(list_filter(string_split(regexp_replace(q, '^[?]', ''), '&'), lambda x: x <> '' AND {_DECODED.format("split_part(x, '=', 1)")} NOT IN ({_OURS})), ['routes=' || c_custkey]), '&') AS query FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '?routes=1&region=x&conc=all' WHEN 1 THEN '' WHEN 2 THEN 'a=1&b&labels=0&%6Cabels=1' WHEN 3 THEN '&&x=%ZZ&%ZZ=1' ELSE 'seg=' || c_mktsegment || '&ferry' END AS q FROM customer)")
def state_merge(spark, sf_dir):
    kind = F.col("c_custkey") % 5
    q = F.when(kind == 0, "?routes=1&region=x&conc=all").when(kind == 1, "").when(kind == 2, "a=1&b&labels=0&%6Cabels=1").when(kind == 3, "&&x=%ZZ&%ZZ=1").otherwise(F.concat(F.lit("seg="), "c_mktsegment", F.lit("&ferry")))
    ours = F.concat(F.lit("routes="), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), codec.replace_managed(q, ours).alias("query"))


@query("state_overlay", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'all' END, 'off') AS conc FROM events")
def state_overlay(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", codec.overlay(F.when(F.col("event_id") % 3 == 0, "all"), F.lit("off")).alias("conc"))


# Scalars


@query("escape_text", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages")
def escape_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalar.escape(F.col("html")).alias("html"))


@query("format_stats", REGION_COMBOS + "SELECT array_to_string(refs, ',') AS refs, format('{:,}', round(km, 0)::BIGINT) AS km, format('{:,}', arcs) AS arcs, round(km, 1)::DECIMAL(28,1)::VARCHAR AS km1, round(km, 2)::DECIMAL(28,2)::VARCHAR AS km2 FROM combos")
def format_stats(spark, sf_dir):
    return sums(spark, sf_dir).select(joined("refs"), scalar.grouped(F.col("km")).alias("km"), scalar.grouped(F.col("arcs")).alias("arcs"), scalar.fixed(F.col("km"), 1).alias("km1"), scalar.fixed(F.col("km"), 2).alias("km2"))


@query("labels_text", "SELECT c_custkey AS id, CASE WHEN c > 0 THEN least(c, 25) || ' / ' || c || ' 組' ELSE '' END AS counted, CASE WHEN c > 0 THEN c || ' 路線を選択解除' ELSE '選択解除' END AS clear, coalesce(nullif(c, 0), 459)::BIGINT AS selected, CASE WHEN c > 1 THEN '×' || c END AS badge FROM (SELECT c_custkey, c_custkey % 40 AS c FROM customer)")
def labels_text(spark, sf_dir):
    c = F.col("c_custkey") % 40
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scalar.count_label(F.least(c, F.lit(25)), c).alias("counted"), scalar.clear_label(c).alias("clear"), scalar.selected_or_all(c, F.lit(459)).cast("long").alias("selected"), scalar.depth_badge(c).alias("badge"))


def _labels_case(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {column} END"


@query("describe", NATIONS + f"SELECT id, CASE WHEN name = '' THEN '—' ELSE name END AS name, {_labels_case('kind', scalar.KIND_LABELS)} AS kind, {_labels_case('src', scalar.SOURCE_LABELS)} AS src, km::VARCHAR || ' km' AS length, CASE WHEN n > 1 THEN n || ' 重用' ELSE '単独指定' END AS depth, CASE WHEN former THEN '旧道（指定解除前）' END AS remark, 'https://www.openstreetmap.org/way/' || id AS url, array_to_string(refs, '・') AS label, updated::VARCHAR AS updated FROM seg")
def describe(spark, sf_dir):
    segs = segments(spark, sf_dir, "nation")
    return segs.select(
        "id", scalar.or_dash(F.col("name")).alias("name"), scalar.label_of(F.col("kind"), scalar.KIND_LABELS).alias("kind"), scalar.label_of(F.col("src"), scalar.SOURCE_LABELS).alias("src"),
        F.concat(scalar.fixed(F.col("km"), 2), F.lit(" km")).alias("length"), scalar.depth_text(F.col("refs")).alias("depth"), F.when(F.col("former"), "旧道（指定解除前）").alias("remark"),
        scalar.way_url(F.col("id")).alias("url"), codec.label_refs(F.col("refs")).alias("label"), scalar.or_dash(F.col("updated")).alias("updated"),
    )


@query("freshness", "SELECT i, d::BIGINT AS days, CASE WHEN d <= 0 THEN '当日' WHEN d = 1 THEN '1 日前' ELSE d || ' 日前' END AS age, d > 7 AS stale, strftime(b, '%Y-%m-%d %H:%M') || 'Z' AS shown FROM (SELECT i, b, floor((epoch_ms(n) - epoch_ms(b)) / 86400000.0)::BIGINT AS d FROM (SELECT i, (SELECT max(ts) FROM events) AS b, (SELECT max(ts) FROM events) + to_hours(i * 12) AS n FROM range(0, 20) r(i)))")
def freshness(spark, sf_dir):
    base = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("b"))
    each = base.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("i"), "b")
    days = scalar.age_days(F.col("b") + F.make_dt_interval(F.lit(0), (F.col("i") * 12).cast("int")), F.col("b"))
    return each.select("i", days.cast("long").alias("days"), scalar.age_text(days).alias("age"), scalar.is_stale(days).alias("stale"), scalar.utc_minute(F.col("b")).alias("shown"))


def _depth_case(values: list) -> str:
    return "CASE n WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} ELSE {} END".format(*(repr(v) for v in values))


@query("depth_style", NATIONS + f"SELECT id, n::VARCHAR AS n, {_depth_case(scalar.DEPTH_COLORS)} AS color, {_depth_case(scalar.DEPTH_LABELS)} AS label, ({_depth_case(scalar.DEPTH_WIDTHS)})::DOUBLE AS width FROM (SELECT id, CASE WHEN id % 11 <> 0 THEN n - (id % 3)::INTEGER END AS n FROM seg)")
def depth_style(spark, sf_dir):
    """Each segment's style by depth; depths of 0 and below, and null ones, too."""
    depth = F.when(F.col("id") % 11 != 0, F.col("n") - (F.col("id") % 3).cast("int"))
    n = F.col("n")
    given = segments(spark, sf_dir, "nation").select("id", depth.alias("n"))
    return given.select("id", n.cast("string").alias("n"), scalar.by_depth(n, scalar.DEPTH_COLORS).alias("color"), scalar.by_depth(n, scalar.DEPTH_LABELS).alias("label"), scalar.by_depth(n, scalar.DEPTH_WIDTHS).alias("width"))


def _steps(z: str, *stops: tuple[float, float]) -> str:
    """Linear between stops, for DuckDB."""
    out = f"CASE WHEN {z} <= {stops[0][0]} THEN {stops[0][1]}::DOUBLE"
    for (a, u), (b, v) in zip(stops, stops[1:], strict=False):
        out += f" WHEN {z} <= {b} THEN {u} + ({v} - {u}) * (({z} - {a}) / {b - a}::DOUBLE)"
    return out + f" ELSE {stops[-1][1]} END"


#: A zoom from 4 to 17 for each segment, in halves.
_ZOOM = "(4 + id % 27 / 2.0)::DOUBLE"
_WIDTHS = ((6, 0.9), (9, 1.8), (12, 3.2), (15, 6.0))


def _zoomed(spark, sf_dir):
    return segments(spark, sf_dir, "nation").select("id", "n", (F.lit(4.0) + (F.col("id") % 27) / 2.0).alias("z"))


@query("line_width", NATIONS + f"SELECT id, z, n, round({_steps('z', *_WIDTHS)} * m, 6) AS width FROM (SELECT id, {_ZOOM} AS z, n, (CASE n WHEN 1 THEN 1 WHEN 2 THEN 1.5 WHEN 3 THEN 2 ELSE 2.4 END)::DOUBLE AS m FROM seg)")
def line_width(spark, sf_dir):
    return _zoomed(spark, sf_dir).select("id", "z", "n", F.round(scalar.line_width(F.col("z"), F.col("n")), 6).alias("width"))


@query("line_width_variants", NATIONS + f"SELECT id, z, round({_steps('z', *_WIDTHS)}, 6) AS unscaled, round(2 + {_steps('z', *_WIDTHS)}, 6) AS casing FROM (SELECT id, {_ZOOM} AS z FROM seg)")
def line_width_variants(spark, sf_dir):
    plain, wider = scalar.line_width(F.col("z"), F.lit(4), scale=False), scalar.line_width(F.col("z"), F.lit(1), add=2.0)
    return _zoomed(spark, sf_dir).select("id", "z", F.round(plain, 6).alias("unscaled"), F.round(wider, 6).alias("casing"))


@query("text_styles", NATIONS + f"SELECT id, z, round({_steps('z', (8, 12), (13, 16))}, 6) AS size, round(CASE WHEN shared = 1 THEN {_steps('z', (7, 5), (13, 9))} ELSE {_steps('z', (7, 3), (13, 5))} END, 6) AS radius FROM (SELECT id, {_ZOOM} AS z, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS shared FROM seg)")
def text_styles(spark, sf_dir):
    shared = (F.col("n") >= 2).cast("int")
    return _zoomed(spark, sf_dir).select("id", "z", F.round(scalar.text_size(F.col("z")), 6).alias("size"), F.round(scalar.end_radius(F.col("z"), shared), 6).alias("radius"))


@query("minzoom", NATIONS + "SELECT id, layer, z >= CASE layer WHEN 'route-labels' THEN 8 WHEN 'termini-label' THEN 9 ELSE 0 END AS shown FROM (SELECT id, " + _ZOOM + " AS z FROM seg), (VALUES ('roads'), ('route-labels'), ('termini-label')) b(layer)")
def minzoom(spark, sf_dir):
    """Which layers show each segment at its zoom."""
    each = F.array(*(F.struct(F.lit(layer).alias("layer"), (F.col("z") >= filters.MINZOOM.get(layer, 0)).alias("shown")) for layer in ("roads", "route-labels", "termini-label")))
    return _zoomed(spark, sf_dir).select("id", F.explode(each).alias("v")).select("id", "v.*")


@query("sign_width", "SELECT p_partkey AS ref, CASE WHEN length(p_partkey::VARCHAR) >= 3 THEN 332 WHEN length(p_partkey::VARCHAR) = 2 THEN 247 ELSE 115 END::INTEGER AS width FROM part")
def sign_width(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), scalar.sign_width(F.col("p_partkey")).alias("width"))


@query("link_extract", "SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def link_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), " ").alias("links"))


@query("code_points", "SELECT c, lpad(lower(printf('%x', unicode(c))), 4, '0') AS hex FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''")
def code_points(spark, sf_dir):
    signs = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").distinct()
    return signs.select("c", scalar.code_point_hex(F.col("c")).alias("hex"))
