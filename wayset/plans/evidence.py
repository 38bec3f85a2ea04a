"""Queries over chains, evidence and other sources, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, evidence
from ..sources.segments import table
from ..sources.store import once
from .registry import query

# Chains

_EDGES = "edges AS (SELECT o_orderstatus AS ref, o_orderkey AS a, o_orderkey::DOUBLE AS ax, o_orderkey + o_custkey % 3 AS b, (o_orderkey + o_custkey % 3)::DOUBLE AS bx, o_totalprice::DECIMAL(18, 2) AS km FROM orders)"
_PIECES = f"""WITH RECURSIVE {_EDGES},
both_ways AS (SELECT ref, a AS u, b AS v FROM edges UNION SELECT ref, b, a FROM edges),
reach AS (SELECT ref, u AS node, u AS label FROM both_ways UNION SELECT r.ref, x.v, r.label FROM reach r JOIN both_ways x ON x.ref = r.ref AND x.u = r.node),
label AS (SELECT ref, node, min(label) AS piece FROM reach GROUP BY 1, 2),
each AS (SELECT ref, a AS node, ax AS x, km FROM edges UNION ALL SELECT ref, b, bx, km FROM edges),
met AS (SELECT ref, node, count(*) AS degree, min(x) AS x, sum(km) AS km FROM each GROUP BY 1, 2),
pieces AS (SELECT ref, piece, count(*)::BIGINT AS nodes, (sum(degree) // 2)::BIGINT AS edges, (sum(km) / 2)::DECIMAL(18, 2) AS km, count(*) FILTER (degree = 1)::BIGINT AS ends, count(*) FILTER (degree > 2)::BIGINT AS junctions, min(x) AS lo, max(x) AS hi FROM met JOIN label USING (ref, node) GROUP BY 1, 2),
gaps AS (SELECT ref, piece, lag(piece) OVER w AS after, greatest(lo - lag(hi) OVER w, 0) AS gap FROM pieces WINDOW w AS (PARTITION BY ref ORDER BY lo, piece) QUALIFY after IS NOT NULL)
"""


def edges(spark, sf_dir):
    """Orders as edges between their own number and one up to two beyond it."""
    key = F.col("o_orderkey")
    other = key + F.col("o_custkey") % 3
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("ref"), key.alias("a"), key.cast("double").alias("ax"), other.alias("b"), other.cast("double").alias("bx"), F.col("o_totalprice").cast("decimal(18,2)").alias("km"))


def _pieces(spark, sf_dir):
    """The orders' pieces, computed once: three queries answer from them."""
    return spark.read.parquet(once(spark, "pieces", [f"{sf_dir}/orders.parquet"], lambda path: chains.pieces(edges(spark, sf_dir)).write.mode("overwrite").parquet(path)))


@query("chain_pieces", _PIECES + "SELECT ref, piece, nodes, edges, km::DOUBLE AS km, ends, junctions, CASE WHEN junctions > 0 THEN 'branched' WHEN ends = 0 THEN 'ring' ELSE 'chain' END AS kind, lo, hi FROM pieces")
def chain_pieces(spark, sf_dir):
    return _pieces(spark, sf_dir).withColumn("km", F.col("km").cast("double"))


@query("chain_gaps", _PIECES + "SELECT ref, piece, after, gap FROM gaps")
def chain_gaps(spark, sf_dir):
    return chains.gaps(_pieces(spark, sf_dir))


@query("chain_audit", _PIECES + ", whole AS (SELECT ref, count(*)::BIGINT AS pieces, sum(ends)::BIGINT AS open_ends, count(*) FILTER (junctions = 0 AND ends = 0)::BIGINT AS rings, sum(km) AS km, sum(km) - max(km) AS stray_km FROM pieces GROUP BY 1), wide AS (SELECT ref, count(*) FILTER (gap > 0)::BIGINT AS gaps, max(gap) AS widest FROM gaps GROUP BY 1) SELECT row_number() OVER (ORDER BY pieces DESC, stray_km DESC, coalesce(widest, 0) DESC, ref) AS place, ref, pieces, open_ends, rings, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(widest, 0)::DOUBLE AS widest, km::DOUBLE AS km, stray_km::DOUBLE AS stray_km FROM whole LEFT JOIN wide USING (ref)")
def chain_audit(spark, sf_dir):
    """Which designations look broken, the most suspicious first."""
    found = chains.audit(_pieces(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("double") for c in ("km", "stray_km")})


# Evidence: the sources of a designation, corroborated region by region

_LEAST = 40
_CLAIMS = "claims AS (SELECT c_custkey AS id, c_nationkey % 5 AS region, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS relation, CASE WHEN c_custkey % 3 <> 0 THEN (c_nationkey + c_custkey % 5) % 25 END AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 11 END AS tag FROM customer)"
#: Rounds that the SQL is unrolled to; further rounds change nothing once nothing is rejected.
_ROUNDS = 12


def _fall_sql() -> str:
    """Every round rejects what too few of its region claim by now, and falls through to the next source."""
    first = "CASE WHEN relation IS NOT NULL THEN 0 WHEN name IS NOT NULL THEN 1 WHEN tag IS NOT NULL THEN 2 ELSE 3 END"
    after = "CASE WHEN {k} < 1 AND name IS NOT NULL THEN 1 WHEN {k} < 2 AND tag IS NOT NULL THEN 2 ELSE 3 END"
    value = "CASE level WHEN 0 THEN relation WHEN 1 THEN name WHEN 2 THEN tag END"
    parts = [f"WITH {_CLAIMS}", f"r0 AS (SELECT *, {first} AS level FROM claims)"]
    for k in range(_ROUNDS):
        parts.append(f"j{k} AS (SELECT *, {value} AS ref, count(*) OVER (PARTITION BY region, {value}) AS support FROM r{k})")
        parts.append(f"r{k + 1} AS (SELECT id, region, relation, name, tag, CASE WHEN level < 3 AND support < {_LEAST} THEN {after.format(k='level')} ELSE level END AS level FROM j{k})")
    rejected = " UNION ALL ".join(f"SELECT id, region, ref, level FROM j{k} WHERE level < 3 AND support < {_LEAST}" for k in range(_ROUNDS))
    return ", ".join(parts) + f", final AS (SELECT id, region, {value} AS ref, level FROM r{_ROUNDS}), rejected AS ({rejected}) "


_SOURCE = "CASE level WHEN 0 THEN 'relation' WHEN 1 THEN 'name' WHEN 2 THEN 'tag' END"


def claims(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), (nation % 5).alias("region"), F.when(key % 2 == 0, nation).alias("relation"),
        F.when(key % 3 != 0, (nation + key % 5) % 25).alias("name"), F.when(key % 7 != 0, key % 11).alias("tag"),
    )


def _judged(spark, sf_dir):
    """Judgements and the ledger of rejections, computed once."""
    inputs = [f"{sf_dir}/customer.parquet"]

    def write(path: str) -> None:
        judged, ledger = evidence.fall_through(claims(spark, sf_dir), _LEAST)
        judged.write.mode("overwrite").parquet(f"{path}/judged")
        ledger.write.mode("overwrite").parquet(f"{path}/ledger")

    path = once(spark, "judged", inputs, write)
    return spark.read.parquet(f"{path}/judged"), spark.read.parquet(f"{path}/ledger")


@query("judged_designations", _fall_sql() + f"SELECT id, region, ref::BIGINT AS ref, {_SOURCE} AS src FROM final")
def judged_designations(spark, sf_dir):
    return _judged(spark, sf_dir)[0].withColumn("ref", F.col("ref").cast("long"))


@query("rejected_designations", _fall_sql() + f"SELECT id, region, ref::BIGINT AS ref, {_SOURCE} AS src FROM rejected")
def rejected_designations(spark, sf_dir):
    return _judged(spark, sf_dir)[1].select("id", "region", F.col("ref").cast("long").alias("ref"), "src")


@query("rejection_counts", _fall_sql() + f", fell AS (SELECT r.*, f.level AS to_level FROM rejected r JOIN final f USING (id)) SELECT {_SOURCE} AS src, CASE to_level WHEN 1 THEN 'name' WHEN 2 THEN 'tag' ELSE 'none' END AS now, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS ids FROM fell GROUP BY ALL")
def rejection_counts(spark, sf_dir):
    """Rejected numbers by the source that they came from and the one that stands now."""
    return evidence.rejections(*_judged(spark, sf_dir))


@query("guarantee_sets", _fall_sql() + "SELECT region, count(DISTINCT ref)::BIGINT AS refs FROM final WHERE level < 3 GROUP BY 1")
def guarantee_sets(spark, sf_dir):
    """How many designations each region vouches for."""
    return evidence.guaranteed(_judged(spark, sf_dir)[0]).groupBy("region").agg(F.count("*").alias("refs"))


# Another source without a common key

_TOLERANCE = (40.0, 3.0)
_HERE = "here AS (SELECT s_suppkey AS id, s_acctbal::DOUBLE AS x, (s_suppkey % 50)::DOUBLE AS y FROM supplier)"
_THERE = "there AS (SELECT c_custkey AS id, c_acctbal::DOUBLE AS x, (c_custkey % 50)::DOUBLE AS y FROM customer WHERE c_custkey % 3 = 0)"
_MATCH_ROUNDS = 12


def _match_sql() -> str:
    tx, ty = _TOLERANCE
    parts = [f"WITH {_HERE}, {_THERE}", f"p0 AS (SELECT h.id AS a, t.id AS b, h.x AS ax, h.y AS ay, t.x AS bx, t.y AS by_, greatest(abs(h.x - t.x) / {tx}, abs(h.y - t.y) / {ty}) AS d FROM here h JOIN there t ON abs(h.x - t.x) <= {tx} AND abs(h.y - t.y) <= {ty})"]
    for k in range(_MATCH_ROUNDS):
        parts.append(f"b{k} AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, bx, by_, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, ax, ay, a) AS rb FROM p{k})")
        parts.append(f"m{k} AS (SELECT a, b, d FROM b{k} WHERE ra = 1 AND rb = 1)")
        parts.append(f"p{k + 1} AS (SELECT * FROM p{k} WHERE a NOT IN (SELECT a FROM m{k}) AND b NOT IN (SELECT b FROM m{k}))")
    return ", ".join(parts) + ", matched AS (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(_MATCH_ROUNDS)) + ") "


def here_and_there(spark, sf_dir):
    here = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("x"), (F.col("s_suppkey") % 50).cast("double").alias("y"))
    there = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("x"), (F.col("c_custkey") % 50).cast("double").alias("y"))
    return here, there


@query("compare_sources", _match_sql() + "SELECT 'matched' AS state, a AS here, b AS there, round(d, 9) AS distance FROM matched UNION ALL SELECT 'only here', id, NULL, NULL FROM here WHERE id NOT IN (SELECT a FROM matched) UNION ALL SELECT 'only there', NULL, id, NULL FROM there WHERE id NOT IN (SELECT b FROM matched)")
def compare_sources(spark, sf_dir):
    """Suppliers and customers matched by two measures alone, one to one, and what neither has."""
    found = evidence.compared(*here_and_there(spark, sf_dir), *_TOLERANCE)
    return found.withColumn("distance", F.round("distance", 9))
