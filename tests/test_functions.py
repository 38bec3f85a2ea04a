"""Codecs and scalars on fixed examples."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayset.functions import codec, scalar


def one(spark, column, schema="x int", row=(0,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("refs", "text"), [([1, 2, 3, 5, 7, 8, 9], "1-3,5,7-9"), ([246], "246"), ([9, 1, 2], "1-2,9"), ([], ""), ([4, 4, 5], "4-5")])
def test_encode(spark, refs, text):
    assert one(spark, codec.encode_array(F.col("x")), "x array<int>", (refs,)) == text


@pytest.mark.parametrize(("text", "refs"), [("1-3,5,7-9", [1, 2, 3, 5, 7, 8, 9]), ("1-3,abc,,9-8,18", [1, 2, 3, 18]), ("1-3\n", []), ("1, 2", [1]), ("1-3,2", [1, 2, 3, 2]), (None, [])])
def test_decode(spark, text, refs):
    assert one(spark, codec.decode_ranges(F.col("x")), "x string", (text,)) == refs


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 600), max_size=30), min_size=1, max_size=20))
def test_round_trip(spark, many):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(many)], "i int, r array<int>")
    found = {r["i"]: r["v"] for r in rows.select("i", codec.decode_ranges(codec.encode_array(F.col("r"))).alias("v")).collect()}
    assert all(found[i] == sorted(set(r)) for i, r in enumerate(many))


def test_encode_rows_agrees_with_arrays(spark):
    rows = spark.createDataFrame([(k, r) for k in range(3) for r in (1, 2, 2, 5 + k, 7)], "k int, ref int")
    found = {r["k"]: r["ranges"] for r in codec.encode_ranges(rows, "k").collect()}
    assert found == {0: "1-2,5,7", 1: "1-2,6-7", 2: "1-2,7"}


@pytest.mark.parametrize(("text", "refs"), [(",7,8,17,", [7, 8, 17]), (",18,", [18]), ("", []), (None, []), (",x,", [None])])
def test_refs(spark, text, refs):
    assert one(spark, codec.parse_refs(F.col("x")), "x string", (text,)) == refs


def test_wrap_and_label(spark):
    assert one(spark, codec.wrap_refs(F.col("x")), "x array<int>", ([7, 8, 17],)) == ",7,8,17,"
    assert one(spark, codec.label_refs(F.col("x")), "x array<int>", ([7, 8, 17],)) == "7・8・17"


@pytest.mark.parametrize(("query", "key", "value"), [("labels", "labels", ""), ("labels=0&labels=1", "labels", "0"), ("a=b=c", "a", "b=c"), ("", "a", None), ("?x=1%2C2", "x", "1,2"), (None, "a", None)])
def test_query_value(spark, query, key, value):
    assert one(spark, codec.query_value(F.col("x"), key), "x string", (query,)) == value


def test_state_round_trip(spark):
    rows = spark.createDataFrame([([18, 117], "all", False), ([], "off", True)], "s array<int>, c string, f boolean")
    toggles = dict.fromkeys(codec.TOGGLES, F.lit(True)) | {"ferry": F.col("f")}
    text = rows.select(codec.encode_state(F.col("s"), F.col("c"), toggles).alias("q"))
    assert [r["q"] for r in text.collect()] == ["routes=18%2C117&conc=all&ferry=0", ""]
    found = text.select(*codec.decode_state(F.col("q"))).collect()
    assert [(r["selected"], r["conc"], r["ferry"], r["labels"]) for r in found] == [("18,117", "all", False, None), (None, None, None, None)]


@pytest.mark.parametrize(("text", "expected"), [("<a href=\"x\">&'</a>", "&lt;a href=&quot;x&quot;&gt;&amp;&#39;&lt;/a&gt;"), ("&lt;", "&amp;lt;"), (None, ""), ("国道", "国道")])
def test_escape(spark, text, expected):
    assert one(spark, scalar.escape(F.col("x")), "x string", (text,)) == expected


@pytest.mark.parametrize(("value", "digits", "text"), [("0.1276", 2, "0.13"), ("1.204", 2, "1.20"), ("0.125", 2, "0.13"), ("2.5", 0, "3")])
def test_fixed(spark, value, digits, text):
    assert one(spark, scalar.fixed(F.lit(value).cast("decimal(18,6)"), digits)) == text


def test_texts(spark):
    lit = F.lit
    assert one(spark, scalar.grouped(lit("70290.47").cast("decimal(18,2)"))) == "70,290"
    assert one(spark, scalar.grouped(lit("2.5").cast("decimal(18,2)"))) == "3"
    assert one(spark, scalar.count_label(lit(25), lit(1237))) == "25 / 1237 組"
    assert one(spark, scalar.count_label(lit(0), lit(0))) == ""
    assert one(spark, scalar.clear_label(lit(0))) == "選択解除"
    assert one(spark, scalar.selected_or_all(lit(0), lit(459))) == 459
    assert one(spark, scalar.depth_badge(lit(1))) is None
    assert one(spark, scalar.or_dash(lit(""))) == "—"
    assert one(spark, scalar.label_of(lit("newkind"), scalar.KIND_LABELS)) == "newkind"
    assert one(spark, scalar.code_point_hex(lit("・"))) == "30fb"
    assert one(spark, scalar.names_text(F.array().cast("array<string>"))) is None


NOW = datetime.datetime(2026, 8, 16, 20, 21, 6)


@pytest.mark.parametrize(("later", "age", "stale"), [((16, 23, 0, 0), "当日", False), ((18, 0, 0, 0), "1 日前", False), ((21, 0, 0, 0), "4 日前", False), ((23, 20, 21, 6), "7 日前", False), ((25, 0, 0, 0), "8 日前", True)])
def test_freshness(spark, later, age, stale):
    day, *clock = later
    now = f"2026-08-{day:02d} {clock[0]:02d}:{clock[1]:02d}:{clock[2]:02d}"
    days = scalar.age_days(F.to_timestamp(F.lit(now)), F.to_timestamp(F.lit("2026-08-16 20:21:06")))
    assert one(spark, scalar.age_text(days)) == age
    assert one(spark, scalar.is_stale(days)) is stale
    assert one(spark, scalar.utc_minute(F.to_timestamp(F.lit("2026-08-16 20:21:06")))) == "2026-08-16 20:21Z"


def test_bare_tasks(spark):
    text = '[tasks.a]\nrun = """\none\ntwo\n"""\n[tasks.b]\nshell = "bash"\nrun = """\none\ntwo\n"""\n[tasks.c]\nrun = """\none\n"""\n[other]\nrun = """\none\ntwo\n"""\n'
    assert one(spark, scalar.bare_tasks(F.col("x")), "x string", (text,)) == ["a"]


def test_sign_widths(spark):
    assert [one(spark, scalar.sign_width(F.lit(n))) for n in (4, 18, 117, 2459)] == [115, 247, 332, 332]


@pytest.mark.parametrize(("text", "merged"), [("routes=1-999999999,5", "1-999999999"), ("x=1&%ZZ=3&routes=5", "5"), ("routes=%E0%A4%A,7", "7"), ("routes=123456789012", "123456789012"), ("routes=9-2,4-6,1-3,11", "1-6,11"), ("routes=99999999999999999999", None)])
def test_state_of_any_text(spark, text, merged):
    rows = spark.createDataFrame([(text,)], "q string")
    assert rows.select(*codec.decode_state(F.col("q"))).first()["selected"] == merged


def test_known_numbers_in_ranges_of_any_width(spark):
    known = [*range(0, 200, 3), 2**31 - 1]
    ranges = [(0, "0-7,5,9-3"), (1, "190-99999999999"), (2, "66-66"), (3, None), (4, "1-2147483647")]
    found = codec.decode_known(spark.createDataFrame(ranges, "i int, t string"), "t", spark.createDataFrame([(k,) for k in known], "ref int"))
    bounds = {0: [(0, 7), (5, 5)], 1: [(190, 2**40)], 2: [(66, 66)], 3: [], 4: [(1, 2**31)]}
    assert sorted((r["i"], r["ref"]) for r in found.collect()) == sorted((i, k) for i, many in bounds.items() for k in known if any(a <= k <= b for a, b in many))


def test_numbers_there_and_back(spark):
    rows = spark.createDataFrame([(138.5, 36, "a,1,,2.5"), (None, -1, None)], "x double, y int, t string")
    found = rows.select(scalar.numbers_text(F.col("x"), F.col("y")).alias("s"), scalar.parse_numbers(F.col("t")).alias("v")).collect()
    assert [(r["s"], r["v"]) for r in found] == [("138.5,36", [None, 1.0, 2.5]), ("-1", [])]
