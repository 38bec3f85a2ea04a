import hashlib
import math

import duckdb
import pytest

from wayset.llm import mixing as op


def water(sizes, weights, cap):
    """Share again and again what capped sources leave."""
    total, open_, targets = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while True:
        left = total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > cap * sizes[i]}
        if not over:
            for i in range(len(sizes)):
                targets[i] = left * weights[i] / weight if i in open_ else cap * sizes[i]
            return targets
        open_ -= over


@pytest.mark.parametrize("sizes", [[100, 1000, 1000, 10, 5], [1, 1, 1], [0, 50, 3000], [7]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    found = {r["source"]: r["target"] for r in op.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    expected = water(sizes, [op.WEIGHTS[i % 3] for i in range(len(sizes))], op.CAP)
    assert [found[f"s{i}"] for i in range(len(sizes))] == pytest.approx(expected)


def test_null_source_is_last_and_sizes_may_be_zero(spark):
    rows = spark.createDataFrame([(None, 10), ("", 10), ("z", 10), ("B", 0)], "source string, size long")
    found = {r["source"]: r["weight"] for r in op.source_targets(rows).collect()}
    assert found == {"": 5, "B": 2, "z": 1, None: 5}
    zero = spark.createDataFrame([("a", 0), ("b", 0)], "source string, size long")
    assert {r["target"] for r in op.source_targets(zero).collect()} == {0.0}


def test_mix_is_near_its_targets_and_stable(docs):
    first, again = (sorted(map(tuple, op.mix_ledger(docs.repartition(n)).collect())) for n in (2, 5))
    assert first == again
    assert all(r[7] <= 3 * r[2] for r in first)
    for source in {r[1] for r in first}:
        mine = [r for r in first if r[1] == source]
        assert abs(sum(r[7] for r in mine) - mine[0][4]) < max(0.1 * mine[0][4], max(r[2] for r in mine))


def test_documents_come_as_often_as_the_ledger_says(odd):
    ledger = {}
    for r in op.mix_ledger(odd).collect():
        ledger[r["doc_id"], r["source"]] = ledger.get((r["doc_id"], r["source"]), 0) + r["copies"]
    mixed = op.mixed_documents(odd)
    assert mixed.columns == odd.columns
    found = {}
    for r in mixed.collect():
        found[r["doc_id"], r["source"]] = found.get((r["doc_id"], r["source"]), 0) + 1
    assert found == {k: n for k, n in ledger.items() if n}


def test_odd_documents(odd, none):
    rows = op.mix_ledger(odd).collect()
    assert len(rows) == odd.count()
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert sizes[4] == sizes[5] == sizes[6] == 0 and sizes[8] == 2
    assert op.mix_ledger(none).count() == 0 == op.mixed_documents(none).count()


def test_sql_agrees(odd):
    table = odd.select("doc_id", "text", "source").toArrow()
    duckdb.register("given", table)
    expected = duckdb.sql(op.oracle("given")).fetchall()
    columns = ["doc_id", "size", "source_size", "target", "taken", "source", "copies"]
    found = [tuple(r) for r in op.mix_ledger(odd).select(*columns).collect()]
    clean = lambda rows: sorted(str(tuple(None if v != v else int(v) if isinstance(v, float) and i != 3 else v for i, v in enumerate(r))) for r in rows)
    assert clean(found) == clean(expected)


def plain_copies(docs, rates, seed):
    """Copies of (doc_id, text, source) rows by the rule in words: counts per stratum, least draws first."""
    number = lambda *parts: int(hashlib.md5(":".join(["mix", *parts]).encode()).hexdigest()[:15], 16)
    out = {}
    for source, rate in rates.items():
        start, upto, strata = number(f"{seed}-start", "s" + source) / 2**60, 0, {}
        for d, text, s in docs:
            if s == source:
                strata.setdefault(math.floor(math.log(len(text) + 1) * 4), []).append(d)
        for _, ids in sorted(strata.items()):
            many = math.floor(rate % 1 * (upto + len(ids)) + start) - math.floor(rate % 1 * upto + start)
            upto += len(ids)
            for k, d in enumerate(sorted(ids, key=lambda d: number(seed, str(d)))):
                out[d] = int(rate) + (k < many)
    return out


def test_copies_come_as_often_as_the_fraction(spark):
    """Over many seeds each document gets its extra copy with the probability that the method asks for."""
    docs = [(i, "w " * (1 + i % 7 * 20), f"s{i % 3}") for i in range(60)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string").cache()
    for seed in ("0", "7"):
        found = op.mix_ledger(rows, seed=seed).collect()
        rates = {r["source"]: r["rate"] for r in found}
        assert {r["doc_id"]: r["copies"] for r in found} == plain_copies(docs, rates, seed)
    many = 3000
    extra = dict.fromkeys(range(60), 0)
    for seed in range(many):
        for d, copies in plain_copies(docs, rates, str(seed)).items():
            extra[d] += copies - int(rates[docs[d][2]])
    for d, n in extra.items():
        part = rates[docs[d][2]] % 1
        assert abs(n / many - part) < 4 * (part * (1 - part) / many) ** 0.5


def test_columns_with_any_names(spark):
    rows = spark.createDataFrame([(1, "a b", "x", 7, 8, 9, 10, 11), (2, "c", "y", 7, 8, 9, 10, 11)], "doc_id long, text string, source string, key int, stratum int, draw int, `__copies` int, `row.x` int")
    found = op.mixed_documents(rows)
    assert found.columns == rows.columns
    assert {tuple(r)[3:] for r in found.collect()} <= {(7, 8, 9, 10, 11)}
