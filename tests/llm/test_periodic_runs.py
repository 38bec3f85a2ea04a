"""Periodic runs against a search from the definition, word by word."""

import hashlib
import random
import zlib

import duckdb
import pytest

from wayset.llm import periodic_runs as op


def smallest_period(x):
    return next(q for q in range(1, len(x) + 1) if x[q:] == x[: len(x) - q])


def by_definition(words):
    """Every maximal stretch of each period, kept if that is its smallest period."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and smallest_period(words[i : j + q]) == q:
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(seed):
    r = random.Random(seed)
    words = []
    while len(words) < 400:
        piece = [r.choice("abc") for _ in range(r.randint(1, 20))]
        words += piece * r.choice([1, 1, 2, 3, 5, 9])
    return words


CASES = [made(s) for s in range(30)] + [["a"] * 24, ["a"] * 23, ["a", "b"] * 12, ["x"] + ["a", "b", "c"] * 9 + ["a"], list("abcdefgh") * 3, list("abcdefghi") * 3, (["a"] * 30 + ["b"]) * 4, []]


def test_scan_equals_the_definition():
    for words in CASES:
        text = " ".join(words).encode()
        ids, counts, split = op.word_ids([text])
        assert [w.decode() for w in split[0]] == words
        found = sorted(((a, b - a, lag) for (_, a, b), lag in op.scan(ids, counts).items()), key=lambda r: (r[0], r[2]))
        assert found == by_definition(words)
        assert op.collapsed(split[0], found).decode() == collapse(words, found)


def test_lag_ranges_add_up():
    words = made(5) + ["q", "r"] * 40
    ids, counts, _ = op.word_ids([" ".join(words).encode()])
    parts = {}
    for low in range(1, len(words), 7):
        for k, lag in op.scan(ids, counts, low, low + 7).items():
            parts[k] = min(lag, parts.get(k, lag))
    assert parts == op.scan(ids, counts)


@pytest.mark.parametrize("limits", [(), (200, 5_000)])
def test_operator_equals_the_definition(spark, limits):
    """The same whether a document's lags are one range or are dealt out in many."""
    texts = [(k, " \n".join(w)) for k, w in enumerate(CASES)] + [(500, None), (501, "  \t\n"), (0, " ".join(CASES[3]))]
    found = op.periodic_runs(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), *limits).collect()
    assert len(found) == len(texts)
    expected = {}
    for k, t in texts:
        words = (t or "").split()
        runs = by_definition(words)
        expected.setdefault(k, []).append((len(words), runs, collapse(words, runs)))
    for r in found:
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) in expected[r.doc_id]


def test_odd_rows(odd, none):
    found = op.digest(op.periodic_runs(op.rewritten(odd))).collect()
    assert len(found) == odd.count()
    assert len({tuple(r) for r in found if r.doc_id == 12}) == 1
    assert [r.n_runs for r in found if r.doc_id == 4] == [0]
    assert op.digest(op.periodic_runs(op.rewritten(none))).collect() == []


def rewrite(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    words, g = (text or "").split(), h // 10
    if h % 10 == 0 and words:
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    found = {r.doc_id: r for r in op.op12_periodic_runs(spark, sf_dir).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        words = rewrite(doc_id, text)
        runs, r = by_definition(words), found[doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    columns = sorted(next(iter(found.values())).__fields__)
    expected = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({op.oracle()})").fetchall()
    assert sorted(expected) == sorted(tuple(r[c] for c in columns) for r in found.values())
