"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from wayset.llm import prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, n long, seq string, path string, prefix string"


def by_definition(convs):
    """conv_id -> list of (role, text), each prefix with its members, from the definition."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        sub, todo = [], [p]
        while todo:
            sub.append(todo.pop())
            todo += children[sub[-1]]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuild(convs):
    def one(c):
        h = zlib.crc32(str(c).encode()) % 6
        return convs.get(c - c % 100, [])[:h] + convs[c][h:]

    return {c: one(c) for c in convs}


def made(seed, n=120):
    r = random.Random(seed)
    return {c: [(r.choice("us"), r.choice(["a", "bb", "ccc"])) for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9]))] for c in r.sample(range(1000), n)}


def table(spark, convs):
    rows = [(c, t, role, text, 1, "s", "p", "x") for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [10_000, 7, 1])
def test_slices_of_any_size_give_the_same_trie(spark, most):
    for seed in range(2):
        convs = {c: t for c, t in made(seed).items() if t}
        assert rows(op.prefix_trie(op.paths(table(spark, convs)), most)) == by_definition(convs)


@pytest.mark.parametrize("most", [10_000, 3])
def test_rebuilt_conversations(spark, most):
    convs = {c: t for c, t in made(7, 300).items() if t} | {k: [("u", f"turn {i}") for i in range(60)] for k in (100, 101, 102)}
    assert rows(op.prefix_trie(op.rebuilt(op.paths(table(spark, convs))), most)) == by_definition(rebuild(convs))


def test_one_conversation_many_times(spark):
    convs = {c: [("u", "same"), ("s", "answer")] for c in range(500)} | {c: [("u", "same")] for c in range(500, 600)}
    assert rows(op.prefix_trie(op.paths(table(spark, convs)))) == by_definition(convs)


def test_nulls_order_and_empty_tables(spark):
    given = [(1, None, None, None), (1, 0, "u", "x"), (2, 0, "u", "x"), (2, None, "", ""), (None, 0, "u", "lost"), (3, 5, "u", "x"), (3, -1, "", "")]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    same = [("", ""), ("u", "x")]
    assert rows(op.prefix_trie(op.paths(df))) == by_definition({1: same, 2: same, 3: same})
    assert rows(op.prefix_trie(op.rebuilt(op.paths(df.where("false"))))) == []
    parts = spark.createDataFrame([(1, 0, "ab", "c"), (2, 0, "a", "bc")], df.schema)  # where role and text meet is told
    assert [r[4] for r in rows(op.prefix_trie(op.paths(parts))) if r[1] == 0] == [2]


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    path = f"{sf_dir}/conversations.parquet"
    convs = defaultdict(list)
    for c, _, role, text in sorted(duckdb.sql(f"SELECT conv_id, turn, coalesce(role, ''), coalesce(text, '') FROM '{path}'").fetchall()):
        convs[c].append((role, text))
    found = op.op13_prefix_trie(spark, sf_dir)
    assert rows(found) == by_definition(rebuild(convs))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{path}'")
    assert sorted(duckdb.sql(f"SELECT {', '.join(found.columns)} FROM ({op.oracle()})").fetchall(), key=repr) == rows(found)
