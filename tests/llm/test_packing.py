import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from wayset.llm import packing as op
from wayset.llm._tokens import default_tokenizer


def test_combinations_fill_the_window():
    found = op.combinations(12)
    assert len(found) == len(set(found)) and all(sum(p) == 12 and list(p) == sorted(p, reverse=True) for p in found)
    brute = {(12,)} | {(a, 12 - a) for a in range(6, 12)} | {(a, b, 12 - a - b) for a in range(1, 12) for b in range(1, a + 1) if 1 <= 12 - a - b <= b}
    assert set(found) == brute


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((8, 15)), rng.standard_normal(8)
        x = op.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope * x).max() < 1e-6


@pytest.mark.parametrize("seed", range(5))
def test_every_piece_gets_its_own_place(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 33, 12), rng.integers(1, 400, 12), strict=True)}
    patterns = op.plan_patterns(histogram, 32)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 32 and n > 0
        used.update({c: m * n for c, m in Counter(p).items()})
    assert used == Counter(histogram)
    table, seen = op.places(patterns), defaultdict(set)
    for c, n in histogram.items():
        for r in range(n):
            k = np.searchsorted(table[c]["rank"], r, side="right") - 1
            off = r - table[c]["rank"][k]
            at = (table[c]["sequence"][k] + off // table[c]["many"][k], table[c]["slot"][k] + off % table[c]["many"][k])
            assert at not in seen[0]
            seen[0].add(at)
    assert len({s for s, _ in seen[0]}) == sum(n for _, n in patterns)


def check(docs, found):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r["doc_id"]].append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert any(r["doc_tokens"] == len(x) and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    for d, many in ids.items():
        covered = Counter(t for r in pieces[d] for t in range(r["start"], r["start"] + r["length"]))
        assert covered == Counter(t for x in many for t in range(len(x)))
    padded = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= op.WINDOW and rows[0]["padded_length"] in (op.WINDOW, at)
        padded += rows[0]["padded_length"]
    return sum(r["length"] for r in found) / max(1, padded)


def test_little_padding(docs):
    assert check(docs, op.pack(docs).collect()) > 0.97


def test_odd_documents(odd, none):
    check(odd, op.pack(odd).collect())
    assert op.pack(none).count() == 0
