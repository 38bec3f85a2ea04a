"""Language-model scores against counts in dictionaries and probabilities from the definition."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F
from wayset.llm import lm_scoring as op

HELD = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return [w.lower() for w in (text or "").encode().split()] + ["</s>"]


class Plain:
    """The same model, one n-gram at a time."""

    def __init__(self, docs, longest=op.ORDER):
        self.c, self.longest = Counter(), longest
        for doc_id, text in docs:
            if not is_held(doc_id):
                words = ["<s>", *tokens(text)]
                for k in range(1, longest + 1):
                    self.c.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        ones = {g: n for g, n in self.c.items() if len(g) == 1 and g != ("<s>",)}
        self.n, self.v = sum(ones.values()), len(ones)

    def chance(self, context, w):
        if not context:
            return (self.c[(w,)] + 1) / (self.n + self.v + 1)
        weight = op.PRIOR[len(context) + 1]
        return (self.c[(*context, w)] + weight * self.chance(context[1:], w)) / (self.c[context] + weight)

    def score(self, text):
        words = ["<s>", *tokens(text)]
        return sum(math.log10(self.chance(tuple(words[max(0, i - self.longest + 1) : i]), words[i])) for i in range(1, len(words)))

    def base(self, text):
        return sum(math.log10((self.c[(w,)] + 1) / (self.n + 1 * (self.v + 1))) for w in tokens(text))


def agrees(docs, found, longest=op.ORDER):
    plain = Plain(docs, longest)
    texts = {}
    for doc_id, text in docs:
        texts.setdefault(doc_id, []).append(text)
    assert len(found) == len(docs)
    for r in found:
        assert r.held_out == is_held(r.doc_id) and r.train_tokens == plain.n
        same = [t for t in texts[r.doc_id] if len(tokens(t)) == r.n_tokens and math.isclose(plain.base(t), r.base_score, rel_tol=1e-9)]
        assert same and math.isclose(plain.score(same[0]), r.score, rel_tol=1e-9)
        assert r.n_known == sum(plain.c[(w,)] > 0 for w in tokens(same[0]))


@pytest.mark.parametrize(("small", "order"), [(False, 2), (True, 2), (True, 3)])
def test_equals_the_definition(spark, docs, monkeypatch, small, order):
    """In one block and in very many, with one bucket and with very many, and with longer n-grams."""
    if small:
        monkeypatch.setattr(op, "BLOCK", 30_000)
        monkeypatch.setattr(op, "BUCKET", 2_000)
    agrees([tuple(r) for r in docs.select("doc_id", "text").collect()], op.score(docs, HELD(), order).collect(), order)


def test_odd_rows(odd, none):
    agrees([tuple(r) for r in odd.select("doc_id", "text").collect()], op.score(odd, HELD()).collect())
    assert op.score(none, HELD()).collect() == []
    assert {r.n_known for r in op.score(odd, F.lit(True)).collect()} == {0}


def test_distributions_add_up():
    r = random.Random(3)
    plain = Plain([(k, " ".join(r.choice("abcde") for _ in range(20))) for k in range(60)], 3)
    words = [g[0] for g in plain.c if len(g) == 1 and g != ("<s>",)]
    for context in [(), (b"a",), (b"a", b"b"), ("<s>",), (b"never", b"seen")]:
        assert math.isclose(sum(plain.chance(context, w) for w in [*words, b"unknown"]), 1)


def test_packing_round_trip():
    r = np.random.default_rng(1)
    for bits in (8, 30, 63):
        values = np.unique(r.integers(0, 2**bits, 500, dtype=np.uint64))
        assert (op.unpacked(*op.packed(values)) == values).all()
    counts = r.integers(0, 70_000, 50)
    assert (op.grown(*op.shrunk(counts)) == counts).all()


def test_context_helps_on_held_out_texts(spark):
    """Words that follow from the word before are told better than by their frequency."""
    r = random.Random(5)
    chains = [[f"w{k}x{i}" for i in range(5)] for k in range(20)]
    rows = [(i, " ".join(w for _ in range(30) for w in r.choice(chains))) for i in range(400)]
    found = op.score(spark.createDataFrame(rows, "doc_id long, text string"), HELD()).where("held_out").collect()
    assert found and all(x.score > x.base_score + 20 for x in found)
