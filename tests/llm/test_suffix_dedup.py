import hashlib
import random

import numpy as np
import pytest

from wayset.llm import suffix_dedup as op


@pytest.mark.parametrize("signs", [b"a", b"ab", b"abc\xff", bytes(range(256))])
@pytest.mark.parametrize("n", [0, 1, 2, 7, 60, 2000])
def test_suffix_order(signs, n):
    random.seed(n)
    text = bytes(random.choice(signs) for _ in range(n))
    found = op.suffix_order(np.frombuffer(text, np.uint8)).tolist()
    assert sorted(found) == list(range(n))
    heads = [text[i : i + 64] for i in found]
    assert heads == sorted(heads)


def brute(rows):
    first = {}
    for d, text in rows:
        if d is not None:
            for i in range(len(text) - 49):
                first[text[i : i + 50]] = min(d, first.get(text[i : i + 50], d))
    out = []
    for d, text in rows:
        gone = np.zeros(len(text) + 1, dtype=bool)
        if d is not None:
            for i in range(len(text) - 49):
                if first[text[i : i + 50]] < d:
                    gone[i : i + 50] = True
        kept = bytes(c for c, g in zip(text, gone, strict=False) if not g)
        out.append((str(d), len(text), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    found = op.remove_repeats(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == brute(rows)


@pytest.mark.parametrize("hot", [2, 6, 10**9])
def test_fixture(docs, monkeypatch, hot):
    monkeypatch.setattr(op, "HOT_FROM", hot)
    check(docs)


@pytest.mark.parametrize(("hot", "wide"), [(2, 20_000), (10**9, 20_000), (10**9, 1)])
def test_edges(spark, monkeypatch, hot, wide):
    """Passages at both ends, just long enough or not, overlapping, periodic, in many documents, cut in slices; with
    families of different runs sorted whole or by their windows."""
    monkeypatch.setattr(op, "HOT_FROM", hot)
    monkeypatch.setattr(op, "WIDE", wide)
    monkeypatch.setattr(op, "_SLICE", 300)
    monkeypatch.setattr(op, "GROUP_BYTES", 3000)
    random.seed(7)
    some = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    p, q, s = some(50), some(49), some(120)
    texts = [p, q, "x" + p, p + "y", some(30) + q + some(30), "z" * 400, "z" * 60 + some(40), "ab" * 100, "ba" * 80, s, s[:80], s[40:], s + p, some(900)]
    texts += [some(random.randrange(40)) + s[random.randrange(30) :] + some(random.randrange(40)) for _ in range(40)]
    texts += [texts[13][100:700], texts[13], "", None]
    rows = list(zip(random.sample(range(-50, 500), len(texts)), texts, strict=True))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_documents(odd, none):
    check(odd)
    assert op.remove_repeats(none).count() == 0


def test_texts_and_spans(odd):
    for r in op.remove_repeats(odd, carry=["text", "lang"], with_text=True).collect():
        whole = (r["text"] or "").encode()
        left, at = b"", 0
        for a, b in r["spans"]:
            left, at = left + whole[at:a], b
        left += whole[at:]
        assert hashlib.sha256(left).hexdigest() == r["kept_sha256"] and r["kept_text"] == left.decode("utf-8", "ignore")


def test_packed_columns():
    values = np.array([0, 1, 255, 256, 2**40 - 1])
    assert op._unpack(op._pack(values, 5), 5, 5).tolist() == values.tolist()


def test_payloads_of_stretches():
    """Stretches are packed apart and unpacked together; none make no payload."""
    wide, low = np.array([3, -1, 2**40, 7, 0]), np.array([1, 2, 3, 4, 5])
    edges = op._edges(np.array([4, 4, 9, 9, 9]))
    sizes, (first, second) = op._unpacked(op._packed([(wide, 8), (low, 1)], edges), [8, 1])
    assert (sizes.tolist(), first.tolist(), second.tolist()) == ([2, 3], wide.tolist(), low.tolist())
    assert op._packed([(wide[:0], 8)], op._edges(wide[:0])) == []
    assert op._unpacked(op._packed([(wide[:0], 8)]), [8])[1][0].tolist() == []


def test_payloads_grow_with_the_corpus():
    """Every group has something for every bucket: 12 times the text makes some 12 times as many payloads, not 144."""
    payloads = lambda size: (lambda groups, buckets, parts: groups * buckets)(*op.layout(size))
    assert payloads(12 * 10**9) <= 12.5 * payloads(10**9)
    for size in (0, 1, 10**9, 10**10, 10**14):
        groups, buckets, parts = op.layout(size)
        assert size / groups <= op.LARGEST * op.GROUP_BYTES and size / buckets <= op.LARGEST * 16 * op.BUCKET_ANCHORS
        assert size / (3 * buckets * parts) <= 16 * op.BUCKET_ANCHORS / 3 + 1  # what is sorted at once stays as small


@pytest.mark.parametrize("wide", [20_000, 1])
def test_larger_groups_and_parts(spark, monkeypatch, wide):
    """With groups and buckets of a corpus that counts as large, whose bytes are sorted in parts."""
    monkeypatch.setattr(op, "FEW_BYTES", 1000)
    monkeypatch.setattr(op, "GROUP_BYTES", 500)
    monkeypatch.setattr(op, "BUCKET_ANCHORS", 20)
    monkeypatch.setattr(op, "HOT_FROM", 10**9)
    monkeypatch.setattr(op, "WIDE", wide)
    random.seed(11)
    some = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    s = [some(140) for _ in range(6)]
    rows = [(d, some(30) + random.choice(s)[random.randrange(60) :] + some(30) + random.choice(s)[: random.randrange(50, 140)]) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t.encode()) for _, t in rows)
    assert op.layout(size)[2] > 2 and min(op.layout(size)[:2]) > 4
    check(docs)


def test_wide_families_of_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(op, "WIDE", 1)
    monkeypatch.setattr(op, "HOT_FROM", 10**9)
    random.seed(9)
    some = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    s = some(90)
    rows = [(d, some(20) + s[random.randrange(25) :] + some(20)) for d in (4, 4, 1, 7, 7, 9)] + [(None, s), (2, s[:60])]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("signs", [b"a", b"ab", bytes(range(250))])
def test_common_prefixes(signs):
    random.seed(2)
    text = bytes(random.choice(signs) for _ in range(400)) + bytes(60)
    order = np.array(sorted(range(400), key=lambda i: text[i:]))
    found = op.common_prefixes(np.frombuffer(text, np.uint8), order)
    for k, (a, b) in enumerate(zip(order, order[1:], strict=False)):
        same = next((j for j in range(60) if text[a + j : a + j + 1] != text[b + j : b + j + 1]), 60)
        assert min(found[k], op.WINDOW) == min(same, op.WINDOW)


def test_sample_holds_at_any_size():
    assert op.hot_share(500, 10**6) == 1.0
    for n in (10**6, 10**9, 5 * 10**10, 10**12):
        share = op.hot_share(n, 2000 * n)
        assert 0 < int(share * 2**63) and 9_000 <= share * n <= 1_100_000
        assert op.hot_share(n, 10**7 * n) * n * 10**7 <= op.HOT_BYTES * op.HOT_SAMPLE * (n / 1e6) ** (1 / 3) * 1.01


def test_carried_columns_of_any_name(spark):
    """Names that the operator's own steps use come back as they were given."""
    text = "a passage that is well over fifty bytes long, so that it is removed from the second row"
    rows = spark.createDataFrame([(1, text, 5, "x", 0.5), (2, text, 6, "y", 1.5)], "doc_id long, text string, grp int, at string, bytes double")
    found = op.remove_repeats(rows, carry=["grp", "at", "bytes"], with_text=True)
    assert sorted((r["doc_id"], r["grp"], r["at"], r["bytes"], r["n_removed"] > 0) for r in found.collect()) == [(1, 5, "x", 0.5, False), (2, 6, "y", 1.5, True)]
    with pytest.raises(ValueError, match="n_bytes"):
        op.remove_repeats(rows.withColumn("n_bytes", rows.grp), carry=["n_bytes"])
