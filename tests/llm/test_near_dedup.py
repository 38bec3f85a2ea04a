import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayset.llm import near_dedup as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted((str(d), len(s), str(None if d is None else root(d)), d is None or root(d) == d) for d, s in sets)


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in op.link_documents(docs).collect())
    assert found == brute(rows)


def test_fixture(docs):
    check(docs)


def test_odd_documents(odd, none):
    check(odd)
    assert op.link_documents(none).count() == 0


def test_groups_of_near_copies(spark):
    """Chains, a large group whose members differ from each other, and texts that share a passage only."""
    random.seed(11)
    word = lambda: f"w{random.randrange(10_000)}"
    base, rows = [word() for _ in range(120)], []
    for i in range(150):
        copy = list(base)
        for _ in range(random.randrange(5)):
            copy[random.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    chain = [word() for _ in range(100)]
    for i in range(200, 230):
        rows.append((i, " ".join(chain)))
        at = 3 * (i - 200)
        chain = chain[:at] + [word(), word(), word()] + chain[at + 3 :]
    passage = [word() for _ in range(60)]
    rows += [(i, " ".join(passage + [word() for _ in range(60)])) for i in range(300, 360)]
    rows += [(i, "hot copy of one text with more than five words") for i in range(400, 460)]
    random.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    sets = [pool[:1], pool[:40], pool[:1000], pool[250:1250]]
    found = op.sketches(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert (found != op._NONE).all()
    assert abs((found[2] == found[3]).mean() - 750 / 1250) < 0.1
    again = op.sketches(np.concatenate([s[::-1] for s in sets]), np.array([len(s) for s in sets]))
    assert (found == again).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 9), (9, 7), (200, 201), (3, 3)]
    found = {r["node"]: r["label"] for r in op.components(spark.createDataFrame(edges, "node long, hub long")).collect()}
    assert found == {i: 100 for i in range(101, 141)} | {7: 5, 9: 5, 201: 200}


def links_apart(spark, texts):
    """Components of what apart_links gives when every text is a node of its own, in one bucket."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mixed = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label"), F.lit(7).cast("long").alias("band"))
    return {(r["node"], r["hub"]) for r in op.apart_links(docs, mixed).collect()}


def same_components(links, texts):
    label = {i: i for i in range(len(texts))}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    expected = {int(d): int(c) for d, _, c, _ in brute(list(enumerate(texts)))}
    return label == expected


def test_templates_below_the_similarity_are_not_paired(spark, monkeypatch):
    random.seed(3)
    word = lambda: f"w{random.randrange(10**9)}"
    shared = [word() for _ in range(85)]
    texts = [" ".join(shared + [word() for _ in range(20)]) for _ in range(300)]
    seen = []
    monkeypatch.setattr(op, "_wanted", lambda pairs, f=op._wanted: (seen.append(pairs.count()), f(pairs))[1])
    assert links_apart(spark, texts) == set()
    assert seen and seen[0] < 2 * len(texts)


@pytest.mark.parametrize("own", [2, 8, 14])
def test_apart_links_join_what_brute_force_joins(spark, monkeypatch, own):
    """Templates with words taken out and put in, so that groups of like common shingles link within and across."""
    random.seed(own)
    monkeypatch.setattr(op, "COMMON", 4)
    word = lambda: f"w{random.randrange(10**9)}"
    shared = [[word() for _ in range(90)] for _ in range(2)]
    texts = []
    for i in range(160):
        words = list(shared[i % 2])
        for _ in range(random.randrange(3)):
            at = random.randrange(len(words))
            del words[at : at + random.choice((1, 6, 12))]
        texts.append(" ".join(words + [word() for _ in range(random.randrange(own + 1))]))
    texts = list(dict.fromkeys(texts))
    assert same_components(links_apart(spark, texts), texts)


def test_ids_with_several_texts(spark):
    random.seed(5)
    word = lambda: f"w{random.randrange(10**9)}"
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    near = lambda words: " ".join([*words[:-1], word()])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (3, near(b)), (4, near(c)), (5, near(c)), (5, near(c))]
    found = {r["doc_id"]: r["component_id"] for r in op.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def sections(n, kept=45, of=60, words=18):
    """Texts that each hold ``kept`` of ``of`` common sections in a random order: similarity about 0.6 to each other."""
    r = random.Random(11)
    all_ = [" ".join(f"s{k}w{i}" for i in range(words)) for k in range(of)]
    return [" ".join(all_[k] for k in sorted(r.sample(range(of), kept))) for _ in range(n)]


def test_boilerplate_sections_are_not_compared_set_by_set():
    """Every pair of texts shares bands, hardly any is similar enough: few full sets are compared."""
    texts = [t.encode() for t in sections(400)]
    hashes, sizes = op.shingle_sets(texts)
    ends = np.cumsum(sizes)
    bits = op.bit_sketches(hashes, sizes)
    rows = [(k, b.tobytes(), hashes[e - n : e].tobytes()) for k, (b, e, n) in enumerate(zip(bits, ends, sizes, strict=True))]
    batch = pd.DataFrame([(0, 0, role, k, k, b, s) for role in (0, 1) for k, b, s in rows], columns=["size", "number", "role", "node", "label", "bits", "shingles"])
    compared = []
    close = op._close
    op._close = lambda a, b: (compared.append(1), close(a, b))[1]
    try:
        links = {tuple(x) for part in op._search_block([batch]) for x in part.itertuples(index=False)}
    finally:
        op._close = close
    assert same_components(links, [t.decode() for t in texts])
    assert len(compared) < 0.03 * 400 * 400


def test_boilerplate_sections_equal_brute_force(spark):
    texts = sections(150)
    assert same_components(links_apart(spark, texts), texts)


def test_long_sketches_tell_similar_from_alike(spark):
    """Recall at the threshold, and how few pairs of similarity 0.6 pass."""
    r = random.Random(2)
    hits = {0.75: 0, 0.6: 0}
    for share in hits:
        n = 400
        own = [[r.getrandbits(64) for _ in range(n)] for _ in range(40)]
        common = round(2 * n * share / (1 + share))
        pairs = [(x, x[:common] + [r.getrandbits(64) for _ in range(n - common)]) for x in own]
        a, b = (op.bit_sketches(np.array([v for p in pairs for v in p[k]], np.uint64), np.full(len(pairs), n)) for k in (0, 1))
        hits[share] = sum((k, k) in {tuple(x) for x in op.agreeing(a, b).tolist()} for k in range(len(pairs)))
    assert hits[0.75] == 40 and hits[0.6] == 0
