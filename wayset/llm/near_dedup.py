"""MinHash near-duplicate detection with fast similarity sketching, banding and exact verification.

A sketch has SKETCH coordinates. In each of the first SKETCH rounds every shingle is hashed to one coordinate, which
it may fill if no earlier round did; in later rounds round k fills coordinate k - SKETCH alone, so every coordinate of
every non-empty set is filled, and the share of equal coordinates concentrates like that of independent MinHashes at
the cost of little more than one hash a shingle.

Texts with equal shingle sets are one node. Nodes that agree in a band of ROWS coordinates are candidates, and every
candidate that is accepted was confirmed on full shingle sets. Candidates are not expanded into all pairs of a bucket:

1. every bucket has a hub, its smallest node, and each node is compared with the hubs it shares most bands with;
   confirmed links give components;
2. nodes of buckets whose nodes still lie in different components are joined on their shingles (``apart_links``).

What pairs inside a component would add is the same component again, so nothing is lost by not comparing them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, documents, fresh, in_chunks, mix64, partitions, seeds, shingles, stored

WIDTH = 5
SIMILARITY = 75  # per cent
ROWS, BANDS = 5, 64
SKETCH = ROWS * BANDS
#: Bands that a node shares with a hub that it is compared with first; what shares fewer is left to the second step.
SHARED_BANDS = 3
#: Hubs that a node is compared with before the search in blocks.
HUBS = 3
#: Members of a hub that one group of a task compares; larger hubs are split.
GROUP = 256
#: Bits of the fixed-size bitmap that keeps texts out of the exact join before they are shuffled (1 MB).
FILTER_BITS = 1 << 23
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of a node's long sketch, and by how many more of them two nodes must agree than differ to be compared. At
#: similarity 0.75 that is 4.5 standard deviations below what is expected (3 in a million miss it), at 0.6 it is 4.8
#: above (one pair in a million meets it).
BITS, AGREE = 2048, 1402
_ROUND = seeds(2 * BITS, 501)
_BAND, _ROW = seeds(BANDS, 502), seeds(ROWS, 503) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each lower-cased text, end to end, and how many each has."""
    hashes, n = shingles([t.lower() for t in texts], WIDTH)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def sketches(hashes: np.ndarray, sizes: np.ndarray, width: int = SKETCH) -> np.ndarray:
    """Fast similarity sketches of sets given end to end; rows of empty sets stay unfilled."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    out = np.full(n * width, _NONE)
    left = np.where(sizes > 0, width, 0)
    for k in range(2 * width):
        active = left[owner] > 0
        if not active.any():
            break
        if not active.all():
            hashes, owner = hashes[active], owner[active]
        value = mix64(hashes ^ _ROUND[k])
        place = (value >> np.uint64(32)) * np.uint64(width) >> np.uint64(32) if k < width else np.full(len(value), k - width, np.uint64)
        at = owner * width + place.astype(np.int64)
        open_ = out[at] == _NONE
        at, value = at[open_], value[open_]
        np.minimum.at(out, at, value)
        left -= np.bincount(np.unique(at) // width, minlength=n)
    return out.reshape(n, width)


def bit_sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lowest bit of every coordinate of a sketch of BITS, packed: two sets of similarity J agree in a share of
    (1 + J) / 2 of them."""
    return np.packbits((sketches(hashes, sizes, BITS) & np.uint64(1)).astype(np.uint8), axis=1)


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    rows = (sketch.reshape(len(sketch), BANDS, ROWS) * _ROW).sum(axis=2, dtype=np.uint64)
    return mix64(rows ^ _BAND)


_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fresh()
    for batch in batches:
        texts = batch["text"].tolist()
        for part in in_chunks([len(t) + 64 for t in texts], 1_000_000):
            hashes, sizes = shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts[part]])
            ends = np.cumsum(sizes)
            bands = band_hashes(sketches(hashes, sizes)).view(np.int64)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].iloc[part], "n_shingles": sizes, "digest": [hashlib.sha256(hashes[e - n : e]).digest() for e, n in zip(ends, sizes, strict=True)],
                "bands": [b if n else None for b, n in zip(bands, sizes, strict=True)],
            })


def _within(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be in ``ids`` (one column, ``node``), by a bitmap of fixed size."""
    slot = f"pmod(xxhash64({{}}), {FILTER_BITS})"
    own, other = slot.format("doc_id"), slot.format("node")
    bits = ids.groupBy(F.expr(f"bitmap_bucket_number({other})").alias("__bucket")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({other}))").alias("__bits"))
    held = docs.withColumn("__bucket", F.expr(f"bitmap_bucket_number({own})")).join(F.broadcast(bits), "__bucket")  # FILTER_BITS bits at most
    byte = f"cast(conv(hex(substring(__bits, cast(bitmap_bit_position({own}) div 8 as int) + 1, 1)), 16, 10) as int)"
    return held.where(F.expr(f"{byte} & shiftleft(1, cast(bitmap_bit_position({own}) % 8 as int)) != 0")).drop("__bucket", "__bits")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fresh()
    for batch in batches:
        texts = batch["text"].tolist()
        for part in in_chunks([len(t) + 64 for t in texts], 1_000_000):
            hashes, sizes = shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts[part]])
            ends = np.cumsum(sizes)
            yield batch.iloc[part].drop(columns=["text"]).assign(shingles=[hashes[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)])


def _close(own: np.ndarray, found: np.ndarray) -> bool:
    common = len(np.intersect1d(own, found, assume_unique=True))
    return 100 * common >= SIMILARITY * (len(own) + len(found) - common)


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by hub and split, the hub's own sets first (one for each of its texts)."""
    fresh()
    at, own = None, []
    for batch in batches:
        links = []
        for node, hub, split, member, shingles in zip(*(batch[c] for c in ("node", "hub", "split", "member", "shingles")), strict=True):
            if (hub, split) != at:
                at, own = (hub, split), []
            found = np.frombuffer(shingles, np.uint64)
            if member == 0:
                own.append(found)
            elif any(_close(o, found) for o in own):
                links.append((node, hub))
        yield pd.DataFrame(links, columns=["node", "hub"], dtype="int64")


def _wanted(pairs: DataFrame) -> DataFrame:
    """node, hub, split, member: what each hub's groups are made of. A hub with many members is split; its own set
    goes to every split."""
    splits = pairs.groupBy("hub").agg(F.count("*").alias("n")).select("hub", (F.floor(F.col("n") / GROUP) + 1).alias("splits"))
    members = pairs.join(splits, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("splits")).alias("split"), F.lit(1).alias("member"))
    hubs = splits.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split"), F.lit(0).alias("member"))
    return members.unionByName(hubs)


def _confirmed(sets: DataFrame) -> DataFrame:
    dealt = sets.repartition(partitions(sets.sparkSession), "hub", "split").sortWithinPartitions("hub", "split", "member")
    return dealt.select("node", "hub", "split", "member", "shingles").mapInPandas(_confirm, "node long, hub long")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (node, hub: doc_ids) whose full shingle sets are similar enough; only their texts move."""
    wanted = _wanted(pairs)
    texts = _within(docs, wanted.select("node")).join(wanted, F.col("doc_id") == F.col("node")).drop("doc_id")
    return _confirmed(texts.mapInPandas(_sets, "node long, hub long, split long, member int, shingles binary"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over ``edges`` (node, hub), for every node with an edge.

    Alternating large-star and small-star steps until nothing changes; every step is cut, so a lost executor costs
    one step. A node with very many edges is aggregated partially and joined by a join that Spark can split.
    """
    now = cut(edges.where("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        seen = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if seen == state or seen[0] == 0:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _mixed(entries: DataFrame, label: DataFrame) -> DataFrame:
    """Entries of the buckets whose nodes lie in several components, with their labels."""
    now = entries.join(label, "node", "left").select("band", "node", "n_shingles", F.coalesce("label", "node").alias("label"))
    mixed = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    return now.join(mixed, "band", "left_semi")


def _sizes_fit(a: str, b: str):
    """Sets whose sizes differ too much cannot be similar enough."""
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _relabel(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links between nodes: their components are joined."""
    known = label.select(F.col("node").alias("k"), F.col("label").alias("l"))
    named = links.join(known, F.col("node") == F.col("k"), "left").select(F.coalesce("l", "node").alias("node"), "hub").join(known, F.col("hub") == F.col("k"), "left").select("node", F.coalesce("l", "hub").alias("hub"))
    joined = components(named).select(F.col("node").alias("k"), F.col("label").alias("l"))
    old = label.join(joined, F.col("label") == F.col("k"), "left").select("node", F.coalesce("l", "label").alias("label"))
    return cut(old.unionByName(joined.select(F.col("k").alias("node"), F.col("l").alias("label"))).distinct())


def _with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and their sets with the long sketches of the sets."""
    fresh()
    for batch in batches:
        blobs = batch.column("shingles")
        sizes = pc.binary_length(blobs).to_numpy() // 8
        for part in in_chunks((sizes + BITS // 8).tolist(), 500_000):
            flat = np.frombuffer(b"".join(blobs[part].to_pylist()), np.uint64)
            bits = bit_sketches(flat, sizes[part])
            kept = batch.slice(part.start, part.stop - part.start)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([b.tobytes() for b in bits], pa.binary())], [*batch.schema.names, "bits"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle of each set."""
    for batch in batches:
        nodes, marks, blobs = batch.column("node").to_numpy(), batch.column("mark").to_numpy(), batch.column("shingles")
        sizes = pc.binary_length(blobs).to_numpy() // 8
        for part in in_chunks(sizes.tolist(), 1_000_000):
            flat = np.frombuffer(b"".join(blobs[part].to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x[part], sizes[part])) for x in (nodes, marks)] + [pa.array(flat)], ["node", "mark", "shingle"])


#: Nodes that a shingle may be in to be looked up by it; those in more are common.
COMMON = 32


def _profiles(sets: DataFrame) -> DataFrame:
    """node, n_shingles, label, rare, hot, sign_a, sign_b, ahead: what each node's set is made of among ``sets``.

    Shingles are ordered: those of one node only, then those of up to COMMON nodes, then common ones. Two sets of
    similarity 0.75 have a shingle in common among the first quarter (and one) of either. ``rare`` counts the
    shingles that are not common, ``ahead`` are the shared ones among them that lie in that first part; ``hot`` and
    two sums describe the set of common ones.
    """
    tokens = sets.select("node", "mark", "shingles").mapInArrow(_tokens, "node long, mark long, shingle long")
    shared = tokens.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle", (F.col("c") > COMMON).alias("common"))
    met = tokens.join(shared, "shingle").groupBy("node", "mark").agg(
        F.array_sort(F.collect_list(F.when(~F.col("common"), F.col("shingle")))).alias("few"), F.count_if("common").alias("hot"),
        F.bit_xor(F.when(F.col("common"), F.xxhash64("shingle"))).alias("sign_a"), F.bit_xor(F.when(F.col("common"), F.xxhash64("shingle", F.lit(1)))).alias("sign_b"),
    )
    n = F.col("n_shingles")
    first = n - F.ceil(n * SIMILARITY / 100) + 1
    alone = n - F.size("few") - F.col("hot")
    held = sets.select("node", "mark", "n_shingles", "label").join(met, ["node", "mark"])
    ahead = F.slice("few", F.lit(1), F.greatest(F.least(first - alone, F.size("few").cast("long")), F.lit(0)).cast("int"))
    return held.select("node", "n_shingles", "label", (n - F.col("hot")).alias("rare"), "hot", "sign_a", "sign_b", ahead.alias("ahead"), (n - F.col("hot") < first).alias("open"))


def _rare_pairs(profiles: DataFrame) -> DataFrame:
    """Pairs (node, hub) of different components that meet in a shingle of the first part of both, COMMON at most."""
    entry = F.struct("label", "node", "n_shingles")
    lists = profiles.select(entry.alias("x"), F.explode("ahead").alias("shingle")).groupBy("shingle").agg(F.collect_list("x").alias("all")).where(F.size("all") > 1)
    each = lists.select(F.explode("all").alias("x"), "all")
    fit = lambda t: (t["label"] < F.col("x.label")) & (100 * F.least(t["n_shingles"], F.col("x.n_shingles")) >= SIMILARITY * F.greatest(t["n_shingles"], F.col("x.n_shingles")))
    return each.select(F.col("x.node").alias("node"), F.explode(F.filter("all", fit)).alias("t")).select("node", F.col("t.node").alias("hub")).distinct()


def _size_class(n):
    """Sizes that fit each other lie in the same class or in one of the two beside it."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / SIMILARITY))).cast("int")


def agreeing(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """(own, other) of packed sketches that agree in enough bits: one product of two matrices of signs."""
    signs = lambda x: np.unpackbits(x, axis=1).astype(np.float32) * 2 - 1
    return np.argwhere(signs(own) @ signs(others).T >= AGREE)


class _Apart:
    """Labels that links found so far leave apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _search_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by block, its targets first. Queries meet all targets by long sketches; where these agree and the two
    are still apart, their full sets are compared. Nothing is listed but the links."""
    fresh()
    at, held, asked, apart = None, [], [], _Apart()

    def found() -> list[tuple]:
        links = []
        matrix = lambda rows: np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), BITS // 8)
        for b in range(0, len(held) if asked else 0, STEP):
            other = held[b : b + STEP]
            for x, y in agreeing(matrix(asked), matrix(other)).tolist():
                one, two = asked[x], other[y]
                if apart.find(one[1]) != apart.find(two[1]) and _close(one[3], two[3]):
                    links.append((one[0], two[0]))
                    apart.join(one[1], two[1])
        asked.clear()
        return links

    for batch in batches:
        links = []
        for size, number, role, node, label, bits, shingles in zip(*(batch[c] for c in ("size", "number", "role", "node", "label", "bits", "shingles")), strict=True):
            if (size, number) != at:
                links += found()
                at, held, apart = (size, number), [], _Apart()
            (asked if role else held).append((node, label, bits, np.frombuffer(shingles, np.uint64)))
            if len(asked) == STEP:
                links += found()
        yield pd.DataFrame(links, columns=["node", "hub"], dtype="int64")
    yield pd.DataFrame(found(), columns=["node", "hub"], dtype="int64")


#: Sketches on either side of one product, and shingles of the targets that one block holds, about.
STEP, BLOCK_SHINGLES = 512, 4_000_000


def _facing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (node, label, band, light), those that share a band with a light one of another label, and the
    light ones that share a band with one of another label (one column, node)."""
    light = lambda f: f(F.when(F.col("light"), F.col("label")))
    bands = rows.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), light(F.min).alias("light_low"), light(F.max).alias("light_high"))
    met = cut(rows.join(bands.where("light_low <> high or light_high <> low"), "band"))
    some = lambda test: met.where(test).select("node").distinct()
    return some("light_low <> label or light_high <> label"), some("light and (low <> label or high <> label)")


def _block_links(sets: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Links (node, hub) of ``queries`` and ``targets`` (one column, node), found in blocks of like size."""
    both = queries.unionByName(targets).distinct()
    drawn = cut(sets.select("node", "label", "n_shingles", "shingles").join(both, "node").mapInArrow(_with_bits, "node long, label long, n_shingles long, shingles binary, bits binary"))
    held = drawn.join(targets, "node").withColumn("size", _size_class(F.col("n_shingles")))
    blocks = held.groupBy("size").agg((F.floor(F.sum("n_shingles") / BLOCK_SHINGLES) + 1).alias("blocks"))  # some dozens of rows
    columns = ["size", "number", "role", "node", "label", "bits", "shingles"]
    dealt = held.join(blocks, "size").withColumn("number", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("role", F.lit(0)).select(*columns)
    asked = drawn.join(queries, "node").withColumn("size", F.explode(F.array(*(_size_class(F.col("n_shingles")) + k for k in (-1, 0, 1)))))
    asked = asked.join(blocks, "size").withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("role", F.lit(1)).select(*columns)
    rows = dealt.unionByName(asked).repartition(partitions(sets.sparkSession), "size", "number").sortWithinPartitions("size", "number", "role")
    return rows.mapInPandas(_search_block, "node long, hub long")


def apart_links(texts: DataFrame, mixed: DataFrame) -> DataFrame:
    """Links (node, hub) that join the components of nodes in ``mixed`` (band, node, label) as all their links would.

    1. Pairs that have a rare shingle in common early enough are looked up by it and confirmed.
    2. Any other link is between nodes without a rare shingle in common, whose rare shingles are few. Among nodes
       with the same common shingles, the one with the least rare ones (the lead) is linked with every node that has
       a link there, so each is compared with the lead alone.
    3. Between such groups, one end of a link has at most a sixth as many rare as common shingles, and so has the
       lead of its group, with which that end is linked and the other end too. So nodes that share a band with
       such a lead are held against all of them of like size, by long sketches in blocks; full sets are compared
       where sketches agree and the two are still apart.

    Rows and bytes of 1 and 2 are in proportion to the nodes' shingles, however alike they are. 3 moves a node's set
    for every block of BLOCK_SHINGLES and costs one product of signs, some 0.1 microseconds, for each pair of a node
    and a lead; where texts differ by more than a sixth from what they share there are none.
    """
    mixed = mixed.select("node", "label", "band")
    nodes = cut(mixed.select("node", "label").distinct())
    found = _within(texts, nodes.select("node")).join(nodes, F.col("doc_id") == F.col("node")).select("node", "label", "text").dropDuplicates(["node", "text"])
    sets = stored(found.mapInPandas(_sets, "node long, label long, shingles binary").select("*", F.xxhash64("shingles").alias("mark"), (F.octet_length("shingles") / 8).cast("long").alias("n_shingles")), "sets")
    profiles = cut(_profiles(sets))
    open_ = profiles.where("open")
    same = ["hot", "sign_a", "sign_b"]
    leads = cut(open_.groupBy(*same).agg(F.min(F.struct("rare", "node", "label")).alias("lead")))
    stars = open_.join(leads, same).where("label <> lead.label").select("node", F.col("lead.node").alias("hub"))
    pairs = cut(_rare_pairs(profiles).unionByName(stars).distinct())
    links = _confirmed(sets.select("node", "shingles").join(_wanted(pairs), "node"))
    light = leads.where("6 * lead.rare <= hot").select("lead.node", F.lit(True).alias("light")).distinct()
    roles = open_.select("node").distinct().join(light, "node", "left").select("node", F.coalesce("light", F.lit(False)).alias("light"))
    return links.unionByName(_block_links(sets, *_facing(cut(mixed.join(roles, "node")))))


def nodes_by_label(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node with a link."""
    hubs = entries.groupBy("band").agg(F.min(F.struct("node", "n_shingles")).alias("h")).select("band", F.col("h.node").alias("hub"), F.col("h.n_shingles").alias("hub_n"))
    votes = entries.join(hubs, "band").where((F.col("node") != F.col("hub")) & _sizes_fit("n_shingles", "hub_n")).groupBy("node", "hub").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED_BANDS)
    best = votes.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "hub")), asc=False), 1, HUBS).alias("b"))  # BANDS hubs at most
    label = components(confirmed(texts, cut(best.select("node", F.explode("b.hub").alias("hub")))))
    return _relabel(label, apart_links(texts, cut(_mixed(entries, label))))


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Texts are lower-cased (A-Z) and taken whole. A text without words (null too) has no shingle and is linked with
    nothing: its component is itself. A null doc_id is never linked: its component is null and it is kept. Rows that
    share a doc_id and a text get the same result each; where one id has several texts, they are one node. An empty
    table gives none. Only doc_id and text are read, so other columns' names don't matter.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = stored(rows.mapInPandas(_sign, _SIGNED), "signatures")
    content = ["n_shingles", "digest"]
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy(*content).agg(F.min("doc_id").alias("node"))
    nodes = usable.join(classes.select("node").distinct(), F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "bands").distinct()
    entries = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("band")
    entries = stored(entries.join(shared, "band"), "bands")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    label = nodes_by_label(rows, entries)
    final = classes.join(label, "node", "left").select(*(F.col(c).alias(f"__{c}") for c in content), F.coalesce("label", "node").alias("__component"))
    at = [F.col(c) == F.col(f"__{c}") for c in content]
    found = signed.select("doc_id", *content).join(final, at, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("__component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_near_dedup(spark, sf_dir):
    return link_documents(documents(spark, sf_dir))
