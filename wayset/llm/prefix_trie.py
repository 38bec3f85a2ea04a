"""Patricia trie of conversations: every distinct prefix of turns with what its subtree holds.

Conversations with the same turns are one sequence. Distinct sequences are sorted over all machines by the digests of
their turns. A task cuts its stretch of them into slices of at most SLICE, and builds each slice's Patricia tree from
the common prefixes of neighbours: points exist only where sequences branch, end or are leaves, and an edge holds the
turns between two points. Points are aggregated as they are closed; the unary nodes inside an edge are then expanded
with suffix sums over the edge.

A prefix that several slices share is a prefix of a slice's first or last sequence, its *spine*. Everything off the
spine is final when its slice is done. Spine nodes are written once per depth with what their slice adds, and are
summed by the digest of the prefix; what they themselves weigh is owned by one of the paths they lie on and is handed
to all ancestors by one suffix sum over that path. So no group grows with the number of conversations that share a
prefix, and there are no rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import crc32_sql, fresh, partitions, stored

#: Sequences, and bytes of their digests, that one slice holds at most (one sequence at least).
SLICE, SLICE_BYTES = 10_000, 4_000_000
#: Bytes that stand for a turn.
TURN = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_SCHEMA = "spine boolean, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, seq string, parent_conv_id long, path long, prefix string, parent string, chars long"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}
_ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _SCHEMA.split(", ")])


def prefixes(key: bytes) -> list[str]:
    """The digest of every prefix of whole turns, the empty one first."""
    state, out = hashlib.blake2b(digest_size=16), []
    for d in range(0, len(key) + TURN, TURN):
        out.append(state.hexdigest())
        state.update(key[d : d + TURN])
    return out


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    d, most = 0, min(len(a), len(b))
    while d < most and a[d : d + TURN] == b[d : d + TURN]:
        d += TURN
    return d // TURN


class _Point:
    """A branch, an end or a leaf that is still open, with what its closed children add up to."""

    __slots__ = ("below", "children", "conv", "depth", "first", "leaves", "n", "seq", "waiting")

    def __init__(self, depth: int, first: int):
        self.depth, self.first = depth, first
        self.n, self.conv, self.children, self.leaves, self.below, self.seq, self.waiting = 0, None, 0, 0, 0, None, []

    def take(self, n: int, conv: int) -> None:
        self.n, self.conv = self.n + n, conv if self.conv is None else min(self.conv, conv)


def slice_nodes(keys: list[bytes], chars: list, counts: list[int], convs: list[int], seqs: list[str], number: int) -> list[list]:
    """Rows of ``_SCHEMA`` for the sorted distinct sequences of slice ``number``."""
    rows: list[list] = []
    left, right = prefixes(keys[0]), prefixes(keys[-1])

    def close(point: _Point, up: _Point | None, last: bool, path: list[int]) -> None:
        """Nodes of the edge from ``up``, and what they add to it; ``path`` has the turns' lengths."""
        spine = last or point.first == 0
        if point.depth and not spine and not point.children:
            point.leaves = 1
        for row in point.waiting:  # tops of the closed edges below, which lack their parent
            if spine:
                rows[row][9] = 2 * number + (point.first != 0)
            else:
                rows[row][8] = point.conv
        total, base = point.below, up.depth if up else -1
        for d in range(point.depth, base, -1):
            here = d == point.depth
            seq, length = point.seq if here else None, path[d - 1] if d else 0
            if spine:
                sums = [point.n, point.children if here else 0, point.leaves, point.below]
                for on, side, digests in ((point.first == 0, 0, left), (last, 1, right)):
                    if on:
                        n, children, leaves, saved = sums
                        rows.append([True, d, point.conv, n, children, leaves, saved, seq, None, 2 * number + side, digests[d], digests[d - 1] if d else None, length])
                        sums = [0, 0, 0, 0]  # what a node adds counts once
            else:
                total += (point.n - 1) * length
                rows.append([False, d, point.conv, point.n, point.children if here else 1, point.leaves, total, seq, point.conv, None, None, None, None])
        if up:
            up.take(point.n, point.conv)
            up.leaves, up.below = up.leaves + point.leaves, up.below + total
            if not spine:
                up.children += 1
                rows[-1][8] = None
                up.waiting.append(len(rows) - 1)

    stack = [_Point(0, 0)]
    for j, key in enumerate(keys):
        shared = common(keys[j - 1], key) if j else 0
        while stack[-1].depth > shared:
            point = stack.pop()
            if stack[-1].depth < shared:
                stack.append(_Point(shared, point.first))
            close(point, stack[-1], False, chars[j - 1])
        if len(key) // TURN > stack[-1].depth:
            stack.append(_Point(len(key) // TURN, j))
        stack[-1].seq = seqs[j]
        stack[-1].take(counts[j], convs[j])
    while stack:
        point = stack.pop()
        close(point, stack[-1] if stack else None, True, chars[-1])
    return rows


def _slices(most: int):
    """Tasks that cut their stretch of sequences, which come sorted by key, into slices of at most ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 28
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*held, strict=True)]
            rows = slice_nodes(*columns, number)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_ARROW)], schema=_ARROW)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "chars", "n", "conv_id", "seq")), strict=True):
                if held and (len(held) == most or size + len(row[0]) > SLICE_BYTES):
                    yield done()
                    held, size, number = [], 0, number + 1
                held.append(row)
                size += len(row[0]) + 64
        if held:
            yield done()

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by sequence and conversation; the text that is hashed is never held."""
    at, state = None, None
    for batch in batches:
        seqs, hashes = [], []
        for seq, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if seq != at:
                if at is not None:
                    seqs.append(at)
                    hashes.append(state.hexdigest())
                at, state = seq, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), pa.array(hashes, pa.string())], ["seq", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], ["seq", "ends_sha256"])


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path: each conversation's turns in order, as (digest of role and text, code points of the text).

    Null turns come first, equal turns in the order of their digests; a null role or text is empty. Rows without a
    conv_id belong to no conversation and are left out. A conversation is one row of some 50 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 2 * TURN)
    each = turns.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest.alias("d"), F.length(text).cast("long").alias("chars")).alias("t"))
    in_order = F.array_sort(F.collect_list("t"))
    return each.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t["d"].alias("d"), t["chars"].alias("chars"))).alias("path"))


def rebuilt(found: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the first one of its hundred, h by its id's crc32."""
    key, most = F.col("conv_id"), 5
    heads = found.where(F.pmod(key, F.lit(100)) == 0).select(key.alias("base"), F.slice("path", 1, most).alias("head"))
    h = (F.crc32(key.cast("string").cast("binary")) % (most + 1)).cast("int")
    none = F.slice("path", 1, 0)
    path = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("path", h + 1, F.size("path")))
    return found.withColumn("base", key - F.pmod(key, F.lit(100))).join(heads, "base", "left").select("conv_id", path.alias("path"))


def _spine(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished spine nodes, and (path, depth, conv_id) of every place on a spine."""
    rows = found.where("spine")
    total = lambda c: F.sum(c).alias(c)
    merged = rows.groupBy("prefix").agg(F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), total("n_convs"), total("n_children"), total("n_leaves"), total("saved"), F.max("seq").alias("seq"), F.max("parent").alias("parent"), F.min("path").alias("owner"))
    merged = stored(merged, "spine")
    under = merged.where("parent is not null").groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("more"))
    nodes = merged.join(under, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = stored(nodes.drop("more"), "spine")
    weighed = nodes.select("prefix", "owner", "conv_id", ((F.col("n_convs") - 1) * F.col("chars")).alias("weight"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    places = rows.select("path", "depth", "prefix").join(weighed, "prefix")
    deeper = Window.partitionBy("path").orderBy(F.desc("depth"))
    own = lambda c: F.sum(F.when(F.col("owner") == F.col("path"), F.col(c)).otherwise(0)).over(deeper).alias(c)
    handed = places.select("prefix", own("weight"), own("leaf")).groupBy("prefix").agg(total("weight"), total("leaf"))
    above = nodes.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(handed, "prefix").join(above, "parent", "left")
    final = full.select("depth", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved") + F.col("weight")).alias("saved"), "seq", "parent_conv_id")
    return final, places.select("path", "depth", "conv_id")


def prefix_trie(found: DataFrame, most: int = SLICE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``found`` is (conv_id, path) with unique ids. A node is a distinct prefix of turns, from the root without turns;
    its members are the conversations that begin with it, and the smallest one names it. An empty table has no node,
    not even a root. Equal conversations are one sequence; their ids are hashed in order by one task, as they must be,
    which holds none of them.
    """
    spark = found.sparkSession
    key = F.unhex(F.array_join(F.transform("path", lambda t: t["d"]), "")).alias("key")
    keyed = stored(found.select("conv_id", key, F.transform("path", lambda t: t["chars"]).alias("chars")).withColumn("seq", F.md5("key")), "paths")
    sequences = keyed.groupBy("key", "chars", "seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    dealt = sequences.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    nodes = stored(dealt.mapInArrow(_slices(most), _SCHEMA), "nodes")
    spine, places = _spine(nodes)
    columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "seq", "parent_conv_id"]
    off = nodes.where("not spine")
    parents = places.select("path", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    hung = off.where("parent_conv_id is null").join(parents, ["path", "depth"]).withColumn("parent_conv_id", F.col("above"))
    every = off.where("parent_conv_id is not null").select(*columns).unionByName(hung.select(*columns)).unionByName(spine)
    ends = keyed.select("seq", "conv_id").repartition(partitions(spark), "seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_ends, "seq string, ends_sha256 string")
    closed = every.where("seq is not null").join(ends, "seq").unionByName(every.where("seq is null").withColumn("ends_sha256", F.lit(_EMPTY)))
    return closed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt(paths(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def oracle(table: str = "conversations") -> str:
    """Every prefix of every conversation, grouped; subtrees by the path of each node's smallest member."""
    return f"""
WITH own AS (SELECT conv_id, list(md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST) AS d, list(length(coalesce(text, ''))::BIGINT ORDER BY turn NULLS FIRST) AS c FROM {table} WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT o.conv_id, {crc32_sql("o.conv_id")} % 6 AS h, o.d, o.c, b.d AS bd, b.c AS bc FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
p AS (SELECT conv_id, list_concat(coalesce(bd[1:h], []), d[h + 1:]) AS d, list_concat(coalesce(bc[1:h], []), c[h + 1:]) AS c FROM h),
pre AS (SELECT conv_id, k AS depth, len(d) = k AS ends, CASE WHEN k > 0 THEN c[k] ELSE 0 END AS chars, md5(array_to_string(d[1:k], ',')) AS node, CASE WHEN k > 0 THEN md5(array_to_string(d[1:k - 1], ',')) END AS parent FROM (SELECT *, unnest(range(len(d) + 1)) AS k FROM p)),
n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, count(*) AS n_convs, min(conv_id) AS conv_id, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM pre GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS k FROM n WHERE parent IS NOT NULL GROUP BY 1),
full_n AS (SELECT n.*, coalesce(k, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
sub AS (SELECT pre.node, sum((x.n_convs - 1) * x.chars) AS saved, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM full_n x JOIN pre ON pre.conv_id = x.conv_id AND pre.depth <= x.depth GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM full_n f JOIN sub USING (node) LEFT JOIN n up ON up.node = f.parent"""
