"""Language-model scores by a weighted backoff automaton of smoothed n-grams.

The model has all n-grams up to ORDER of the training texts, none left out. A context h predicts w with
(c(hw) + PRIOR * p(w | shorter h)) / (c(h) + PRIOR), down to the unigrams (c(w) + 1) / (N + V + 1), so every
distribution adds up to one over all words and the unknown word. As an automaton: every n-gram that was seen is a
state and an arc with its smoothed probability, and a state's failure arc leads to the state of the shorter context with
weight PRIOR / (c(h) + PRIOR). Texts are read once from left to right: a document carries its state from word to word,
takes the arc of the next word if there is one, else the failure arc, and adds up what it passes.

The automaton is never in one place. Documents are dealt to blocks of about BLOCK bytes. A block asks for the
distinct n-grams that it holds with its own counts; asks meet by hash in buckets of about BUCKET n-grams, and a bucket
answers where the total differs from what the block has itself. The block then has every state that its documents
can reach. Asks and answers are packed arrays; no n-gram, however frequent, is more than one entry a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import documents, fresh, in_chunks, mix64, partitions, seeds, word_hashes

#: Words of the longest n-grams. Three take 4.6 times the input of disk; see the README.
ORDER = 2
#: Weight of the shorter context's distribution, in words seen, by the n-gram's words: chosen on held-out texts of a
#: small table.
PRIOR = {2: 1000.0, 3: 30.0}
#: Bytes of a block's texts, and n-grams of a bucket, about.
BLOCK, BUCKET = 8_000_000, 1 << 21
#: Bits of a longer n-gram's hash beyond those that count all n-grams: one in a million has another one's hash.
SPARE = 20
_U = np.uint64
_KEYS = seeds(16, 901) | _U(1)
#: Hashes of the begin and end marks, which no word has but by a chance of 2 ** -64.
_BEGIN, _END = seeds(2, 902)


def sentence_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words between a begin and an end mark, end to end, and how many each text has."""
    lower = [t.lower() for t in texts]  # bytes: A-Z only
    blob = np.frombuffer(b" ".join(lower) + b" ", dtype=np.uint8)
    words, counts = word_hashes(blob, np.fromiter(map(len, lower), np.int64, len(lower)) + 1)
    sizes = counts + 2
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]), _U)
    inner = np.ones(len(out), dtype=bool)
    inner[ends - 1] = inner[ends - sizes] = False
    out[inner], out[ends - sizes], out[ends - 1] = words, _BEGIN, _END
    return out, sizes


def ngrams(hashes: np.ndarray, sizes: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each place, and which places have one.

    Unigrams keep their 64 bits, longer n-grams the upper ``bits``.
    """
    depth = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    there = depth >= order - 1
    if order == 1:
        return hashes, there
    out = np.zeros(len(hashes), _U)
    for k in range(order):
        out[order - 1 :] += mix64(hashes[order - 1 - k : len(hashes) - k] * _KEYS[order + k])
    return mix64(out) >> _U(64 - bits), there


def packed(values: np.ndarray) -> tuple[bytes, int]:
    """Sorted unsigned integers as differences of the fewest whole bytes."""
    steps = np.diff(values, prepend=_U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes(), width


def unpacked(data, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return np.cumsum(out.view("<u8").ravel(), dtype=_U)


def shrunk(counts: np.ndarray) -> tuple[bytes, int]:
    kind = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype(np.uint8)
    return counts.astype(kind).tobytes(), kind.itemsize


def grown(data, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}").astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the distinct training words of some texts, and in one row the texts' bytes and training words."""
    fresh()
    for batch in batches:
        texts, held = batch.column("text").to_pylist(), np.array(batch.column("held_out").to_pylist(), dtype=bool)
        for part in in_chunks([len(t) + 16 for t in texts], BLOCK):
            hashes, sizes = sentence_hashes(texts[part])
            trained = hashes[np.repeat(~held[part], sizes) & (hashes != _BEGIN)]
            own = np.unique(trained).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64())], ["word", "size", "trained"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([sum(len(t) + 16 for t in texts[part])]), pa.array([len(trained)])], ["word", "size", "trained"])


def distinct(values: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and how often each is among the ``trained`` ones."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    out = ordered[new]
    return out, np.bincount(np.searchsorted(out, np.sort(values[trained])), minlength=len(out))


_ASKS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("ord", pa.int32()), ("low", pa.int64()), ("hashes", pa.binary()), ("width", pa.int32()), ("counts", pa.binary()), ("size", pa.int32())])
_ANSWERS = pa.schema([("block", pa.int64()), ("ord", pa.int32()), ("low", pa.int64()), ("places", pa.binary()), ("width", pa.int32()), ("totals", pa.binary()), ("size", pa.int32())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_NAMES[f.type]}" for f in schema)


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, sizes = sentence_hashes(table.column("text").to_pylist())
    return hashes, sizes, np.array(table.column("held_out").to_pylist(), dtype=bool)


def _ask(longest: int, bits: int, buckets: int):
    """A block's distinct n-grams with its training counts, by bucket: the upper bits of the hash."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fresh()
        hashes, sizes, held = _block(table)
        trained = np.repeat(~held, sizes)
        rows: list[tuple] = []
        for order in range(1, longest + 1):
            values, there = ngrams(hashes, sizes, order, bits)
            found, counts = distinct(values[there], trained[there])
            wide = 64 if order == 1 else bits
            first = np.arange(1 << buckets, dtype=_U) << _U(wide - buckets) if buckets else np.zeros(1, _U)
            edges = [*np.searchsorted(found, first).tolist(), len(found)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if a < b:
                    rows.append((k, key[0].as_py(), order, a, *packed(found[a:b]), *shrunk(counts[a:b])))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ASKS)], schema=_ASKS)

    return run


def _answer(longest: int):
    """Totals over all blocks, for those n-grams of each block whose total is not its own count."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fresh()
        rows = []
        asked = table.to_pylist()
        for order in range(1, longest + 1):
            asks = [r for r in asked if r["ord"] == order]
            if not asks:
                continue
            each = [unpacked(r["hashes"], r["width"]) for r in asks]
            own = np.concatenate([grown(r["counts"], r["size"]) for r in asks])
            bounds = np.concatenate([[0], np.cumsum([len(e) for e in each])]).tolist()
            flat = np.concatenate(each)
            del each
            sort = np.argsort(flat, kind="stable")
            flat = flat[sort]
            new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            totals, sums = np.empty(len(flat), np.int64), np.add.reduceat(own[sort], new)
            totals[sort] = np.repeat(sums, np.diff(np.append(new, len(flat))))
            for r, a, b in zip(asks, bounds, bounds[1:], strict=False):
                more = np.flatnonzero(totals[a:b] != own[a:b])
                if len(more):
                    rows.append((r["block"], order, r["low"], *packed(more.astype(_U)), *shrunk(totals[a:b][more])))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ANSWERS)], schema=_ANSWERS)

    return run


def walk(sizes: np.ndarray, seen: dict, arcs: dict, fails: dict) -> np.ndarray:
    """Each document's log10 probability, by one traversal from left to right.

    For each place and order k: ``seen[k]`` tells whether the automaton has an arc for the n-gram that ends there,
    ``arcs[k]`` is its log10 probability, ``fails[k]`` the weight of the failure arc of the state of k words before the
    place. All documents advance by one word at a time; ``level`` is how many words the state of each stands for.
    """
    order = np.argsort(-sizes, kind="stable")
    start, left, top = (np.cumsum(sizes) - sizes)[order], sizes[order], max(seen) - 1
    steps = int(left[0]) if len(left) else 1
    active = np.searchsorted(-left, -np.arange(1, steps), side="left")  # documents with a word at each step
    ends = np.cumsum(active)
    rank = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - active, active)
    at = start[rank] + np.repeat(np.arange(1, steps), active)  # places by step
    seen, arcs, fails = ({k: v[at] for k, v in x.items()} for x in (seen, arcs, fails))
    total, level = np.zeros(len(sizes)), np.ones(len(sizes), np.int64)
    for a, n in zip((ends - active).tolist(), active.tolist(), strict=True):
        now, reached = level[:n], np.ones(n, np.int64)
        for k in range(top, 0, -1):
            waiting = (reached == 1) & (now >= k)  # in a state of k words, or fallen to it
            hit = waiting & seen[k + 1][a : a + n]
            total[:n] += np.where(hit, arcs[k + 1][a : a + n], np.where(waiting, fails[k][a : a + n], 0.0))
            reached[hit] = k + 1
        total[:n] += np.where(reached == 1, arcs[1][a : a + n], 0.0)
        level[:n] = np.minimum(reached, top)
    out = np.empty(len(sizes))
    out[order] = total
    return out


def _score(longest: int, bits: int, n: int, v: int):
    """Scores of a block's documents, from its own counts and the answers that it got."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        fresh()
        hashes, sizes, held = _block(docs)
        trained = np.repeat(~held, sizes)
        told = answers.to_pylist()
        seen, arcs, fails = {}, {}, {}
        for order in range(1, longest + 1):
            values, there = ngrams(hashes, sizes, order, bits)
            places = np.flatnonzero(there)
            found, inverse = np.unique(values[places], return_inverse=True)
            counts = np.bincount(inverse, weights=trained[places], minlength=len(found)).astype(np.int64)
            for r in told:
                if r["ord"] == order:
                    counts[r["low"] + unpacked(r["places"], r["width"]).astype(np.int64)] = grown(r["totals"], r["size"])
            count = np.zeros(len(hashes), np.int64)
            count[places] = counts[inverse]
            if order == 1:
                chance = (count + 1) / (n + v + 1)
            else:
                weight, context = PRIOR[order], np.zeros(len(hashes))
                context[1:] = shorter[:-1]  # how often training has the words before
                chance = (count + weight * chance) / (context + weight)
                fails[order - 1] = np.log10(weight / (context + weight))
            seen[order], arcs[order], shorter = count > 0, np.log10(chance), count
        first = np.cumsum(sizes) - sizes
        base, known = arcs[1].copy(), seen[1].astype(np.int64)
        base[first] = known[first] = 0
        sums = [pa.array(sizes - 1), pa.array(np.add.reduceat(known, first)), pa.array(np.full(len(sizes), n)), pa.array(np.add.reduceat(base, first)), pa.array(walk(sizes, seen, arcs, fails))]
        return pa.Table.from_arrays([docs.column("doc_id"), docs.column("held_out"), *sums], schema=_SCORES)

    return run


def score(docs: DataFrame, held_out: Column, longest: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    The model learns from the rows that are not held out (a null ``held_out`` is not). A text's tokens are its
    lower-cased (A-Z) words and one end; a null or empty text is the end alone. ``base_score`` is the add-one unigram
    score over the training words. Null ids pass through, equal rows give equal scores, with no training row every
    token is unknown, an empty table gives none. Only doc_id and text are read beside what ``held_out`` reads.
    A document is scored in one task, whose memory grows with the longest one.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    seen = rows.mapInArrow(_words, "word long, size long, trained long")
    v, n, size = seen.agg(F.count_distinct("word"), F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks, words = math.ceil(max(size, 1) / BLOCK), max(size // 4, 1)
    bits = min(64, (words * longest).bit_length() + SPARE)
    buckets = max(0, math.ceil(math.log2(words * longest / BUCKET)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))).repartition(partitions(spark), "block")
    asks = dealt.groupBy("block").applyInArrow(_ask(longest, bits, buckets), _sql(_ASKS))
    answers = asks.repartition(partitions(spark), "bucket").groupBy("bucket").applyInArrow(_answer(longest), _sql(_ANSWERS))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(longest, bits, n, v), _sql(_SCORES))


def op11_lm_scoring(spark, sf_dir):
    return score(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
