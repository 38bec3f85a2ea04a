"""Removal of byte strings that an earlier document has, by suffix sorting.

Equal 50-byte windows choose the same anchor in them: the 20-byte gram with the least hash. So all places of a string
meet under its anchor's hash, wherever they are:

1. Every document's windows are cut into runs with one anchor. Runs travel as hashes, packed per anchor bucket.
   A bucket tells apart families of runs with one anchor; of runs that are equal throughout, all but the smallest
   document's are repeats. What is left to decide are families of runs that differ somewhere.
2. Those runs' bytes are joined per bucket, and their suffixes are sorted in two stages: suffixes smaller than their
   successors directly, the others by scanning the buckets of first bytes in order. Neighbours in that order with
   50 bytes in common are one string; the smallest document keeps it.
3. Each document drops the union of its repeats.

Documents are dealt once, by hash of their id, and all steps read that one shuffle. An anchor that very many
documents have (told by a sample; this changes no result) is replaced by its windows, which are counted once per
group of documents before they travel, so that no bucket gathers what a hot passage touches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import documents, fresh, mix64, partitions, seeds

WINDOW, GRAM = 50, 20
#: Bytes of text in a group of documents, and anchors in a bucket, about, of a corpus of up to FEW_BYTES of text.
#: Larger ones have groups and buckets larger by the root of their size, up to LARGEST times.
GROUP_BYTES, BUCKET_ANCHORS, FEW_BYTES, LARGEST = 3_000_000, 300_000, 1_000_000_000, 8
#: Documents that are looked at for hot anchors (times the cube root of millions of documents), bytes of text a
#: document among them at most on average, and in how many of them an anchor must be to be hot.
HOT_SAMPLE, HOT_BYTES, HOT_FROM = 10_000, 32_768, 6
#: Hot anchors that tasks are told of, the most frequent ones: 8 MB. Which are told spreads work and changes no result.
HOT_MOST = 1_000_000
#: Different runs that a family may have to be sorted in one bucket; a family of more is divided by its windows.
WIDE = 20_000
_U = np.uint64
_SLICE = 1 << 19
_END = 0xFF  # no UTF-8 text has it
_KEY, _MUL = seeds(256, 601), seeds(8, 602) | _U(1)
_STEP = int(seeds(1, 603)[0]) | 1
_BACK = pow(_STEP, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP to the powers 0, 1, ... and the same of its inverse, modulo 2 ** 64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers = tuple(np.cumprod(np.concatenate([[_U(1)], np.full(size, _U(b))]), dtype=_U) for b in (_STEP, _BACK))
    return _powers


def _gram_hashes(blob: np.ndarray) -> np.ndarray:
    h1 = _KEY[blob]
    h2 = h1[:-1] * _MUL[0] + h1[1:]
    h4 = h2[:-2] * _MUL[1] + h2[2:]
    h8 = h4[:-4] * _MUL[2] + h4[4:]
    h16 = h8[:-8] * _MUL[3] + h8[8:]
    return mix64(h16[:-4] * _MUL[4] + h4[16:])


class Runs:
    """Runs of windows with one anchor in some documents: document's place, first window, windows, hashes."""

    def __init__(self, texts: list[bytes], hot: np.ndarray | None = None):
        parts = [r for r in self._all(texts, hot)]
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
        self.doc, self.start, self.count, self.anchor, self.content = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else empty

    def _all(self, texts: list[bytes], hot: np.ndarray | None) -> Iterator[tuple]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            for at in range(0, len(text) - WINDOW + 1, _SLICE):
                piece = text[at : at + _SLICE + WINDOW - 1]
                if size + len(piece) > _SLICE and held:
                    yield self._some(held, hot)
                    held, size = [], 0
                held.append((k, at, piece))
                size += len(piece) + 1
        if held:
            yield self._some(held, hot)

    @staticmethod
    def _some(held: list[tuple[int, int, bytes]], hot: np.ndarray | None) -> tuple:
        blob = np.frombuffer(bytes([_END]).join(p for _, _, p in held), dtype=np.uint8)
        sizes = np.array([len(p) for _, _, p in held])
        begin = np.cumsum(sizes + 1) - sizes - 1
        grams = _gram_hashes(blob)
        low = (grams & ~_U((1 << 21) - 1)) | np.arange(len(grams), dtype=_U)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: len(low) - (WINDOW - GRAM + 1 - 16)], low[WINDOW - GRAM + 1 - 16 :])
        windows = sizes - WINDOW + 1
        which = np.repeat(np.arange(len(held)), windows)
        at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[which]
        anchor = (low[at] & _U((1 << 21) - 1)).astype(np.int64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        start, which, anchor = at[first], which[first], anchor[first]
        up, down = _power(len(grams) + 1)
        total = np.concatenate([[_U(0)], np.cumsum(grams * up[: len(grams)], dtype=_U)])
        span = lambda a, n: mix64((total[a + n + WINDOW - GRAM] - total[a]) * down[a] + n.astype(_U))
        family = grams[anchor]
        content = span(start, count)
        doc, offset = np.array([k for k, _, _ in held]), np.array([o for _, o, _ in held]) - begin
        if hot is not None and len(hot) and (warm := _in(family, hot)).any():
            each = np.repeat(start[warm], count[warm]) + np.arange(count[warm].sum()) - np.repeat(np.cumsum(count[warm]) - count[warm], count[warm])
            own = span(each, np.ones(len(each), np.int64))
            which_, start_, count_ = np.repeat(which[warm], count[warm]), each, np.ones(len(each), np.int64)
            which, start, count = (np.concatenate([x[~warm], y]) for x, y in ((which, which_), (start, start_), (count, count_)))
            family, content = np.concatenate([family[~warm], mix64(own)]), np.concatenate([content[~warm], own])
        return doc[which], start + offset[which], count, family, content


def _in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def suffix_order(text: np.ndarray, depth: int = 64) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` bytes at least (equal ones in any order).

    Two stages. A suffix smaller than its successor is sorted directly, by 8-byte words. Any other follows from its
    successor: buckets of first bytes are scanned in order, and each suffix met puts the one before it next in that
    one's bucket; within a bucket, runs of one byte are followed until none is left.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    rises = np.zeros(n, dtype=bool)  # smaller than the successor; the last suffix is not
    differ = np.flatnonzero(text[1:] != text[:-1])
    if len(differ):
        nearest = differ[np.minimum(np.searchsorted(differ, np.arange(n)), len(differ) - 1)]
        rises = (np.arange(n) <= differ[-1]) & (text[nearest] < text[np.minimum(nearest + 1, n - 1)])
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)]).astype(_U)
    words = padded[: n + depth]
    for k in range(1, 8):
        words = (words << _U(8)) | padded[k : n + depth + k]
    direct = np.flatnonzero(rises)
    direct = direct[np.lexsort([words[direct + k] for k in range(depth - 8, -1, -8)])]
    ends = np.searchsorted(text[direct], np.arange(257))
    filled: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    last = n - 1
    filled[text[last]].append(np.array([last]))  # the empty suffix comes first of all
    for byte in range(256):
        induced = []
        frontier = np.concatenate(filled[byte]) if filled[byte] else np.zeros(0, np.int64)
        while len(frontier):
            induced.append(frontier)
            before = frontier[frontier > 0] - 1
            frontier = before[(text[before] == byte) & ~rises[before]]
        bucket = np.concatenate([*induced, direct[ends[byte] : ends[byte + 1]]])
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > byte]
        if not len(before):
            continue
        heads = text[before]
        for_each = np.argsort(heads, kind="stable")
        before, heads = before[for_each], heads[for_each]
        edges = np.flatnonzero(np.diff(heads.astype(np.int64), prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(heads)), strict=True):
            filled[heads[a]].append(before[a:b])
    return np.concatenate(order)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Bytes that each suffix in ``order`` has in common with the one before it, counted up to ``most`` or a little more."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(_U)
    words = padded[: len(text)]
    for k in range(1, 8):
        words = (words << _U(8)) | padded[k : len(text) + k]
    found = np.zeros(max(0, len(order) - 1), dtype=np.int64)
    at = np.arange(len(found))
    for k in range(0, most, 8):
        last = len(text) - 1
        differ = words[np.minimum(order[at + 1] + k, last)] ^ words[np.minimum(order[at] + k, last)]
        found[at] += 8
        ends = np.flatnonzero(differ)
        for j in range(8):  # bytes from the first one that differs on are not common
            found[at[ends]] -= (differ[ends] >> _U(8 * (7 - j)) != 0).astype(np.int64)
        at = at[differ == 0]
    return found


def repeated_windows(texts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each text, which of its windows a text of a smaller document has too."""
    sizes = np.array([len(t) for t in texts])
    text = np.frombuffer(b"".join(t + bytes([_END]) for t in texts), dtype=np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    which = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(text)) - begin[which]
    order = suffix_order(text)
    order = order[place[order] <= (sizes - WINDOW)[which[order]]]
    flags = np.zeros(len(text), dtype=bool)
    if len(order):
        first = np.flatnonzero(np.concatenate([[True], common_prefixes(text, order) < WINDOW]))
        owner = docs[which[order]]
        least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(order))))
        flags[order] = owner > least
    return [flags[b : b + max(0, s - WINDOW + 1)] for b, s in zip(begin, sizes, strict=True)]


# Packed columns: little-endian byte planes, so that the shuffle's compression sees equal high bytes together.


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _unpack(data: bytes | np.ndarray, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, width * n).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def _packed(columns: list[tuple[np.ndarray, int]], edges: np.ndarray | None = None) -> list[bytes]:
    """Payloads of the columns' stretches that begin at ``edges`` (none: of them whole)."""
    planes = np.concatenate([_pack(v, w) for v, w in columns])
    bounds = [*([0] if edges is None else edges.tolist()), planes.shape[1]]
    return [(b - a).to_bytes(8, "little") + planes[:, a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _unpacked(payloads: list[bytes], widths: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many rows each payload has, and the columns of all of them, one after the other."""
    sizes, deep = np.array([int.from_bytes(p[:8], "little") for p in payloads], dtype=np.int64), sum(widths)
    planes = np.concatenate([np.frombuffer(p, np.uint8, deep * n, 8).reshape(deep, n) for p, n in zip(payloads, sizes.tolist(), strict=True)], axis=1)
    at = np.cumsum([0, *widths])
    return sizes, [_unpack(planes[a : a + w], w, planes.shape[1]) for a, w in zip(at, widths, strict=False)]


def _edges(values: np.ndarray) -> np.ndarray:
    """Where stretches of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]]))


_ROUTED = "key long, grp long, kind int, payload binary"
_RUNS, _FLAGS, _ASKED, _BYTES = 0, 1, 2, 3
_RUN_WIDTHS, _FLAG_WIDTHS, _ASK_WIDTHS, _SPAN_WIDTHS = [4, 8, 4, 7, 5, 2], [4, 5, 5], [4, 5, 5, 8, 4], [4, 8, 5, 5, 1]
_WIDE_BUCKET = (1 << 62) - 1


def _routed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "grp", "kind", "payload"])


def _group(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes], np.ndarray]:
    """A group's rows in one order that every step finds again, their bytes, and ids (null: the largest number)."""
    fresh()
    texts = [bytes(t) for t in pdf["bytes"]]
    ids = pdf["at"].to_numpy()
    order = sorted(range(len(pdf)), key=lambda i: (ids[i], texts[i]))
    return pdf.iloc[order], [texts[i] for i in order], ids[order]


def _merge(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with those that touch or overlap joined."""
    if not len(doc):
        return doc, start, count
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + count)[order]
    base = doc * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(base + stop)
    new = np.concatenate([[True], (base + start)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.append(reach[first[1:] - 1], reach[-1]) - base[first] - start[first]


def _send_runs(buckets: int, hot):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grp = int(key[0])
        _, texts, ids = _group(pdf)
        texts = [b"" if i == _LAST else t for t, i in zip(texts, ids, strict=True)]  # null ids are left alone
        r = Runs(texts, hot.value)
        order = np.lexsort((r.doc, r.content, r.anchor))  # documents are in order of their ids
        anchor, content, owner = r.anchor[order], r.content[order], ids[r.doc[order]]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        least = owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else owner
        again = order[owner > least]
        keep = np.sort(order[owner == least])
        rows = [(-1 - grp, grp, _FLAGS, *_packed(list(zip(_merge(r.doc[again], r.start[again], r.count[again]), _FLAG_WIDTHS, strict=True))))]
        bucket = (mix64(r.anchor[keep]) % _U(buckets)).astype(np.int64)
        dealt = np.argsort(bucket, kind="stable")
        k, bucket = keep[dealt], bucket[dealt]
        edges = _edges(bucket)
        payloads = _packed(list(zip((r.doc[k], ids[r.doc[k]], r.anchor[k], r.content[k], r.start[k], r.count[k]), _RUN_WIDTHS, strict=True)), edges)
        return _routed([*rows, *((b, grp, _RUNS, p) for b, p in zip(bucket[edges].tolist(), payloads, strict=True))])

    return run


def _settle(most: int):
    """One bucket of anchors: repeats that are equal throughout, and runs whose bytes have to be compared.

    Families of more than ``most`` different runs are asked for by their windows.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        if b < 0:
            return pdf
        fresh()
        sizes, (doc, ids, anchor, content, start, count) = _unpacked(list(pdf["payload"]), _RUN_WIDTHS)
        grp = np.repeat(pdf["grp"].to_numpy(), sizes)
        order = np.lexsort((ids, content, anchor))
        grp, doc, ids, anchor, content, start, count = (x[order] for x in (grp, doc, ids, anchor, content, start, count))
        family = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        kind = family | np.concatenate([[True], content[1:] != content[:-1]])
        at = np.flatnonzero(kind)
        least = ids[at][np.cumsum(kind) - 1]
        kinds = np.add.reduceat(kind.astype(np.int64), np.flatnonzero(family))[np.cumsum(family) - 1]
        low, high = (f.reduceat(ids, np.flatnonzero(family))[np.cumsum(family) - 1] for f in (np.minimum, np.maximum))
        again, open_ = ids > least, (ids == least) & (kinds > 1) & (low < high)
        to = np.where(kinds > most, _WIDE_BUCKET, b)
        rows = []
        for what, of, columns in ((_FLAGS, again, [(doc, 4), (start, 5), (count, 5)]), (_ASKED, open_, list(zip((doc, start, count, to, anchor), _ASK_WIDTHS, strict=True)))):
            k = np.flatnonzero(of)
            k = k[np.argsort(grp[k], kind="stable")]
            edges = _edges(grp[k])
            rows += [(-1 - g, g, what, p) for g, p in zip(grp[k[edges]].tolist(), _packed([(c[k], w) for c, w in columns], edges), strict=True)]
        return _routed(rows)

    return run


def _flags_of(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    told = list(pdf["payload"][pdf["kind"] == _FLAGS])
    return _merge(*_unpacked(told, _FLAG_WIDTHS)[1]) if told else (np.zeros(0, np.int64),) * 3


def _windows(texts: list[bytes], ids: np.ndarray, runs) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Windows of ``runs`` (document, start, count) of a group: those of the first document that has them, and those
    that a document after it has too. Equal means equal bytes."""
    first: dict[bytes, int] = {}
    sent, again = [], []
    for d, start, count in sorted(runs):  # in order of ids
        for s in range(start, start + count):
            (sent if first.setdefault(texts[d][s : s + WINDOW], ids[d]) == ids[d] else again).append((d, s))
    return sent, again


def _answer(buckets: int, parts: int):
    """Bytes that a group is asked for, to the buckets that sort them, each in ``parts``."""

    def run(key: tuple, docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return _routed([])
        grp = int(key[0])
        _, texts, ids = _group(docs)
        flags, rows = [_flags_of(replies)], []
        asked = list(replies["payload"][replies["kind"] == _ASKED])
        if asked:
            doc, start, count, bucket, anchor = _unpacked(asked, _ASK_WIDTHS)[1]
            to = (mix64((bucket * (1 << 32) + anchor).astype(_U)) % _U(buckets * parts)).astype(np.int64)
            wide = bucket == _WIDE_BUCKET
            spans = [texts[d][s : s + n + WINDOW - 1] for d, s, n in zip(doc[~wide], start[~wide], count[~wide], strict=True)]
            doc_, start_, count_, to = doc[~wide], start[~wide], count[~wide], to[~wide]
            if wide.any():
                sent, again = _windows(texts, ids, zip(doc[wide].tolist(), start[wide].tolist(), count[wide].tolist(), strict=True))
                windows = [texts[d][s : s + WINDOW] for d, s in sent]
                spans += windows
                many = np.array(sent, dtype=np.int64).reshape(-1, 2)
                doc_, start_, count_ = np.append(doc_, many[:, 0]), np.append(start_, many[:, 1]), np.append(count_, np.ones(len(many), np.int64))
                hashes = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=7).digest(), "little") for w in windows], dtype=np.int64)
                to = np.append(to, hashes % (buckets * parts))
                more = np.array(again, dtype=np.int64).reshape(-1, 2)
                flags.append((more[:, 0], more[:, 1], np.ones(len(more), np.int64)))
            k, part_ = np.argsort(to, kind="stable"), to % parts
            to = to[k] // parts
            edges = _edges(to)
            heads = _packed(list(zip((doc_[k], ids[doc_[k]], start_[k], count_[k], part_[k]), _SPAN_WIDTHS, strict=True)), edges)
            held = [b"".join([spans[i] for i in some]) for some in np.split(k, edges[1:])]
            rows = [(b, grp, _BYTES, head + text) for b, head, text in zip(to[edges].tolist(), heads, held, strict=True)]
        merged = _merge(*(np.concatenate(c) for c in zip(*flags, strict=True)))
        return _routed([(-1 - grp, grp, _FLAGS, *_packed(list(zip(merged, _FLAG_WIDTHS, strict=True)))), *rows])

    return run


def _sort_suffixes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket of runs that differ: windows that a smaller document's run has too."""
    if int(key[0]) < 0:
        return pdf
    fresh()
    sizes, (doc, ids, start, count, part) = _unpacked(list(pdf["payload"]), _SPAN_WIDTHS)
    grp = np.repeat(pdf["grp"].to_numpy(), sizes)
    texts: list[bytes] = []
    ends = np.cumsum(count + WINDOW - 1)
    for payload, n, stop in zip(pdf["payload"], sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
        base = 8 + sum(_SPAN_WIDTHS) * n - (int(ends[stop - n - 1]) if stop > n else 0)
        texts += [payload[base + a : base + b] for a, b in zip((ends[stop - n : stop] - count[stop - n : stop] - WINDOW + 1).tolist(), ends[stop - n : stop].tolist(), strict=True)]
    found = []
    for p in np.unique(part):  # one after the other, so that a sort needs no more memory in a larger bucket
        k = np.flatnonzero(part == p)
        flags = np.concatenate(repeated_windows([texts[i] for i in k], ids[k]))
        again = np.repeat(k, count[k])[flags]
        place = (np.arange(len(flags)) - np.repeat(np.cumsum(count[k]) - count[k], count[k]))[flags]
        found.append((again, start[again] + place))
    again, at = (np.concatenate(c) for c in zip(*found, strict=True))
    owner = (grp[again] << 32) | doc[again]
    owners, own = np.unique(owner, return_inverse=True)
    own, at, n = _merge(own, at, np.ones(len(at), np.int64))
    grp, doc = owners[own] >> 32, owners[own] & 0xFFFFFFFF
    edges = _edges(grp)
    return _routed([(-1 - g, g, _FLAGS, p) for g, p in zip(grp[edges].tolist(), _packed(list(zip((doc, at, n), _FLAG_WIDTHS, strict=True)), edges), strict=True)])


def _finish(columns: list[str], with_text: bool):
    def run(key: tuple, docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        rows, texts, _ = _group(docs)
        doc, start, count = _flags_of(replies)
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, s, n in zip(doc.tolist(), start.tolist(), count.tolist(), strict=True):
            mine, stop = spans.setdefault(d, []), s + n + WINDOW - 1
            if mine and s <= mine[-1][1]:
                mine[-1] = (mine[-1][0], max(stop, mine[-1][1]))
            else:
                mine.append((s, stop))
        kept = []
        for k, text in enumerate(texts):
            at, parts = 0, []
            for s, e in spans.get(k, ()):
                parts.append(text[at:s])
                at = e
            kept.append(b"".join([*parts, text[at:]]))
        out = rows[[c for c in rows.columns if c in columns]].copy()
        out["n_bytes"] = [len(t) for t in texts]
        out["n_removed"] = [len(t) - len(k) for t, k in zip(texts, kept, strict=True)]
        out["n_spans"] = [len(spans.get(k, ())) for k in range(len(texts))]
        out["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in kept]
        if with_text:
            out["kept_text"] = [k.decode("utf-8", "ignore") for k in kept]
            out["spans"] = [[list(s) for s in spans.get(k, ())] for k in range(len(texts))]
        return out

    return run


_LAST = 2**63 - 1


def _hot_anchors(rows: DataFrame, share: float) -> np.ndarray:
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            r = Runs([bytes(t) for t in batch["bytes"]])
            pairs = np.unique(np.stack([r.anchor, r.doc.astype(_U)], axis=1), axis=0)[:, 0]
            found, n = np.unique(pairs, return_counts=True)
            yield pd.DataFrame({"anchor": found.view(np.int64), "n": n})

    drawn = F.xxhash64(F.lit("hot"), "at").bitwiseAND(F.lit(2**63 - 1)) < F.lit(min(2**63 - 1, int(share * 2**63)))
    counted = rows.where(drawn).select("bytes").mapInPandas(look, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM)
    heaviest = counted.orderBy(F.desc("n"), "anchor").limit(HOT_MOST).select("anchor")  # the others stay with the sorter
    found = heaviest.toPandas()["anchor"].to_numpy(np.int64).view(_U)
    return np.sort(found)


def hot_share(n: int, size: int) -> float:
    """The share of ``n`` documents of ``size`` bytes that is looked at for hot anchors.

    The sample grows with the cube root of the corpus. An anchor that it does not tell has some 6 places a sampled
    document more at most: a million in 5e10 documents. What the driver gets is HOT_MOST anchors at most.
    """
    sample = HOT_SAMPLE * max(1.0, n / 1e6) ** (1 / 3)
    return min(1.0, sample / max(1, n), sample * HOT_BYTES / max(1, size))


def layout(size: int) -> tuple[int, int, int]:
    """Groups of documents, buckets of anchors, and parts that a bucket's bytes are sorted in, for ``size`` bytes of text.

    Every group has something for every bucket, so both grow with the root of the corpus, up to LARGEST times: then as
    many payloads move for each byte as in a small one.
    """
    scale = min(LARGEST, max(1.0, (size / FEW_BYTES) ** 0.5))
    return max(4, math.ceil(size / (GROUP_BYTES * scale))), max(4, math.ceil(size / (BUCKET_ANCHORS * 16 * scale))), math.ceil(scale)


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, the columns of ``carry``, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``.

    With ``with_text`` also kept_text (bytes that no longer make a character are left out) and spans (removed byte
    ranges). Every byte that lies in a 50-byte string which a document with a smaller doc_id has too is removed;
    strings never cross documents and are judged on the input. Null texts are empty, shorter ones than 50 bytes stay
    whole. A null doc_id is neither smaller nor larger than others: its row stays whole and removes nothing. Rows
    that share an id don't remove from each other. An empty table gives none. Carried columns may have any names but
    those of the results.
    """
    spark = docs.sparkSession
    taken = {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"}
    if clash := taken & set(carry or []):
        raise ValueError(f"carried columns have the results' names: {sorted(clash)}")
    own = {f"__{k}": c for k, c in enumerate(carry or [])}  # names that nothing else has
    docs = docs.select("doc_id", "text", *(F.col(c).alias(o) for o, c in own.items()))
    carry = list(own)
    at = F.coalesce("doc_id", F.lit(_LAST)).alias("at")
    rows = docs.select("doc_id", at, F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("bytes"), *carry)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()
    groups, buckets, parts = layout(size)
    hot = spark.sparkContext.broadcast(_hot_anchors(rows, hot_share(n, size)))  # HOT_MOST hashes at most
    spread = F.xxhash64(F.coalesce("doc_id", F.xxhash64("bytes")))
    dealt = rows.withColumn("grp", F.pmod(spread, F.lit(groups))).repartition(partitions(spark), "grp")
    by_group = dealt.groupBy("grp")
    runs = by_group.applyInPandas(_send_runs(buckets, hot), _ROUTED)
    settled = runs.groupBy("key").applyInPandas(_settle(WIDE), _ROUTED)
    sent = by_group.cogroup(settled.groupBy("grp")).applyInPandas(_answer(3 * buckets, parts), _ROUTED)
    told = sent.groupBy("key").applyInPandas(_sort_suffixes, _ROUTED)
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select("doc_id", *carry).schema]
    schema += ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", *(["kept_text string", "spans array<array<long>>"] if with_text else [])]
    found = by_group.cogroup(told.groupBy("grp")).applyInPandas(_finish(["doc_id", *carry], with_text), ", ".join(schema))
    return found.select(*(F.col(c).alias(own.get(c, c)) for c in found.columns))


def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))
