"""Token ids in fixed-width bit-packed files.

A *segment* is a self-describing run of whole documents: a header, the documents' ids and lengths, byte offsets of
fixed-size blocks, then the ids in the fewest bits that hold the vocabulary. Any block unpacks alone with numpy.
Segments are rows of a Parquet table (the container that every Spark store can read), one file per shard; shards and
the segments in them follow ascending doc_id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import documents, fresh_path, partitions
from ._tokens import crc, default_tokenizer, encoder, text_chunks, vocabulary_size

MAGIC = b"WTK1"
BLOCK = 4096
END_ID = 0
#: A segment is closed once it holds this many ids; a longer document still lies in one segment.
SEGMENT_IDS = 262_144
_HEAD = struct.Struct("<4sBxxxIQQ")  # magic, bits, block, ids, documents
SEGMENT_SCHEMA = "shard int, segment int, first_id long, n_ids long, n_docs long, payload binary"
_SEGMENT = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first, padded to a whole byte."""
    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if bits == 16:
        return raw[: 2 * n].view("<u2").astype(np.uint32)
    planes = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    blocks = [pack_bits(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = _HEAD.pack(MAGIC, bits, BLOCK, len(ids), len(doc_ids))
    return b"".join([head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(lengths, "<u8").tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """Reads one segment; ``ids(start, stop)`` unpacks only the blocks that the range touches."""

    def __init__(self, payload: bytes):
        magic, self.bits, self.block, self.n_ids, n = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        known = np.frombuffer(payload, np.uint8, n, at)
        numbers = np.frombuffer(payload, "<i8", n, at + n)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
        self.lengths = np.frombuffer(payload, "<u8", n, at + 9 * n).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(payload, "<u8", blocks + 1, at + 17 * n).astype(np.int64)
        self.body, self.payload = at + 17 * n + 8 * (blocks + 1), payload

    def ids(self, start: int, stop: int) -> np.ndarray:
        first, last = start // self.block, -(-stop // self.block)
        parts = [unpack_bits(self.payload[self.body + self.offsets[b] : self.body + self.offsets[b + 1]], self.bits, min(self.block, self.n_ids - b * self.block)) for b in range(first, last)]
        whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return whole[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, first id's place in the segment, ids; block ranges are unpacked once, a few at a time."""
        start = 0
        stop = 0
        held, held_from = np.zeros(0, np.uint32), 0
        for d, n in zip(self.doc_ids, self.lengths, strict=True):
            if start + n > stop:
                stop = min(self.n_ids, max(start + int(n), start + 64 * self.block))
                held, held_from = self.ids(start, stop), start
            yield d, start, held[start - held_from : start - held_from + n]
            start += int(n)


def _packer(path: str, bits: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(path)
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        first = held = segment = 0

        def close() -> pa.RecordBatch:
            payload = encode_segment(doc_ids, np.concatenate(lengths), np.concatenate(ids), bits)
            return pa.RecordBatch.from_pylist([{"shard": shard, "segment": segment, "first_id": first, "n_ids": held, "n_docs": len(doc_ids), "payload": payload}], _SEGMENT)

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for part in text_chunks(texts):
                flat, counts = enc.encode(texts[part])
                flat = np.insert(flat, np.cumsum(counts), end_id)
                doc_ids += names[part]
                lengths.append(counts + 1)
                ids.append(flat)
                held += len(flat)
                if held >= SEGMENT_IDS:
                    yield close()
                    first, held, segment = first + held, 0, segment + 1
                    doc_ids, lengths, ids = [], [], []
        if doc_ids:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text, end it with ``end_id``, and write segments in ascending doc_id order.

    One range shuffle puts documents in order; encoding follows it, so each text is encoded once. Null texts are
    empty (one end id), null ids come first, rows with equal ids are ordered by text. An empty table writes an
    empty table. Only doc_id and text are read.
    """
    tokenizer = tokenizer or default_tokenizer()
    bits = max(1, (vocabulary_size(tokenizer) - 1).bit_length())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_packer(tokenizer, bits, end_id), SEGMENT_SCHEMA).write.parquet(path)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            found = [(row.shard, row.first_id + start, d, len(ids), crc(ids)) for d, start, ids in Segment(row.payload).documents()]
            yield pd.DataFrame(found, columns=["shard", "local_start", "doc_id", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def read_token_index(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    A shard's first position is the sum of the shards before it, from one row per shard.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", before.alias("offset"))
    found = segments.select("shard", "first_id", "payload").mapInPandas(_read, "shard int, local_start long, doc_id long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "shard").select("doc_id", (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark, sf_dir):
    path = fresh_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), path)
    return read_token_index(spark, path)
