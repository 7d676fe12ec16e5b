"""Packing without padding: documents are split into pieces whose lengths are powers of two.

A document's token ids and an end id are cut into as many pieces of `capacity` ids as there are, then into one piece for each bit of
the rest, longest first. Every piece is a sequence of its own, so that no sequence crosses documents, and as its
length is a power of two it needs no padding. Sequences of one length are a bucket, and follow each other
in batches of `batch_tokens` ids: a training step takes one batch, whose sequences are equally long.

Everything is decided inside a task: a sequence's number is the task's, the sequence's number in its bucket there, and the
bucket, in this order of bits, so that numbers are unique without a shuffle, and equal when a task runs again. A hot source or a
group of copies is as good as any other rows. A task holds a few million ids at a time, or those of one text.

Defined results: a null or empty text is the end id alone. Repeated rows, also with one id, and rows with a null id are documents of
their own. Other columns are left out. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import batches
from parlance.llm.tokens import byte_level

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, batch_id long, tokens binary"
#: Bits of a sequence's number: of the bucket, and of the number in a bucket and task.
BUCKET_BITS, NUMBER_BITS = 5, 38


def binary_pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, length) of the pieces of documents of `sizes` ids, in the documents' order."""
    full = sizes // capacity
    powers = 1 << np.arange(capacity.bit_length() - 2, -1, -1, dtype=np.int64)
    rest, bit = np.nonzero((sizes % capacity)[:, None] & powers)
    owner = np.concatenate([np.repeat(np.arange(len(sizes)), full), rest])
    length = np.concatenate([np.full(int(full.sum()), capacity, np.int64), powers[bit]])
    order = np.argsort(owner, kind="stable")
    return owner[order], length[order]


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 0, batch_tokens: int = 1 << 16) -> DataFrame:
    """One row per piece of `docs` (doc_id, text).

    start: ids of the document before it; doc_tokens: ids of the document with the end id; tokens: the piece's ids as
    little-endian unsigned 32-bit numbers; offset: its place in the sequence, which is always 0. `path` is the vocabulary's
    file, and `capacity` a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError(f"capacity {capacity} isn't a power of two")
    schema = pa.schema([(n, pa.binary() if n == "tokens" else pa.int64()) for n in (c.split()[0] for c in PIECES.split(", "))])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = byte_level(path), TaskContext.get().partitionId()
        if task >> (63 - BUCKET_BITS - NUMBER_BITS):
            raise ValueError("too many partitions to number their sequences")
        used = np.zeros(capacity.bit_length(), np.int64)  # sequences of each bucket so far
        for batch in rows:
            ids = batch.column("doc_id")
            for texts in batches(batch.column("text").to_pandas()):
                found = encode(texts)
                sizes = np.array([len(x) + 1 for x in found], np.int64)
                flat = np.full(int(sizes.sum()), end, "<u4")
                inner = np.ones(len(flat), bool)
                inner[np.cumsum(sizes) - 1] = False
                flat[inner] = np.concatenate(found)
                owner, length = binary_pieces(sizes, capacity)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(sizes) - sizes)[owner]
                bucket = np.log2(length).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                counts = np.bincount(bucket, minlength=len(used))
                number = np.empty(len(bucket), np.int64)
                number[order] = np.arange(len(bucket)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(used, counts)
                used += counts
                name = lambda n: ((task << NUMBER_BITS) + n << BUCKET_BITS) + bucket
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                tokens = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                columns = [ids.take(pa.array(texts.index.to_numpy()[owner])), start, length, sizes[owner], name(number), np.zeros(len(length), np.int64), name(number // np.maximum(1, batch_tokens // length)), tokens]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(cut, PIECES)
