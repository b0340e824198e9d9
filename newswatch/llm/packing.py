"""Packing by power-of-two decomposition: each sequence is one piece of one document.

A document of n ids is cut into n // longest pieces of the longest length and then, for the
rest, one piece per set bit of its length, longest first. Pieces of equal length form a
bucket; a sequence is one piece, so no sequence crosses documents and none is padded.

Sequences are numbered without gaps: buckets from the longest to the shortest, within a
bucket by task and place. Only the counts per task and bucket meet in one task.

Defined results: a null text is an empty document (the end id only); rows with equal ids are
separate documents, their pieces too; a null id stays null; other columns are not read; an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswatch.llm.common import batches, bytes_of, running_offsets, text_of, word_ids, written

PIECES = "doc_id long, start long, length long, doc_tokens long, part int, place long, ids binary"
DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def decompose(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; `longest` is a power of two."""
    cuts = [(k * longest, longest) for k in range(n // longest)]
    start = len(cuts) * longest
    for bit in range(longest.bit_length() - 2, -1, -1):
        if (n % longest) >> bit & 1:
            cuts.append((start, 1 << bit))
            start += 1 << bit
    return cuts


def pack(docs: DataFrame, tokenizer: str, end: int, longest: int = 4096) -> DataFrame:
    """Sequences of `docs` (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, ids.

    `ids` holds unsigned little-endian 32-bit integers. Texts are neither shuffled nor
    gathered; the pieces are written once and numbered from their counts.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(tokenizer), TaskContext.get().partitionId()
        places: dict[int, int] = {}
        for batch in batches(rows, "text"):
            encoded = words.encode(bytes_of(batch.column(1)), end)
            pieces = [(k, start, length) for k, ids in enumerate(encoded) for start, length in decompose(len(ids), longest)]
            if pieces:
                row, start, length = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
                place = np.empty(len(row), np.int64)
                for size in np.unique(length).tolist():  # numbered within their length, over all batches of the task
                    own = np.flatnonzero(length == size)
                    place[own] = places.get(size, 0) + np.arange(len(own))
                    places[size] = places.get(size, 0) + len(own)
                tokens = np.fromiter(map(len, encoded), np.int64, len(encoded))
                # Pieces stand one after another as their documents do.
                flat = np.concatenate(encoded).astype("<u4", copy=False)
                cuts = pa.array(np.concatenate([[0], np.cumsum(length * 4)]), pa.int32())
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, cuts.buffers()[1], pa.py_buffer(flat)])
                columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(tokens[row])]
                columns += [pa.array(np.full(len(row), part), pa.int32()), pa.array(place), ids]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "part", "place", "ids"])

    source = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    pieces = written(source.mapInArrow(cut, PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    first = running_offsets(docs.sparkSession, counts, [F.desc("length"), "part"], "n", "first")
    # One row per task and bucket: the job's number of tasks times the 13 lengths, whatever the data.
    first = written(first.select("length", "part", "first"), "piece-offsets")
    return pieces.join(F.broadcast(first), ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), "ids"
    )


def digests(sequences: DataFrame) -> DataFrame:
    """One row per piece with the checksum of its ids; every sequence holds one piece, at offset 0."""

    def check(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            crc = pa.array([zlib.crc32(x) for x in bytes_of(batch.column(5))], pa.int64())
            n = batch.num_rows
            columns = [batch.column(0), batch.column(1), batch.column(2), crc, batch.column(3), batch.column(4)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.zeros(n, np.int64))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return sequences.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "ids").mapInArrow(check, DIGEST)
