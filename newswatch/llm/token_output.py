"""Token ids in fixed-width bit-packed blocks, written in document order and read back.

Format: a folder of Parquet files, one row per block of whole documents. A shard is
one sorted range of documents; within it blocks follow each other.

| column | meaning |
| --- | --- |
| shard, block | place in the order of documents |
| start | ids of the shard before this block |
| n_ids, width | ids in the block; bits per id, the fewest that hold the vocabulary |
| doc_ids | the block's documents in order (may hold null) |
| ends | for each document, the number of the block's ids up to its end: the block's offsets |
| packed | the ids, `width` bits each, lowest bit first, padded to whole bytes |

Id k of a block is at bit k * width, so any range is read without what lies before it.
A second table gives each shard's number of ids before it.

Defined results: a null text is an empty document (the end id only); rows with equal ids
are written in order of their texts; a null id sorts first; other columns are not read; an
empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswatch.llm.common import batches, bytes_of, running_offsets, text_of, word_ids, written
from newswatch.session import scratch_path

BLOCKS = "shard int, block int, start long, n_ids long, width int, doc_ids array<bigint>, ends array<bigint>, packed binary"
READ = "doc_id long, shard int, first long, n_tokens long, ids_crc32 long"


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold ids below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """`ids` in `width` bits each, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    step = 1 << 16  # a multiple of 8 ids fills whole bytes
    for k in range(0, len(ids), step):
        bits = np.unpackbits(ids[k : k + step].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        out.append(np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(packed: bytes, width: int, first: int, last: int) -> np.ndarray:
    """Ids first to last (exclusive) of a block, reading only the bytes that hold them."""
    if last <= first:
        return np.zeros(0, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", last - first, first * width // 8).astype(np.uint32)
    low, high = first * width, last * width
    raw = np.frombuffer(packed, np.uint8, -(-high // 8) - low // 8, low // 8)
    bits = np.unpackbits(raw, bitorder="little")[low % 8 :][: high - low].reshape(-1, width)
    wide = np.zeros((len(bits), 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


@dataclass
class TokenFiles:
    """The written blocks and, per shard, how many ids lie before it."""

    blocks: DataFrame
    shards: DataFrame


def write(docs: DataFrame, tokenizer: str, vocabulary: int, end: int, block_ids: int = 1 << 18) -> TokenFiles:
    """Encode every whole text of `docs` (doc_id, text), append `end`, write in ascending doc_id order.

    The rows are dealt in ranges of doc_id; a task holds one block at a time.
    """
    spark = docs.sparkSession
    width = width_of(vocabulary)

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = word_ids(tokenizer), TaskContext.get().partitionId()
        block, start = 0, 0
        names: list = []
        held: list[np.ndarray] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "start": pa.array([start]),
                    "n_ids": pa.array([n_held]),
                    "width": pa.array([width], pa.int32()),
                    "doc_ids": pa.array([names], pa.list_(pa.int64())),
                    "ends": pa.array([ends], pa.list_(pa.int64())),
                    "packed": pa.array([pack(np.concatenate(held), width)], pa.binary()),
                }
            )

        for batch in batches(rows, "text"):
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(bytes_of(batch.column(1)), end), strict=True):
                if held and n_held + len(ids) > block_ids:
                    yield flush()
                    block, start, names, held, n_held = block + 1, start + n_held, [], [], 0
                names.append(doc_id)
                held.append(ids)
                n_held += len(ids)
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    path = scratch_path(spark, "token-blocks")
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    shards = running_offsets(spark, totals, ["shard"], "n_ids", "before").select("shard", "before")
    return TokenFiles(blocks, written(shards, "token-shards"))


def read_documents(files: TokenFiles) -> DataFrame:
    """One row per written document: doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids)."""

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                ids = unpack(row["packed"], row["width"], 0, row["n_ids"]).astype("<u4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "shard": pa.array([row["shard"]] * len(ends), pa.int32()),
                        "first": pa.array(row["start"] + starts),
                        "n_tokens": pa.array(ends - starts),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    }
                )

    read = files.blocks.mapInArrow(decode, READ)
    return read.join(files.shards, "shard").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_range(files: TokenFiles, first: int, last: int) -> DataFrame:
    """The ids of global places first to last (exclusive): rows (place, ids) of the blocks that hold them.

    Only the overlapping blocks are read, and of each only the bytes of the range.
    """

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                low, high = max(first - row["place"], 0), min(last - row["place"], row["n_ids"])
                ids = unpack(row["packed"], row["width"], low, high).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"place": pa.array([row["place"] + low]), "ids": pa.array([ids], pa.list_(pa.int64()))}
                )

    placed = files.blocks.join(files.shards, "shard").withColumn("place", F.col("before") + F.col("start"))
    hit = placed.filter((F.col("place") < last) & (F.col("place") + F.col("n_ids") > first))
    return hit.select("place", "n_ids", "width", "packed").mapInArrow(cut, "place long, ids array<bigint>")
