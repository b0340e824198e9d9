"""Document fingerprints by winnowing: rolling hashes of k-grams, the least of each window, with positions.

Every stretch of K = 30 code points has a hash. Of each WINDOW = 71 hashes next to each other
the least is chosen, the rightmost of equal ones; what is chosen is the fingerprint, as (hash,
position). So two texts that share any stretch of K + WINDOW - 1 = 100 code points share an entry, and
the positions tell where. A text with fewer hashes than a window has the least of all of them, one
shorter than K a single hash of the whole text, an empty one none. Equal texts have equal
fingerprints.

The likeness of two fingerprints is the share of the entries of both whose hash the other has
too: 1 for equal texts (two empty ones included), 0 where nothing is common.

Documents next to each other (descending doc_id, null last; equal ids by a digest of the text; after the
last the first) are compared without a window over the table: the order's split points come from
the ids alone, every text moves once to its stretch of the order, and the first document of each
stretch is sent to the stretch before as well. A task reads its stretch in order and holds two texts and one batch.

Defined results: a null text is an empty one; repeated rows stand next to each other, each has its row;
a single document is its own next one; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswatch.llm.common import batches, bytes_of, partitions, text_of

K = 30  # code points of a hashed stretch
WINDOW = 71  # hashes of which one at least is kept
BASE = np.uint64(0x9E3779B97F4A7C15)
PRINT = "array<struct<hash: bigint, position: bigint>>"
COMPARED = f"doc_id long, n_chars long, edited string, fingerprint {PRINT}, edited_fingerprint {PRINT}, near_edited double, near_next double"


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every stretch of k code points, by doubling."""
    done, width = None, 0  # hashes of stretches of `width`
    part, size, step = points.astype(np.uint64) + np.uint64(1), 1, BASE
    n = len(points) - k + 1
    with np.errstate(over="ignore"):
        for bit in range(k.bit_length()):
            if k >> bit & 1:
                if done is None:
                    done, width = part[: len(points) - size + 1], size
                else:
                    m = len(points) - width - size + 1
                    done = done[:m] * step + part[width : width + m]
                    width += size
            if k >> (bit + 1):
                m = len(points) - 2 * size + 1
                part = part[:m] * step + part[size : size + m]
                size, step = 2 * size, step * step
        h = done[:n].copy()
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def least_of_windows(h: np.ndarray, window: int) -> np.ndarray:
    """The positions chosen: of each window the least hash, the rightmost of equal ones."""
    window = min(window, len(h))
    best, span = np.arange(len(h)), 1
    while span < window:
        shift = min(span, window - span)
        a, b = best[:-shift], best[shift:]
        best, span = np.where(h[b] <= h[a], b, a), span + shift
    return best[np.flatnonzero(np.diff(best, prepend=-1))]


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (as signed integers) and positions of a text's fingerprint, by position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = rolling(points, min(K, len(points)))
    at = least_of_windows(h, WINDOW)
    return h[at].view(np.int64), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the entries of both whose hash the other has too."""
    if not len(a) + len(b):
        return 1.0
    return (int(np.isin(a, b).sum()) + int(np.isin(b, a).sum())) / (len(a) + len(b))


def edited(text: str, other: str) -> str:
    """`text` with its last half (rounded down) replaced by as many code points of `other`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _prints(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0] + [len(h) for h, _ in found])
    entries = [pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(entries, ["hash", "position"]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row of `docs` (doc_id, text)."""

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text"):
            texts = [t.decode("utf-8", "replace") for t in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), _prints([fingerprint(t) for t in texts])], ["doc_id", "n_chars", "fingerprint"]
            )

    return docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(of, f"doc_id long, n_chars long, fingerprint {PRINT}")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """A row per row of `docs`: its fingerprint, its text edited with the next document's, and both likenesses."""
    spark = docs.sparkSession
    n_parts = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    # Ascending in (turned, mark) is descending in doc_id, null last.
    turned = F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))
    rows = rows.withColumns({"turned": turned, "mark": F.xxhash64("text")})
    keys = rows.select("turned", "mark").repartitionByRange(n_parts, "turned", "mark")
    # One key per partition: the first of each stretch of the order.
    heads = sorted((r[1][0], r[1][1]) for r in keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct("turned", "mark"))).collect())
    stretches = len(heads)

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row to its stretch; the first of a stretch also behind the stretch before."""
        for batch in rows:
            every = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            at = [bisect_left(heads, k) for k in every]
            is_head = [a < stretches and heads[a] == k for a, k in zip(at, every, strict=True)]
            own = [a if h else a - 1 for a, h in zip(at, is_head, strict=True)]
            columns = [batch.column(k) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.int32()), pa.array([False] * len(own))], names)
            again = [k for k, h in enumerate(is_head) if h]
            if again:
                to = pa.array([(at[k] - 1) % stretches for k in again], pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(again)) for c in columns), to, pa.array([True] * len(again))], names)

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is awaited: doc_id, text, fingerprint, stretch
        closed = -1  # the stretch whose last row has been answered
        for batch in batches(rows, "text"):
            out: list[tuple] = []
            texts = bytes_of(batch.column(1))
            for doc_id, raw, stretch, ahead in zip(batch.column(0).to_pylist(), texts, *(batch.column(k).to_pylist() for k in (2, 3)), strict=True):
                if ahead and closed == stretch:
                    continue
                text = raw.decode("utf-8", "replace")
                own = fingerprint(text)
                if held is not None:
                    was_id, was, was_print = held
                    other = edited(was, text)
                    other_print = fingerprint(other)
                    near = likeness(was_print[0], other_print[0]), likeness(was_print[0], own[0])
                    out.append((was_id, len(was), other, was_print, other_print, *near))
                held = None if ahead else (doc_id, text, own)
                if ahead:
                    closed = stretch
            if out:
                ids, sizes, others, prints, other_prints, one, two = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(others, pa.string()), _prints(list(prints)),
                     _prints(list(other_prints)), pa.array(one, pa.float64()), pa.array(two, pa.float64())],
                    ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    names = ["doc_id", "text", "turned", "mark", "stretch", "ahead"]
    dealt = rows.select(*names[:4]).mapInArrow(deal, "doc_id long, text string, turned long, mark long, stretch int, ahead boolean")
    dealt = dealt.repartitionById(n_parts, "stretch").sortWithinPartitions("stretch", "ahead", "turned", "mark")
    return dealt.select("doc_id", "text", "stretch", "ahead").mapInArrow(compare, COMPARED)


def written_out(entries: str | Column) -> Column:
    """A fingerprint as text: hash in hex and position of each entry."""
    column = F.col(entries) if isinstance(entries, str) else entries
    return F.array_join(F.transform(column, lambda e: F.concat(F.lower(F.hex(e["hash"])), F.lit(":"), e["position"].cast("string"))), " ")
