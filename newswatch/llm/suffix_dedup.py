"""Repeated byte strings by merged Burrows-Wheeler transforms.

Every `window`-byte string that starts at two places or more, in whatever documents, is found;
the bytes such strings cover are removed. Matches never cross documents.

1. Equal texts are one text; with two or more of them all its windows are repeated.
2. A window's anchor is the smallest hash of its 16-byte strings. Equal windows have equal anchors, so
   runs of windows of one anchor are dealt by anchor, each with the bytes its windows cover.
   Runs whose anchor is met only once in the corpus hold no repeated window and stay behind.
3. In a task, segments are cut into phrases at places that depend on the next eight bytes only, so equal
   strings have equal phrases. Shards of segments are suffix-sorted on their own (by phrases) and
   their transforms merged: starting from an interleave that knows nothing, each round
   reads the symbols before the suffixes in the present order and deals them out again,
   which makes the interleave right for one phrase more. No suffix is sorted a second time. Where a
   block is divided, the round tells the common prefix; blocks left at a depth are the intervals
   of suffixes that share so many phrases.
4. A window is the bytes before its first phrase, the interval of its whole phrases and the
   bytes after them. Windows equal in all three are equal strings.

5. Anchors with very many different segments are dealt to shards; of each shard every distinct
   window goes on as a hash to where it meets those of the other shards.

Defined results: a null or empty text, and any shorter than the window, loses nothing; rows of
equal doc_id are texts of their own, one result each; a null doc_id is kept; other columns are
not read; an empty table gives no rows. Cut characters of the kept text are dropped where text
is returned (`without_repeats`), never in the counts and digests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswatch.llm.common import batches, bytes_of, partitions, text_of, written

GRAM = 16  # bytes of an anchor string
PHRASE = 32  # mean bytes of a phrase
SHARD = 1 << 13  # phrases of a shard: about a quarter of what is merged at a time
SALT = 32  # tasks that the segments of one anchor are spread over while they are counted
BASE = 0x9E3779B97F4A7C15  # of the rolling hashes; odd, so that it has an inverse
CHUNK = 1 << 20  # bytes of segments merged at a time; a group of one anchor is not divided

RUNS = "digest binary, start int, stop int, anchor long, seen int"
CUTS = "anchor long, segment binary, digest binary, start int, bytes binary"
FOUND = "segment binary, low int, high int, bucket int, shard int, segments binary, owners binary, starts binary, windows binary"
CROSSED = "segment binary, low int, high int"
KEPT = "digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one integer; the end is filled with zeros."""
    out = np.empty(len(data), np.uint64)
    padded = data + bytes(16)
    for r in range(min(8, len(data))):
        own = out[r::8]
        own[:] = np.frombuffer(padded, "<u8", len(own), r)
    return out


def powers(x: int, n: int) -> np.ndarray:
    """x to the 0, 1, ..., n, modulo 2**64."""
    out = np.full(n + 1, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def sliding(h: np.ndarray, w: int, best: np.ufunc, worst: int) -> np.ndarray:
    """The least (or greatest) of every w neighbours, in linear time."""
    n = len(h)
    padded = np.full(-(-n // w) * w, worst, np.uint64)
    padded[:n] = h
    rows = padded.reshape(-1, w)
    ahead = best.accumulate(rows, axis=1).ravel()
    behind = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - w + 1], ahead[w - 1 : n])


def anchor_runs(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, places of the anchor in reach) of each run."""
    data = b"".join(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(lengths) - lengths
    g = eights(data)
    h = mix(g * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([g[8:], np.zeros(8, np.uint64)]) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = np.maximum(h[: len(data) - GRAM + 1], np.uint64(1))
    w = window - GRAM + 1
    least = sliding(h, w, np.minimum, 2**64 - 1)
    valid = np.zeros(len(least) + 1, np.int64)
    np.add.at(valid, offsets, 1)
    np.add.at(valid, offsets + lengths - window + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    least[~valid] = 0
    # Places that are the anchor of some window.
    edge = np.zeros(w - 1, np.uint64)
    reach = sliding(np.concatenate([edge, least, edge]), w, np.maximum, 0)
    places = np.flatnonzero(reach == h)
    change = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
    stop = np.concatenate([change[1:], [len(least)]]) - 1
    change, stop = change[valid[change]], stop[valid[change]]
    value = least[change]
    low, high = np.searchsorted(places, change), np.searchsorted(places, stop + w)
    n = high - low
    run = np.repeat(np.arange(len(change)), n)
    at = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
    seen = np.bincount(run, h[places[at]] == value[run], minlength=len(change))
    text = owner[change]
    return text, change - offsets[text], stop - offsets[text], value.view(np.int64), seen.astype(np.int32)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of sequences laid end to end, each with an end symbol of its own.

    A rank is the number of smaller suffixes; ties are looked at twice as far each time.
    """
    n, step = len(symbols), 1
    ordered = np.sort(symbols)
    rank = np.searchsorted(ordered, symbols)
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            return np.argsort(rank)
        later = rank[np.minimum(tied + step, n - 1)]
        o = np.lexsort((later, rank[tied]))
        tied, later = tied[o], later[o]
        own = rank[tied]
        at = np.arange(len(tied))
        group = np.concatenate([[True], own[1:] != own[:-1]])
        part = group | np.concatenate([[True], later[1:] != later[:-1]])
        rank[tied] = own + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        step *= 2


def merged(orders: list[np.ndarray], before: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of suffix-sorted shards: (suffixes in merged order, common prefix with the one before).

    `before` is the symbol in front of each suffix. Prefixes are told up to `depth` symbols.
    """
    suffixes = np.concatenate(orders)
    n = len(suffixes)
    transforms = before[suffixes]  # shard after shard
    interleave = np.repeat(np.arange(len(orders)), [len(o) for o in orders]).astype(np.uint16)
    common = np.full(n, depth, np.int64)
    block = np.zeros(n, np.int64)
    if n:
        common[0] = 0
    for h in range(1, depth + 1):
        by_shard = np.argsort(interleave, kind="stable")
        ahead = np.empty(n, transforms.dtype)
        ahead[by_shard] = transforms
        deal = np.argsort(ahead, kind="stable")
        interleave = interleave[deal]
        dealt, origin = ahead[deal], block[deal]
        fresh = np.concatenate([[True], (dealt[1:] != dealt[:-1]) | (origin[1:] != origin[:-1])])
        common[fresh & (common == depth)] = h - 1
        block = np.cumsum(fresh) - 1
        if fresh.all():
            break
    out = np.empty(n, np.int64)
    out[np.argsort(interleave, kind="stable")] = suffixes
    return out, common


def repeated_windows(segments: list[bytes], weights: list[int], window: int) -> list[tuple[int, int, int]]:
    """(segment, first byte, last byte + 1) covered by windows met at least twice, a segment counting `weight` times."""
    return windows_of(segments, weights, window)[0]


def windows_of(segments: list[bytes], weights: list[int], window: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """What `repeated_windows` returns, and of each distinct window a hash, its segment (-1 if repeated) and its start."""
    lengths = np.array([len(s) for s in segments], np.int64)
    offsets = np.cumsum(lengths) - lengths
    g = mix(eights(b"".join(segments)))
    local = np.arange(len(g)) - np.repeat(offsets, lengths)
    owner = np.repeat(np.arange(len(segments)), lengths)
    power, back = (powers(x, int(lengths.max(initial=0))) for x in (BASE, pow(BASE, -1, 2**64)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(g * power[local], dtype=np.uint64)])

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the eight-byte strings that start at a to b (exclusive), of one segment."""
        return (sums[b] - sums[a]) * back[local[np.minimum(a, len(local) - 1)]]

    # Phrases: from each cut to the next; the last cut of a segment is followed by its end symbol.
    cut = ((g >> np.uint64(40)) % np.uint64(PHRASE) == 0) & (local <= lengths[owner] - 8)
    cuts = np.flatnonzero(cut)
    whole = np.concatenate([owner[cuts][1:] == owner[cuts][:-1], [False]]) if len(cuts) else np.zeros(0, bool)
    named = np.zeros(len(cuts), np.uint64)
    a, b = cuts[:-1][whole[:-1]], cuts[1:][whole[:-1]]
    named[np.flatnonzero(whole)] = mix(between(a, b) + (b - a).astype(np.uint64))
    n_ends = int((~whole).sum())
    symbols = np.empty(len(cuts), np.int64)
    symbols[~whole] = np.arange(n_ends)  # unique end symbols, smaller than phrases
    symbols[whole] = n_ends + np.unique(named[whole], return_inverse=True)[1]
    # The symbol before each suffix; before a first phrase is its own sequence's end (sequences are circular).
    before = np.concatenate([[0], symbols[:-1]]) if len(cuts) else symbols
    first = np.flatnonzero(np.concatenate([[True], ~whole[:-1]])) if len(cuts) else np.zeros(0, np.int64)
    before[first] = symbols[np.flatnonzero(~whole)]
    sequence = np.cumsum(np.concatenate([[0], ~whole[:-1]])) if len(cuts) else np.zeros(0, np.int64)
    shard = (first[sequence] // SHARD) if len(cuts) else sequence
    orders = []
    for k in np.unique(shard):
        own = np.flatnonzero(shard == k)
        orders.append(own[suffix_order(symbols[own])])

    # Windows: first and last cut in reach, whole phrases between.
    n_windows = np.maximum(0, lengths - window + 1)
    starts = np.arange(int(n_windows.sum())) + np.repeat(offsets - (np.cumsum(n_windows) - n_windows), n_windows)
    seg = np.repeat(np.arange(len(segments)), n_windows)
    lo, hi = np.searchsorted(cuts, starts), np.searchsorted(cuts, starts + window - 8, "right") - 1
    some = hi >= lo
    depth = np.where(some, hi - lo, -1)
    interval = np.full(len(starts), -1, np.int64)
    if len(cuts):
        order, common = merged(orders, before, int(max(1, depth.max(initial=0) + 1)))
        place = np.empty(len(cuts), np.int64)
        place[order] = np.arange(len(cuts))
        by_depth = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[by_depth], np.arange(0, depth.max(initial=-1) + 2))
        for d in range(len(bounds) - 1):
            own = by_depth[bounds[d] : bounds[d + 1]]
            if len(own):
                heads = np.maximum.accumulate(np.where(common < d, np.arange(len(cuts)), 0)) if d else np.zeros(len(cuts), np.int64)
                interval[own] = heads[place[lo[own]]]
    head_end = np.where(some, cuts[np.minimum(lo, len(cuts) - 1)] if len(cuts) else 0, starts + window - 7)
    tail_start = np.where(some, cuts[np.maximum(hi, 0)] if len(cuts) else 0, starts + window - 7)
    key = mix(between(starts, head_end) + (head_end - starts).astype(np.uint64))
    key = mix(key ^ (between(tail_start, starts + window - 7) * np.uint64(0xD6E8FEB86659FD93)))
    key = mix(key + interval.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + depth.astype(np.uint64))
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    weight = np.array(weights, np.int64)[seg]
    times = np.bincount(group, weight)
    again = times[group] > 1
    content = mix(between(starts[first], starts[first] + window - 7))
    single = np.where(times > 1, -1, seg[first])
    # Bytes covered by repeated windows, as runs within segments.
    mark = np.zeros(len(g) + 1, np.int64)
    np.add.at(mark, starts[again], 1)
    np.add.at(mark, starts[again] + window, -1)
    covered = np.cumsum(mark)[:-1] > 0
    turn = np.concatenate([[False], (covered[1:] != covered[:-1]) | (owner[1:] != owner[:-1]), [True]])
    turn[0] = True
    edges = np.flatnonzero(turn)
    runs = [(int(owner[a]), int(local[a]), int(local[a] + b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True) if covered[a]]
    return runs, content, single, local[starts[first]]


def _digests(docs: DataFrame) -> DataFrame:
    text = text_of("text")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def repeats(docs: DataFrame, window: int = 400, most_segments: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows, kept): doc_id, digest, n_bytes, copies of every row; per digest with repeated parts what is left of its text."""
    n_buckets = partitions(docs.sparkSession)

    def runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text", 1 << 20):
            digests, texts = batch.column(0), bytes_of(batch.column(1))
            text, start, stop, anchor, seen = anchor_runs(texts, window)
            yield pa.RecordBatch.from_arrays(
                [digests.take(pa.array(text)), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(anchor), pa.array(seen)],
                ["digest", "start", "stop", "anchor", "seen"],
            )

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "segment", "digest", "start", "bytes"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        for batch in batches(rows, "text", 1 << 20):
            out = []
            for digest, text, own in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for r in own:
                    piece = text[r["start"] : r["stop"] + window]
                    out.append((r["anchor"], hashlib.blake2b(piece, digest_size=16).digest(), digest, r["start"], piece))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 4
        held: list[tuple] = []
        size = 0

        def found() -> Iterator[pa.RecordBatch]:
            runs, content, single, start = windows_of([h[3] for h in held], [h[4] for h in held], window)
            out = [(held[k][2], low, high, *[None] * 6) for k, low, high in runs]
            if held[0][5] > 1:  # one shard of a large group: its distinct windows go to where they meet those of the others
                ids = b"".join(h[2] for h in held)
                bucket = (content % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for x, y in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    own = order[x:y]
                    used, owner = np.unique(single[own], return_inverse=True)
                    segments = b"".join(bytes(16) if u < 0 else ids[16 * u : 16 * u + 16] for u in used.tolist())
                    packed = (segments, np.where(single[own] < 0, -1, owner).astype("<i4").tobytes(), start[own].astype("<i4").tobytes(), content[own].astype("<u8").tobytes())
                    out.append((None, None, None, int(bucket[own[0]]), held[0][1], *packed))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in rows:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:2] != row[:2] and (size > CHUNK or max(held[-1][5], row[5]) > 1):
                    yield from found()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from found()

    def cross(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def met() -> Iterator[pa.RecordBatch]:
            segments, owners, base = b"".join(r["segments"] for r in held), [], 0
            for r in held:
                own = np.frombuffer(r["owners"], "<i4").astype(np.int64)
                owners.append(np.where(own < 0, -1, own + base))
                base += len(r["segments"]) // 16
            owner, start = np.concatenate(owners), np.frombuffer(b"".join(r["starts"] for r in held), "<i4")
            content = np.frombuffer(b"".join(r["windows"] for r in held), "<u8")
            shard = np.repeat([r["shard"] for r in held], [len(r["windows"]) // 8 for r in held])
            _, group = np.unique(content, return_inverse=True)
            low, high = np.full(len(content), shard.max()), np.full(len(content), -1)
            np.minimum.at(low, group, shard)
            np.maximum.at(high, group, shard)
            hit = np.flatnonzero((low[group] < high[group]) & (owner >= 0))
            order = hit[np.lexsort((start[hit], owner[hit]))]
            at, of = start[order].astype(np.int64), owner[order]
            # Windows that touch become one run.
            fresh = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] > at[:-1] + window)])) if len(order) else order
            if len(order):
                last = np.concatenate([fresh[1:], [len(order)]]) - 1
                names = [segments[16 * k : 16 * k + 16] for k in of[fresh].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(at[fresh], pa.int32()), pa.array(at[last] + window, pa.int32())], ["segment", "low", "high"]
                )

        for batch in rows:
            for r in batch.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    yield from met()
                    held = []
                held.append(r)
        if held:
            yield from met()

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches(rows, "text", 1 << 20):
            out = []
            for digest, text, spans in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, end, n, lost = [], 0, 0, 0
                for s in sorted((s["low"], s["high"]) for s in spans):
                    if s[0] > end or not n:
                        n += 1
                        kept.append(text[end : s[0]])
                        lost += s[1] - s[0]
                        end = s[1]
                    elif s[1] > end:
                        lost += s[1] - end
                        end = s[1]
                left = b"".join([*kept, text[end:]])
                shown = left.decode("utf-8", "ignore").encode()  # without cut characters
                out.append((digest, lost, n, hashlib.sha256(left).hexdigest(), shown))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    source = _digests(docs)
    rows = written(source.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "text-digests")
    long = source.filter(F.octet_length("text") >= window).select("digest", "text")
    ran = long.mapInArrow(runs, RUNS).groupBy("digest", "start", "stop", "anchor").agg(F.max("seen").alias("seen"))
    ran = written(ran, "anchor-runs")
    again = ran.groupBy("anchor").agg(F.sum("seen").alias("seen")).filter("seen > 1").select("anchor")
    wanted = ran.join(again, "anchor").groupBy("digest").agg(F.collect_list(F.struct("start", "stop", "anchor")).alias("runs"))
    one_each = long.groupBy("digest").agg(F.first("text").alias("text"))
    texts = written(one_each.join(wanted, "digest").select("digest", "text", "runs"), "texts-with-runs")
    cuts = written(texts.mapInArrow(cut, CUTS), "segments")
    places = cuts.select("segment", "digest", "start")
    distinct = cuts.groupBy("anchor", "segment").agg(F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # An anchor with very many different segments is a hot group: it is dealt to shards of bounded size.
    large = cuts.select("anchor", "segment").distinct().groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / most_segments).cast("int").alias("shards")).filter("shards > 1")
    # They meet their number of shards spread over SALT tasks; there are few such anchors, so they are told to each.
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64("segment", F.lit(1)), F.lit(SALT)).cast("int")
    salted = distinct.withColumn("salt", salt).join(large, ["anchor", "salt"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    salted = salted.withColumn("shard", F.pmod(F.xxhash64("segment"), F.col("shards")).cast("int"))
    dealt = salted.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "segment")
    merged_shards = written(dealt.select("anchor", "shard", "segment", "bytes", "n", "shards").mapInArrow(merge, FOUND), "repeated-windows")
    across = merged_shards.filter("bucket IS NOT NULL").select("bucket", "shard", "segments", "owners", "starts", "windows")
    across = across.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(cross, CROSSED)
    found = merged_shards.filter("bucket IS NULL").select("segment", "low", "high").unionByName(across)
    spans = found.join(places, "segment").select("digest", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    by_text = spans.groupBy("digest").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    kept = texts.select("digest", "text").join(by_text, "digest").select("digest", "text", "spans").mapInArrow(remove, KEPT)
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(copies, "digest"), kept


def report(docs: DataFrame, window: int = 400, most_segments: int = 1000) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, changed (whether any byte is removed)."""
    rows, kept = repeats(docs, window, most_segments)
    kept = written(kept.drop("kept"), "kept-digests")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    return rows.join(kept, "digest", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        (whole | F.coalesce(F.col("n_removed") > 0, F.lit(False))).alias("changed"),
    )


def without_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """The rows of `docs`, all columns, without their repeated bytes; rows of which nothing is left are dropped."""
    rows, kept = repeats(docs, window)
    # Only texts that change meet their row by digest: everything else is passed on as it is.
    tail = uuid.uuid4().hex  # no column of `docs` has such names
    digest, whole, text = (f"{n}__{tail}" for n in ("digest", "whole", "text"))
    copies = rows.filter("copies > 1").select(F.col("digest").alias(digest), F.lit(True).alias(whole)).distinct()
    kept = kept.select(F.col("digest").alias(digest), F.col("kept").alias(text))
    changed = written(kept.join(copies, digest, "full_outer"), "kept-texts")
    joined = docs.withColumn(digest, F.unhex(F.sha2(text_of("text"), 256))).join(changed, digest, "left")
    gone = F.coalesce(F.col(whole), F.lit(False)) & (F.octet_length(text_of("text")) >= window)
    left = F.when(gone, F.lit("")).when(F.col(text).isNotNull(), F.col(text).cast("string")).otherwise(F.col("text"))
    changed_row = gone | F.col(text).isNotNull()
    out = joined.withColumns({"text": left, whole: changed_row}).filter(f"NOT `{whole}` OR trim(text) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(whole), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
