"""N-gram Jaccard join by grouped prefixes: which documents share most of their word sequences.

A document's set is its distinct five-word shingles. Two link when 100 * common >= 75 * union.

1. Equal sets are one (its smallest document stands for it).
2. Shingles are dealt by hash, packed per batch of documents; there each one's number of sets is
   counted. Shingles of a single set can link nothing and are left behind; sets of
   which too few shingles are left are too.
3. Every set puts its shingles in order of rarity. The first n - ceil(0.75 n) + 1 are its
   prefix; linked sets share a prefix shingle. Sets of equal size and prefix are one group.
4. Group pairs come from groups that share a prefix shingle, by size and by place of the shingle. First
   each group is only tried against a few of its list and size class, members against their
   group's first. What these links connect needs no further test, so large groups of near copies
   cost about one test per member. Then every pair of groups or members still in different
   components is tried: no link is lost.
5. Pairs are expanded to sets and counted exactly.

A hot shingle is a long list only of sets not connected yet; joins on it are split by Spark.

Defined results: a null or empty text or one without words has an empty set, linked with nothing;
rows of equal doc_id are one node of the graph, each keeps its own size; a row without a
doc_id has its size and no component; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswatch.llm.common import batches, bytes_of, partitions, text_of, written
from newswatch.llm.components import components

WIDTH = 5  # words of a shingle
HUBS = 4  # groups of a list that all others are tried against first
NEED, OF = 75, 100  # linked when OF * common >= NEED * union
BUCKET = 2 << 20  # shingles dealt to one bucket, about: buckets grow in number, not in size
PART = 1 << 19  # shingles of a bucket sorted at a time
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

SETS = "doc_id long, n_shingles long, set_id binary"
DEALT = "bucket int, set_ids binary, sizes binary, counts binary, shingles binary"
SHARED = "bucket int, set_ids binary, sizes binary, counts binary, shingles binary, rarity binary"
CANDIDATES = "set_id binary, n long, first long, oddity double, prefix array<bigint>, shared binary"


class Shingles:
    """Shingle hashes of texts; the hashes of words are kept, up to `room` of them."""

    def __init__(self, room: int = 250_000):
        self.room, self.known = room, {}

    def of(self, text: bytes) -> np.ndarray:
        """The distinct shingles of a text, sorted, as unsigned 64-bit hashes."""
        words = text.translate(LOWER).split()
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.room:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h)
        if n == 0:
            return h
        k = min(n, WIDTH)
        s = h[: n - k + 1] * MIX[0]
        for j in range(1, k):
            s += h[j : n - k + 1 + j] * MIX[j]
        s ^= np.uint64(k)
        s ^= s >> np.uint64(31)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(29)
        return np.unique(s)


@lru_cache(1)
def shingles() -> Shingles:
    """The store of this Python worker."""
    return Shingles()


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=12).digest()


def prefix_length(n: int) -> int:
    return n - (NEED * n + OF - 1) // OF + 1


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id of every row; set_id is null for empty sets."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text"):
            found = [shingles().of(t) for t in bytes_of(batch.column(1))]
            ids = [set_id(s) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_shingles", "set_id"]
            )

    return docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(count, SETS)


def _packed(bucket: np.ndarray, owner: np.ndarray, ids: np.ndarray, sizes: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
    """Rows (bucket, set ids, sizes, counts, columns...) of entries in order of (bucket, owner)."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        own = owner[a:b][first]
        counts = np.diff([*first, b - a]).astype("<u4")
        yield (int(bucket[a]), ids[own].tobytes(), sizes[own].tobytes(), counts.tobytes(), *(c[a:b].tobytes() for c in columns))


def _emit(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _by_bucket(rows: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after another; they come sorted by bucket. The caller may empty the list."""
    held: list[dict] = []
    bucket = None
    for batch in rows:
        for k in range(batch.num_rows):
            (row,) = batch.slice(k, 1).to_pylist()  # a batch is never held twice
            if held and bucket != row["bucket"]:
                yield held
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield held


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set ids (as rows of three 32-bit integers), sizes, owner of each entry, entries' shingles."""
    ids = np.frombuffer(b"".join(r["set_ids"] for r in rows), "<u4").reshape(-1, 3)
    sizes = np.frombuffer(b"".join(r["sizes"] for r in rows), "<u4")
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), "<u4")
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    return ids, sizes, owner, np.frombuffer(b"".join(r["shingles"] for r in rows), "<u8")


def _numbered(ids: np.ndarray) -> np.ndarray:
    """Equal ids get equal numbers."""
    order = np.lexsort(ids.T)
    new = np.any(np.diff(ids[order], axis=0, prepend=ids[order[:1]] ^ 1), axis=1) if len(ids) else np.zeros(0, bool)
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def _candidate_sets(docs: DataFrame, n_buckets: int) -> DataFrame:
    """set_id, n, first, oddity, prefix, shared of the sets that can have a partner.

    `oddity` is the sum of 1 / (number of sets) over the set's shingles. `prefix` holds the shared shingles of the prefix in order, `first` the place of the first of
    them, `shared` all shared shingles, sorted.
    """

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text", 4 << 20):
            found = [s for s in map(shingles().of, bytes_of(batch.column(0))) if len(s)]
            if not found:
                continue
            sizes = np.array([len(s) for s in found], "<u4")
            ids = np.frombuffer(b"".join(map(set_id, found)), "<u4").reshape(-1, 3)
            flat = np.concatenate(found)
            owner = np.repeat(np.arange(len(found)), sizes)
            bucket = (flat % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            yield _emit(list(_packed(bucket[order], owner[order], ids, sizes, [flat[order]])), _names(DEALT))

    def shared(number: np.ndarray, owner: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        """The entries (owner, number, shingle, number of sets) whose shingle two sets have or more."""
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        same = flat[1:] == flat[:-1]
        some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        flat, owner = flat[some], owner[some]
        order = np.lexsort((number[owner], flat))
        flat, owner = flat[order], owner[order]
        own = number[owner]
        fresh = np.concatenate([[True], (flat[1:] != flat[:-1]) | (own[1:] != own[:-1])])[: len(flat)]
        flat, owner, own = flat[fresh], owner[fresh], own[fresh]
        start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)])
        df = np.diff([*start, len(flat)])
        rarity = np.repeat(np.minimum(df, 65535), df).astype("<u2")
        some = rarity > 1
        return owner[some], own[some], flat[some], rarity[some]

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(rows):
            ids, sizes, owner, flat = _unpacked(held)
            held.clear()
            number = _numbered(ids)
            # Equal shingles are of one part, so a bucket is worked on part by part.
            parts = -(-len(flat) // PART)
            part = ((flat >> np.uint64(40)) % np.uint64(max(parts, 1))).astype(np.int32)
            done = [shared(number, owner[own], flat[own]) for k in range(parts) if len(own := np.flatnonzero(part == k))]
            if not done:
                continue
            owner, own, flat, rarity = (np.concatenate(c) for c in zip(*done, strict=True))
            if not len(flat):
                continue
            bucket = (ids[owner, 0] % n_buckets).astype(np.int32)
            order = np.lexsort((own, bucket))
            # Entries of one set are next to each other and name one owner.
            owner, own = owner[order], own[order]
            owner = owner[np.maximum.accumulate(np.where(np.diff(own, prepend=-1) != 0, np.arange(len(own)), 0))]
            yield _emit(list(_packed(bucket[order], owner, ids, sizes, [flat[order], rarity[order]])), _names(SHARED))

    def choose(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(rows):
            ids, sizes, owner, flat = _unpacked(held)
            rarity = np.frombuffer(b"".join(r["rarity"] for r in held), "<u2")
            number = _numbered(ids)[owner]
            order = np.lexsort((flat, rarity, number))
            number, owner, flat = number[order], owner[order], flat[order]
            share = np.concatenate([[0.0], np.cumsum(1.0 / rarity[order])])
            cuts = np.flatnonzero(np.diff(number, prepend=-1))
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(number)], strict=True):
                n = int(sizes[owner[a]])
                alone = n - int(b - a)  # shingles no other set has come first
                left = prefix_length(n) - alone
                if left > 0:
                    shared = np.sort(flat[a:b])
                    out.append((ids[owner[a]].tobytes(), n, alone, alone + share[b] - share[a], flat[a : a + left].view(np.int64), shared.tobytes()))
            if out:
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.binary()]
                for k in range(0, len(out), 500):
                    columns = zip(zip(*out[k : k + 500], strict=True), kinds, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in columns], _names(CANDIDATES))

    texts = docs.filter(F.col("doc_id").isNotNull()).select(text_of("text").alias("text"))
    # A bucket has a number, so it goes to the partition of that number: none gets two.
    dealt = texts.mapInArrow(deal, DEALT).repartitionById(n_buckets, "bucket").sortWithinPartitions("bucket")
    shared_ones = dealt.mapInArrow(count, SHARED).repartitionById(n_buckets, "bucket").sortWithinPartitions("bucket")
    return shared_ones.mapInArrow(choose, CANDIDATES)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of `pairs` (u, v), by exact counts."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            u, v, nu, nv = (np.array(batch.column(k).to_pylist(), np.int64) for k in range(4))
            a, b = bytes_of(batch.column(4)), bytes_of(batch.column(5))
            common = np.array(
                [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64
            )
            linked = OF * common >= NEED * (nu + nv - common)
            yield pa.RecordBatch.from_arrays([pa.array(u[linked]), pa.array(v[linked])], ["u", "v"])

    own = sets.select("node", "n", "shared")
    left = own.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("shared").alias("a"))
    right = own.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("shared").alias("b"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "a", "b")
    return joined.mapInArrow(count, "u long, v long")


@dataclass
class Joined:
    """Sizes per row, and which component each linked set (named by its smallest document) belongs to."""

    sets: DataFrame
    nodes: DataFrame
    linked: DataFrame


def join(docs: DataFrame) -> Joined:
    """Join `docs` (doc_id, text) with itself."""
    sets = written(_sets(docs), "sets")
    nodes = sets.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("node"))
    nodes = written(nodes, "set-nodes")
    entries = sets.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = max(partitions(docs.sparkSession), -(-entries // BUCKET))
    found = _candidate_sets(docs, n_buckets).join(nodes, "set_id").drop("set_id")
    found = written(found.withColumn("key", F.sha2(F.concat_ws(",", F.col("prefix").cast("array<string>")), 256)), "candidate-sets")

    # Groups: equal size and prefix; the member with the least oddity stands for the group.
    groups = found.groupBy("n", "key").agg(F.min_by("node", F.struct("oddity", "node")).alias("g"))
    members = written(found.select("node", "n", "key").join(groups, ["n", "key"]).select("node", "g"), "set-groups")
    shown = found.join(members.filter("node = g").select("node"), "node")
    lists = written(
        shown.select("n", F.col("node").alias("g"), "first", "oddity", F.posexplode("prefix").alias("at", "shingle")).select(
            "shingle", "g", "n", "first", "oddity", (F.col("first") + F.col("at")).alias("at"), F.floor(F.log(F.col("n")) * 7).alias("size_class")
        ),
        "prefix-lists",
    )

    # First tests: of every member against a few groups of its list and size class, and against its own group. The
    # groups with the least oddity are what copies were made of, or next to it.
    typical = [F.min_by("g", F.struct(F.round("oddity", k).alias("o"), F.xxhash64("g", F.lit(k)))).alias(f"h{k}") for k in range(HUBS)]
    hubs = lists.groupBy("shingle", "size_class").agg(F.count(F.lit(1)).alias("m"), *typical).filter("m > 1")
    some = F.when(F.col("m") > HUBS, F.array(*[f"h{k}" for k in range(HUBS)])).otherwise(F.array("h0"))
    hubs = hubs.select("shingle", "size_class", F.explode(F.array_distinct(some)).alias("hub"))
    tried = lists.join(hubs, ["shingle", "size_class"]).filter("g <> hub").select("g", "hub").distinct()
    tried = tried.join(members, "g").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    tried = tried.unionByName(members.filter("node <> g").select(F.col("node").alias("u"), F.col("g").alias("v"))).distinct()
    first = written(_verified(tried, found), "first-links")

    # Whatever is in different components still, pair by pair.
    now = components(first)
    placed = members.join(now, "node", "left").select("node", "g", F.coalesce("component", "node").alias("c"))
    placed = written(placed, "placed-sets")
    spans = placed.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    open_lists = lists.join(spans, "g")
    mixed = open_lists.groupBy("shingle").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l < h").select("shingle")
    # With each shingle, those of the prefix before it: a pair is looked at where its first common one is, once.
    prefixes = found.select(F.col("node").alias("g"), "prefix")
    open_lists = open_lists.join(mixed, "shingle").join(prefixes, "g")
    open_lists = open_lists.withColumn("before", F.slice("prefix", F.lit(1), (F.col("at") - F.col("first")).cast("int"))).drop("prefix")
    open_lists = written(open_lists, "open-lists")
    a, b = open_lists.alias("a"), open_lists.alias("b")
    need = F.expr(f"ceil({NEED} * (a.n + b.n) / {OF + NEED})")
    pairs = a.join(
        b,
        (F.col("a.shingle") == F.col("b.shingle"))
        & (F.col("a.g") < F.col("b.g"))
        & ~((F.col("a.low") == F.col("a.high")) & (F.col("b.low") == F.col("b.high")) & (F.col("a.low") == F.col("b.low")))
        & (OF * F.least("a.n", "b.n") >= NEED * F.greatest("a.n", "b.n"))
        # Nothing before the first common shingle is common, nor are shingles that a set has alone.
        & (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= need)
        & ~F.arrays_overlap("a.before", "b.before"),
    ).select(F.col("a.g").alias("ga"), F.col("b.g").alias("gb"))
    inner = spans.filter("low < high").select(F.col("g").alias("ga"), F.col("g").alias("gb"))
    pairs = pairs.unionByName(inner).distinct()
    left = placed.select(F.col("g").alias("ga"), F.col("node").alias("u"), F.col("c").alias("cu"))
    right = placed.select(F.col("g").alias("gb"), F.col("node").alias("v"), F.col("c").alias("cv"))
    rest = pairs.join(left, "ga").join(right, "gb").filter("cu <> cv").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    second = written(_verified(rest, found), "second-links")
    # Rows of one doc_id are one node, whatever their texts: they tie their sets together.
    of_doc = sets.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").join(nodes, "set_id").select("doc_id", "node")
    tied = of_doc.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("high")).filter("v < high").drop("high")
    tied = of_doc.join(tied, "doc_id").select(F.col("node").alias("u"), "v")
    known = now.select(F.col("node").alias("u"), F.col("component").alias("v"))
    linked = components(known.unionByName(second).unionByName(tied))
    return Joined(sets, nodes, written(linked, "set-components"))


def classes(joined: Joined) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest document reachable by links) of every row."""
    of_set = joined.nodes.join(joined.linked, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    return joined.sets.join(of_set, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs`, all columns, of each component: of its smallest doc_id, the row with the smallest text digest.

    Rows without an id are in no component; of those with equal sets (without words: equal texts) one stays, or
    none where a row with an id has that set. Only the ids to be removed or met again are joined, so a corpus
    with few copies moves little but its texts.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    joined = join(docs)
    counts = classes(joined).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
    gone = written(counts.filter("c < doc_id OR n > 1").select("doc_id", (F.col("c") == F.col("doc_id")).alias("again")), "near-copies")
    single = docs.join(gone.select("doc_id"), "doc_id", "left_anti").filter("doc_id IS NOT NULL").select(*own)
    digest = F.sha2(text_of("text"), 256).alias("digest__")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row__")
    again = docs.join(gone.filter("again").select("doc_id"), "doc_id", "left_semi").select("doc_id", digest, row)
    again = again.groupBy("doc_id").agg(F.min_by("row__", "digest__").alias("row__")).select("row__.*")

    def sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text"):
            found = [shingles().of(t) for t in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_id(s) if len(s) else None for s in found], pa.binary())], ["digest__", "set_id"])

    null = docs.filter("doc_id IS NULL").select(digest, row)
    null = null.groupBy("digest__").agg(F.first("row__").alias("row__"))
    of_text = null.select("digest__", text_of("row__.text").alias("text")).mapInArrow(sets, "digest__ string, set_id binary")
    known = joined.sets.filter("doc_id IS NOT NULL").select("set_id")
    chosen = of_text.join(known, "set_id", "left_anti").groupBy(F.coalesce("set_id", F.encode("digest__", "utf-8")).alias("k")).agg(F.min("digest__").alias("digest__"))
    null = null.join(chosen.select("digest__"), "digest__", "left_semi").select("row__.*")
    return single.unionByName(again).unionByName(null).select(*own)
