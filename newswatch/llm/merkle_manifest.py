"""Merkle manifest of a table: per group of rows a tree of digests, over the groups one more, a proof per row.

A digest H is the lower-case hex SHA-256 of its inputs one after another (digests as hex text). A row's leaf
is H of its fields, each as its UTF-8 byte count, `:` and value, or `-` for null. In
a group the leaves stand in order; while more than one node is left, every two next to each other
(the last one alone, if odd) become their H. What is left is the group's subroot. The subroots,
in order of the group (null first, bytewise), give the root in the same way.

The tree is a rollup of nested structs. A row's rank in its group is written in digits of base 16. Two digits are
one block of 256 rows: rows are dealt once by (group, block), and within the block the digit
columns are grouped away one after another, each grouping nesting the children it takes up and
working out the four levels of two that a digit spans. The blocks' digests are the leaves of
the next tier, and so on until a group is one block. On the way back each block's row meets the path
above it by one grouping (not a join), and a transform of the nested struct and one explode
emit every row with its whole path. No group of rows grows beyond 256, whatever the group's size.

Defined results: rows of equal order value stand in order of their leaves; repeated rows are a leaf each; null in
the order column comes first; a null group is a group; an empty table gives no rows; columns not named
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswatch.llm.common import running_offsets, written

LEVELS = 4  # levels of two that one digit spans
DIGITS = 2  # digits of a block
BLOCK = LEVELS * DIGITS  # bits of a rank within its block
STEP = "struct<right: boolean, hash: string>"  # a sibling and whether it stands on the right; null: none


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(F.concat(*parts))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _next_level(nodes: Column) -> Column:
    """The digests of every two nodes next to each other."""
    pair = lambda i: digest(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def _levels(nodes: Column, base: int, levels: Column) -> Column:
    """The nodes of a digit and of the four levels above, one array each; beyond the group's levels nothing changes."""

    def above(built: Column, k: Column) -> Column:
        step = lambda last: F.when(F.lit(base) + k < levels, _next_level(last)).otherwise(last)
        return F.concat(built, F.array(let(F.element_at(built, -1), step)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.array(nodes), above)


def _steps(built: Column, at: Column, base: int, levels: Column) -> Column:
    """The siblings of node `at` of a digit, level by level; an entry without hash where it has none."""

    def step(k: Column) -> Column:
        own = F.call_function("shiftright", at, k)
        right = own % 2 == 0
        return F.struct(right.alias("right"), F.get(F.get(built, k), F.when(right, own + 1).otherwise(own - 1)).alias("hash"))

    some = F.least(F.lit(LEVELS), levels - F.lit(base))
    return F.transform(F.when(some > 0, F.sequence(F.lit(0), some - 1)).otherwise(F.array().cast("array<int>")), step)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `rank` (from 0) and `levels` (of the group's tree) to rows sorted by `order` within `group`.

    Rows are dealt in ranges and numbered by partition; only counts per partition and group meet.
    """
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(spread.withColumn("place", F.monotonically_increasing_id()), "manifest-order")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    totals = placed.groupBy("part", group).agg(F.min("place").alias("from"), F.count(F.lit(1)).alias("n"))
    known = _offsets(totals, group)
    same = (placed["part"] == known["part"]) & placed[group].eqNullSafe(known[group])
    return placed.join(known, same).select(*[placed[c] for c in rows.columns], (placed["place"] - known["from"] + known["before"]).alias("rank"), known["levels"])


def _offsets(totals: DataFrame, group: str) -> DataFrame:
    """Rows before each partition's part of a group, and the levels of the group's tree."""
    from pyspark.sql import Window

    own = Window.partitionBy(group)
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("n").over(own)
    levels = F.when(size > 1, F.length(F.bin(size - 1))).otherwise(F.lit(0))
    return written(totals.select("part", group, "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), levels.alias("levels")), "manifest-offsets")


def _blocks(nodes: DataFrame, tier: int) -> DataFrame:
    """One row per block of nodes (key, levels, rank, hash, item): key, levels, rank, hash, nested."""
    base = tier * BLOCK
    spread = nodes.withColumn("block", F.shiftright("rank", BLOCK)).repartition("key", "block")
    spread = spread.withColumnRenamed("item", "nested")
    for k in range(DIGITS):
        child = F.struct(F.col("rank"), F.col("hash"), F.col("nested").alias("below"))
        up = F.shiftright("rank", LEVELS).alias("up")
        spread = spread.groupBy("key", "block", "levels", up).agg(F.array_sort(F.collect_list(child)).alias("kids"))
        built = _levels(F.col("kids.hash"), base + k * LEVELS, F.col("levels"))
        spread = spread.withColumn("built", built).select(
            "key", "block", "levels", F.col("up").alias("rank"),
            F.element_at("built", -1)[0].alias("hash"),
            F.struct(F.col("built"), F.col("kids.below").alias("kids")).alias("nested"),
        )
    return spread.drop("block")


def _emitted(blocks: DataFrame, tier: int, carried: list[str]) -> DataFrame:
    """Every node of the blocks (key, rank, levels, nested, path, carried columns): item, hash, whole path."""
    levels, base = F.col("levels"), tier * BLOCK

    def unfold(nested: Column, digit: int, path: Column) -> Column:
        def one(kid: Column, at: Column) -> Column:
            whole = F.concat(_steps(nested["built"], at, base + digit * LEVELS, levels), path)
            if digit:
                return let(whole, lambda p: unfold(kid, digit - 1, p))
            return F.struct(kid.alias("item"), F.get(F.get(nested["built"], F.lit(0)), at).alias("hash"), whole.alias("path"))

        out = F.transform(nested["kids"], one)
        return F.flatten(out) if digit else out

    every = unfold(F.col("nested"), DIGITS - 1, F.col("path"))
    return blocks.select("key", *carried, F.explode(every).alias("e")).select("key", *carried, "e.item", "e.hash", "e.path")


def _grown(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of blocks over `nodes`, until each key is one block; the last holds the tops."""
    highest = nodes.agg(F.max("levels")).first()[0] or 0
    tiers = []
    for tier in range(max(1, -(-highest // BLOCK))):
        tiers.append(written(_blocks(nodes, tier), f"manifest-tier-{tier}"))
        nodes = tiers[-1].select("key", "levels", "rank", "hash", F.col("rank").alias("item"))
    return tiers


def _unfolded(tiers: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """Every leaf below `above` (key, path, carried columns: one row per key): key, item, hash, path, carried."""
    met = above.withColumn("rank", F.lit(0).cast("long"))
    for tier in reversed(range(len(tiers))):
        blocks = tiers[tier].select("key", "rank", "levels", "nested")
        both = blocks.unionByName(met.select("key", "rank", "path", *carried), allowMissingColumns=True)
        columns = ["levels", "nested", "path", *carried]
        whole = both.groupBy("key", "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
        out = _emitted(whole, tier, carried)
        met = out.withColumnRenamed("item", "rank")
    return out


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, claimed: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of `docs`: the order and group columns, leaf, claimed_leaf, path, subroot, root.

    `path` lists the siblings from the leaf up to the root as (right, hash), hash null where a node has none.
    `claimed` replaces fields by other values; `claimed_leaf` is the leaf of the row as it is then claimed to be.
    """
    named = [F.col(f"`{f}`") for f in fields]
    other = leaf([(claimed or {}).get(f, c) for f, c in zip(fields, named, strict=True)]) if claimed else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{group}`").alias("key"), F.col(f"`{order}`").alias("order"), leaf(named).alias("hash"), other.alias("claimed"))
    rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("hash"), F.col("claimed")))
    placed = ranked(written(rows, "manifest-leaves"), "key", ["order", "hash"])
    tiers = _grown(placed.select("key", "levels", "rank", "hash", F.struct("order", "claimed").alias("item")))

    tops = tiers[-1].select(F.lit(0).alias("key"), F.col("key").alias("group"), "hash")
    tops = ranked(tops, "key", ["group"])
    group_tiers = _grown(tops.select("key", "levels", "rank", "hash", F.col("group").alias("item")))
    root = group_tiers[-1].select("key", F.col("hash").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    of_group = _unfolded(group_tiers, root, ["root"]).select(F.col("item").alias("key"), F.col("hash").alias("subroot"), "root", "path")

    out = _unfolded(tiers, of_group, ["subroot", "root"])
    return out.select(
        F.col("item.order").alias(order), F.col("key").alias(group), F.col("hash").alias("leaf"),
        F.coalesce("item.claimed", "hash").alias("claimed_leaf"), "path", "subroot", "root",
    )


def folded(start: str | Column, path: str | Column) -> Column:
    """The root that a leaf and its path give."""
    own = F.col(start) if isinstance(start, str) else start
    steps = F.col(path) if isinstance(path, str) else path

    def up(node: Column, step: Column) -> Column:
        other = F.coalesce(step["hash"], F.lit(""))
        return digest(F.when(step["right"], F.concat(node, other)).otherwise(F.concat(other, node)))

    return F.aggregate(steps, own, up)


def proof_digest(path: str | Column) -> Column:
    """H of all siblings, from the leaf's level up."""
    steps = F.col(path) if isinstance(path, str) else path
    return digest(F.concat_ws("", steps["hash"]))
