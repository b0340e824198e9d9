"""Changes to stored tables as DataFrames, and the two ways to store them.

Parquet has no row updates: a change is a new version of the table. A new
version goes to its own folder, and the catalog entry moves to it once the
write is complete, so readers and failed jobs never see half a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newswatch.schemas import PARTITIONED, PIECEWISE, TABLES

PIECE_ROWS = 1_000_000  # rows a run puts in one piece of a table, about


def last_per_key(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last writer of each key; one row per key and task reaches the shuffle."""
    window = Window.partitionBy(*keys).orderBy(F.desc(order))
    return updates.withColumn("rn", F.row_number().over(window)).where("rn = 1").drop("rn", order)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows replaced by key, new keys added (M3). ``updates`` has unique keys."""
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def upsert_columns(target: DataFrame, updates: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Columns of ``updates`` replaced by key, the target's other columns kept (M2).

    ``s_modified_ts`` of touched rows becomes ``as_of``; ``s_created_ts`` of new rows too.
    """
    changed = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"new_{c}") for c in changed], F.lit(True).alias("touched"))
    joined = target.withColumn("existing", F.lit(True)).join(new, keys, "full_outer")

    def value(name: str):
        if name in keys:
            return F.col(name)
        if name in changed:
            return F.when(F.col("touched"), F.col(f"new_{name}")).otherwise(F.col(name)).alias(name)
        if name == "s_modified_ts":
            return F.when(F.col("touched"), as_of).otherwise(F.col(name)).alias(name)
        if name == "s_created_ts":
            return F.when(F.col("existing"), F.col(name)).otherwise(as_of).alias(name)
        return F.col(name)

    return joined.select(*[value(c) for c in target.columns])


def summarized(summaries: DataFrame) -> DataFrame:
    """Ids of summaries with text."""
    return summaries.where(F.coalesce("article_summary", F.lit("")) != "").select(F.col("article_id").alias("id"))


def bodies_to_keep(bodies: DataFrame, summaries: DataFrame) -> DataFrame:
    """Bodies of articles that have no summary text yet."""
    return bodies.join(summarized(summaries), "id", "left_anti")


def bodies_to_purge(bodies: DataFrame, summaries: DataFrame) -> DataFrame:
    """Non-NULL bodies whose article has a summary text; its count is the purge's result."""
    return bodies.where("article_content IS NOT NULL").join(summarized(summaries), "id", "left_semi")


def with_bodies(articles: DataFrame, bodies: DataFrame) -> DataFrame:
    """Articles with their body, NULL once purged."""
    keys = ["industry_sector", "company_name", "url"]
    return articles.join(bodies.select(*keys, "article_content"), keys, "left")


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the database and every stored table that does not exist."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        layout = f"PARTITIONED BY ({PARTITIONED[name]})" if name in PARTITIONED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet {layout}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a stored table in order, missing ones NULL (additive evolution)."""
    schema = df.sparkSession.createDataFrame([], TABLES[name]).schema
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def append(df: DataFrame, database: str, name: str) -> None:
    """Add rows to a stored table (M1, M6, M7)."""
    balanced(conform(df, name), name).write.insertInto(f"{database}.{name}")


def balanced(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a partitioned table gathered by sector for few, even files.

    Rebalancing splits a sector that holds a third of all rows over as many
    tasks as its size asks for, and joins small ones.
    """
    return rows.hint("rebalance", PARTITIONED[name]) if name in PARTITIONED else rows


def version_path(spark: SparkSession, database: str, name: str) -> str:
    """A fresh folder beside a stored table for a new version of it."""
    home = spark.sql(f"DESCRIBE DATABASE {database}").where("info_name = 'Location'").head().info_value
    return f"{home}/{name}-{uuid.uuid4().hex}"


def replace(df: DataFrame, database: str, name: str) -> None:
    """Store a new version of an unpartitioned table and point the catalog at it (M2-M5)."""
    if name in PARTITIONED:
        raise ValueError(f"{name} is partitioned; use replace_sectors or upsert_pieces")
    spark = df.sparkSession
    path = version_path(spark, database, name)
    conform(df, name).write.parquet(path)
    spark.sql(f"ALTER TABLE {database}.{name} SET LOCATION '{path}'")
    spark.catalog.refreshTable(f"{database}.{name}")


def upsert_pieces(updates: DataFrame, rows: int, database: str, name: str) -> list[str]:
    """Replace rows by key and add new ones, rewriting only the pieces that hold a replaced key (M3).

    ``updates``: stored rows with unique keys, ``rows`` of them, free of changes while this runs.
    Every key lies in one piece, a partition of the table. The pieces to rewrite are found from keys alone; a new
    version of each is written beside the table, and its catalog entry moves there when all are
    complete. A reader therefore sees each row once, old or new, and a run that stopped is put right by repeating it. New
    keys become pieces of their own and touch no stored file. Returns the rewritten pieces.
    """
    spark, keys, part = updates.sparkSession, PIECEWISE[name], PARTITIONED[name]
    target = spark.table(f"{database}.{name}")
    updates = conform(updates, name).drop(part)
    path = version_path(spark, database, name)
    held_path = f"{path}/held"
    target.select(*keys, part).join(updates.select(*keys), keys).write.parquet(held_path)
    held = spark.read.schema(target.select(*keys, part).schema).parquet(held_path)
    touched = sorted(r[0] for r in held.select(part).distinct().collect())  # names of pieces, which the catalog lists too
    if touched:
        kept = target.where(F.col(part).isin(touched)).join(held, keys, "left_anti")
        changed = updates.join(held, keys)
        rows_of_pieces = conform(kept.unionByName(changed), name).hint("rebalance", part)
        rows_of_pieces.write.partitionBy(part).parquet(f"{path}/pieces")
        for piece in touched:
            spark.sql(f"ALTER TABLE {database}.{name} PARTITION ({part} = '{piece}') SET LOCATION '{path}/pieces/{part}={piece}'")
        spark.catalog.refreshTable(f"{database}.{name}")
    run, pieces = uuid.uuid4().hex, -(-rows // PIECE_ROWS) or 1
    piece = F.concat(F.lit(f"{run}-"), F.pmod(F.xxhash64(*keys), F.lit(pieces)).cast("string"))
    append(updates.join(held, keys, "left_anti").withColumn(part, piece), database, name)
    return touched


def replace_sectors(df: DataFrame, database: str, name: str, path: str) -> None:
    """Overwrite only the sector partitions present in ``df`` (M4 at scale).

    The rows are written to ``path`` first, because a table cannot be
    overwritten while it is read.
    """
    spark = df.sparkSession
    conform(df, name).write.mode("overwrite").parquet(path)
    staged = balanced(spark.read.parquet(path), name)
    staged.write.option("partitionOverwriteMode", "dynamic").insertInto(f"{database}.{name}", overwrite=True)
