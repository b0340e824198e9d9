"""Staging layouts: discovery, union, deduplication, legacy consolidation."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newswatch.functions.text import DEFAULT_SECTOR, label_from_name, staging_name
from newswatch.operators.warehouse import without_excluded
from newswatch.schemas import TABLES

STAGED = ["id", "url", "title", "published_date", "s_created_ts"]


def staging_tables(catalog: DataFrame) -> DataFrame:
    """Staging tables of a (schemaname, tablename) listing with their labels."""
    staged = catalog.where(F.col("schemaname").ilike("stg%") & F.col("tablename").ilike("stg%"))
    return staged.select(
        "schemaname",
        "tablename",
        label_from_name(F.col("tablename")).alias("company_name"),
        label_from_name(F.col("schemaname")).alias("industry_sector"),
    )


def catalog_listing(spark: SparkSession) -> DataFrame:
    """The session catalog as (schemaname, tablename) rows: names only, no data."""
    names = [(db.name, t.name) for db in spark.catalog.listDatabases() for t in spark.catalog.listTables(db.name)]
    return spark.createDataFrame(names, "schemaname string, tablename string")


def staged_tables(spark: SparkSession, with_body: bool = False) -> DataFrame:
    """Union of a table-per-company layout, labelled by table name."""
    columns = [*STAGED, "article_content"] if with_body else STAGED
    listing = staging_tables(catalog_listing(spark)).orderBy("schemaname", "tablename").collect()  # names only
    frames = [
        spark.table(f"`{row.schemaname}`.`{row.tablename}`").select(
            F.lit(row.company_name).alias("company_name"),
            F.lit(row.industry_sector).alias("industry_sector"),
            F.lit(row.schemaname).alias("schemaname"),
            F.lit(row.tablename).alias("tablename"),
            *columns,
        )
        for row in listing
    ]
    if not frames:
        kinds = {f.name: f.dataType for f in spark.createDataFrame([], TABLES["articles"] + ", article_content string").schema}
        names = ["company_name", "industry_sector", "schemaname", "tablename", *columns]
        return spark.range(0).select(*[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in names])
    return reduce(DataFrame.unionByName, frames)


def staged_layout(spark: SparkSession, folder: str, with_body: bool = False) -> DataFrame:
    """The same union over ``folder/<schema>/<table>/`` parquet files, in one scan.

    Labels come from each file's path (folders may be written as ``name=value``), so the plan is as large for
    many tables as for one. A folder that is missing or has no staging tables gives no rows.
    """
    columns = [*STAGED, "article_content"] if with_body else STAGED
    schema = spark.createDataFrame([], TABLES["articles"] + ", article_content string").schema
    schema = type(schema)([f for f in schema.fields if f.name in columns])
    try:
        files = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], schema).withColumn("_metadata", F.lit(None).cast("struct<file_path: string>"))
    parts = F.split("_metadata.file_path", "/")
    named = [F.regexp_replace(F.element_at(parts, k), "^[^=]*=", "") for k in (-3, -2)]
    rows = files.select(named[0].alias("schemaname"), named[1].alias("tablename"), *columns)
    staged = rows.where(F.col("schemaname").ilike("stg%") & F.col("tablename").ilike("stg%"))
    return staged.select(
        label_from_name(F.col("tablename")).alias("company_name"),
        label_from_name(F.col("schemaname")).alias("industry_sector"),
        "schemaname",
        "tablename",
        *columns,
    )


def staged_articles(articles: DataFrame) -> DataFrame:
    """The same union over the one partitioned article table: labels come from
    the staging names, bodies are not read (S8)."""
    return articles.select(
        label_from_name(staging_name(F.col("company_name"))).alias("company_name"),
        label_from_name(staging_name(F.col("industry_sector"))).alias("industry_sector"),
        staging_name(F.col("industry_sector")).alias("schemaname"),
        staging_name(F.col("company_name")).alias("tablename"),
        *STAGED,
    )


def first_by_id(staged: DataFrame) -> DataFrame:
    """One row per id, the first in (schema, table) order; NULL ids count as one.

    ``row_number() = 1`` keeps one row per id and task before the shuffle, so
    an id with a third of all rows stays small.
    """
    order = Window.partitionBy("id").orderBy("schemaname", "tablename", "url")
    return staged.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def eligible_articles(staged: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Deduplicated articles that are not excluded."""
    return without_excluded(first_by_id(staged), exclusions)


def legacy_articles(staged: DataFrame) -> DataFrame:
    """Rows of the old ``stg_ls_<company>`` schemas under the sector layout."""
    old = staged.where(F.col("schemaname").like("stg\\_ls\\_%") & F.col("tablename").like("stg\\_%"))
    company = F.upper(F.replace(F.regexp_replace("schemaname", "^stg_ls_", ""), F.lit("_"), F.lit(" ")))
    return old.withColumn("company_name", company).withColumn("industry_sector", F.lit(DEFAULT_SECTOR))
