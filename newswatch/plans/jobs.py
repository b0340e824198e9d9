"""Composite jobs over the stored tables: load, enrich, purge, publish."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newswatch.functions.text import strip
from newswatch.operators import enrich as enrichment
from newswatch.operators import extract, load, report, robots, tables, warehouse
from newswatch.operators.validate import MIN_TITLE_LENGTH, validate
from newswatch.session import scratch_path
from newswatch.sources import registry


MESSAGE_CHARS = 500  # of an error that is kept with a company's run


@dataclass(frozen=True)
class Warehouse:
    """The stored tables of one catalog database."""

    spark: SparkSession
    database: str

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        tables.append(rows, self.database, name)

    def replace(self, name: str, rows: DataFrame) -> None:
        tables.replace(rows, self.database, name)

    def upsert(self, name: str, rows: DataFrame, count: int) -> list[str]:
        return tables.upsert_pieces(rows, count, self.database, name)


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def crawl(
    wh: Warehouse, snapshots: DataFrame, robots_files: DataFrame, flow_name: str, user_agent: str, fetched_at,
    max_items: int = extract.MAX_ITEMS,
) -> tuple[DataFrame, DataFrame]:
    """Records and fetch log of all sources from stored pages.

    Pages are looked up once per kind of visit; links and embedded items come from one pass over each page.
    """
    sources = registry.source_urls(wh["load_sources"])
    first = written(extract.first_visits(sources, snapshots, robots.site_rules(robots_files, user_agent)), "listings")
    reads = written(_reads(first), "listing-reads")
    extra = written(extract.extra_visits(first, extract.anchors_of(reads), snapshots), "extra-listings")
    reads = reads.unionByName(written(_reads(extra), "extra-reads")).dropDuplicates(["url"])
    listings = first.unionByName(extra)
    opened = listings.where("fetched")
    pages = opened.select("company_name", "source_url", "page_no", F.col("url").alias("page_url"))
    html = opened.select("url", F.col("text").alias("html"))
    config = registry.active_config(wh["load_config"], flow_name)
    cutoffs = delta_cutoffs(wh, config, flow_name)
    chosen = extract.chosen_candidates(extract.candidates(pages, html, max_items, reads), cutoffs, max_items)
    articles = written(extract.article_visits(chosen, snapshots), "articles")
    return extract.records(articles, fetched_at), extract.visit_log(listings, articles)


def _reads(visits: DataFrame) -> DataFrame:
    opened = visits.where("fetched").select("url", F.col("text").alias("html"))
    return extract.page_reads(opened.dropDuplicates(["url"]))


def delta_cutoffs(wh: Warehouse, config: DataFrame, flow_name: str) -> DataFrame:
    """Cutoffs of the companies that load incrementally."""
    delta = config.where("load_type = 'DELTA'").select("company_name")
    return load.last_success(wh["load_monitoring"], flow_name).join(delta, "company_name", "left_semi")


def load_run(
    wh: Warehouse, records: DataFrame, log: DataFrame, flow_name: str, run_id: str, ended_at,
    min_title_length: int = MIN_TITLE_LENGTH, export_path: str | None = None,
) -> int:
    """One load of all companies (C2); 1 when a company failed, else 0.

    Companies are stored together; where that fails, halves of them are tried, until the ones
    that cannot be stored are found. Those are recorded as failed with the message, all others are loaded. All decisions are made on rows without bodies, which are written once. Bodies move
    once, to the rows that are inserted. A run that is repeated after it stopped
    between its appends adds what is missing and nothing twice: articles and
    bodies are each compared with what is stored of them.
    """
    config = registry.active_config(wh["load_config"], flow_name)
    validated = written(validate(records.drop("article_content"), min_title_length), "validated")
    due = load.delta_filter(
        load.with_load_config(validated, config), load.last_success(wh["load_monitoring"], flow_name)
    )
    new = written(load.rows_to_insert(due, wh["articles"]), "new-rows")
    inserted = new.groupBy("company_name").agg(F.count("*").alias("records_inserted"))
    companies = registry.source_urls(wh["load_sources"]).select("company_name")
    metrics = load.monitoring_metrics(companies, due, load.fetch_metrics(log))
    stamped = new.withColumn("s_created_ts", F.coalesce(load.parse_utc(F.col("s_created_ts")), load.moment(ended_at)))
    bodies = new.join(_bodies(records), ["url", "seq"]).where("article_content IS NOT NULL")
    bodies = bodies.withColumn("content_hash", enrichment.body_hash(F.col("article_content")))
    names = sorted((r.company_name for r in inserted.select("company_name").collect()), key=str)  # one name per company
    errors = wh.spark.createDataFrame(list(_stored(wh, stamped, bodies, names).items()), "company_name string, write_error string")
    rows = load.monitoring_rows(metrics, config, inserted, flow_name, run_id, ended_at, errors)
    rows = written(rows, "monitoring")
    wh.append("load_monitoring", rows)
    wh.replace("load_config", load.switch_to_delta(wh["load_config"], rows.where("run_status = 'SUCCESS'"), flow_name))
    if export_path:
        export_csv(validated.join(_bodies(records), ["url", "seq"], "left"), export_path)
    return 0 if rows.where("run_status <> 'SUCCESS'").isEmpty() else 1


def _stored(wh: Warehouse, articles: DataFrame, bodies: DataFrame, names: list[str]) -> dict[str, str]:
    """Append the rows of the companies; the message for each that could not be stored.

    An append that fails leaves nothing of itself; bodies stored before their articles failed are
    known by key, so they are not stored again.
    """
    if not names:
        return {}
    keys = ["industry_sector", "company_name", "url"]
    own = F.col("company_name").isin(names)
    try:
        wh.append("article_bodies", bodies.where(own).join(wh["article_bodies"].select(*keys), keys, "left_anti"))
        wh.append("articles", articles.where(own).join(wh["articles"].select(*keys), keys, "left_anti"))
    except (PySparkException, Py4JError) as error:  # a write that Spark gives up
        if len(names) == 1:
            return {names[0]: str(error).strip().split("\n")[0][:MESSAGE_CHARS]}
        half = len(names) // 2
        return _stored(wh, articles, bodies, names[:half]) | _stored(wh, articles, bodies, names[half:])
    return {}


def _bodies(records: DataFrame) -> DataFrame:
    """Bodies by the url as validation writes it and the arrival."""
    return records.select(strip(F.coalesce("url", F.lit(""))).alias("url"), "seq", "article_content")


def export_csv(validated: DataFrame, path: str) -> None:
    """Validated rows as CSV files with a header (M8)."""
    flat = validated.withColumn("seq", F.col("seq").cast("string"))
    flat.drop("seq").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def enrich_run(wh: Warehouse, as_of, purge: bool = True, **options) -> tuple[int, int]:
    """Summarise what is due and purge summarised bodies (E6, M3, M4): (summaries written, bodies purged).

    What is due is decided on the hashes kept beside the bodies. Only due articles fetch their
    body, from the sectors that have any; with nothing due no body is read and no table rewritten.
    """
    keys = ["industry_sector", "company_name", "url"]
    eligible = warehouse.without_excluded(wh["articles"].join(_hashes(wh["article_bodies"]), keys), wh["title_exclusion"])
    choice = {k: options.pop(k) for k in ("company", "limit") if k in options}
    target = options.get("target_model") if options.get("summarizer") else None
    due = written(enrichment.due_articles(eligible, wh["article_summary"], target, **choice), "due-articles")
    count = 0
    if not due.isEmpty():
        articles = tables.with_bodies(due.drop("content_hash"), wh["article_bodies"])
        fresh = written(enrichment.enrich(articles, wh["article_summary"], as_of, **options), "summaries")
        count = fresh.count()
        wh.upsert("article_summary", fresh, count)
    return count, purge_bodies(wh) if purge else 0


def _hashes(bodies: DataFrame) -> DataFrame:
    """Keys and content hashes; only rows stored without a hash have their body read."""
    keys = ["industry_sector", "company_name", "url"]
    known = bodies.where("content_hash IS NOT NULL").select(*keys, "content_hash")
    unknown = bodies.where("content_hash IS NULL AND article_content IS NOT NULL")
    return known.unionByName(unknown.select(*keys, enrichment.body_hash(F.col("article_content")).alias("content_hash")))


def purge_bodies(wh: Warehouse) -> int:
    """Drop bodies of summarised articles; only sectors that lose a body are rewritten (M4)."""
    bodies, summaries = wh["article_bodies"], wh["article_summary"]
    keys = ["industry_sector", "company_name", "url"]
    held = bodies.where("content_hash <> ''").select("id", *keys).join(tables.summarized(summaries), "id", "left_semi")
    unknown = tables.bodies_to_purge(bodies.where("content_hash IS NULL"), summaries)
    gone = written(held.select(*keys).unionByName(unknown.select(*keys)), "purged")
    count = gone.count()
    if count:
        # the body stays as NULL, so that a sector without bodies is still overwritten
        mark = gone.withColumn("purged", F.lit(True))
        touched = bodies.join(gone.select("industry_sector").distinct(), "industry_sector", "left_semi")
        kept = touched.join(mark, keys, "left").withColumns(
            {
                "article_content": F.when(F.col("purged").isNull(), F.col("article_content")),
                "content_hash": F.when(F.col("purged").isNull(), F.col("content_hash")).otherwise(F.lit("")),
            }
        )
        tables.replace_sectors(kept, wh.database, "article_bodies", scratch_path(wh.spark, "bodies"))
    return count


def publish(wh: Warehouse, as_of, folder: str, stamp: str) -> dict[str, int]:
    """All report sheets as datasets under a stamp, which ``latest`` then names; rows per sheet (M9).

    The base view is written once and feeds every sheet; a sheet's rows are counted while it is written.
    """
    base = written(warehouse.news_all(wh["articles"], wh["article_summary"], wh["title_exclusion"]), "news")
    counts = {}
    for name, sheet in report.report_sheets(base, as_of).items():
        seen = Observation(name)
        sheet.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{stamp}/{name}")
        counts[name] = seen.get["n"]
    wh.spark.range(1).select(F.lit(stamp).alias("stamp")).write.mode("overwrite").parquet(f"{folder}/latest")
    return counts


def latest_sheet(wh: Warehouse, folder: str, name: str) -> DataFrame:
    """A sheet of the last publication; ``latest`` names its stamp, so no sheet is stored twice."""
    stamp = wh.spark.read.parquet(f"{folder}/latest").first().stamp
    return wh.spark.read.parquet(f"{folder}/{stamp}/{name}")
