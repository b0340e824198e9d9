"""Continuous load: micro-batches of scraped records into the article table (ST2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from newswatch.operators.load import delta_filter, rows_to_insert, with_load_config
from newswatch.operators.validate import MIN_TITLE_LENGTH, usable
from newswatch.session import use_state_store

LOADED = (
    "company_name string, id string, source_url string, url string, title string, article_content string, "
    "published_date timestamp_ntz, s_created_ts string, response_time_ms double, seq bigint, load_type string, "
    "industry_sector string"
)

BUCKETS = 4096  # groups of urls that share a call; state is kept per url
URL = StructType([StructField("url", StringType())])
HOLDERS = StructType([StructField("companies", StringType())])


def stored(spark: SparkSession, path: str, schema: str = LOADED) -> DataFrame:
    """The table at a path; a path without data reads as an empty table."""
    empty = spark.createDataFrame([], schema)
    try:
        return spark.read.schema(empty.schema).parquet(path)
    except Exception as error:  # noqa: BLE001 - only a missing path is an empty table
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise


class FirstArrivals(StatefulProcessor):
    """State per url: the companies that had it stored before the stream began, nothing once it has arrived."""

    def init(self, handle) -> None:
        self.met = handle.getMapState("met", URL, HOLDERS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for url, companies in initialState.groupby("url")["company_name"]:
            known = self.met.getValue((url,)) if self.met.containsKey((url,)) else ("",)
            self.met.updateValue((url,), ("\n".join(filter(None, [known[0], *companies])),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:  # at most one row per url is held
            both = chunk if first is None else pd.concat([first, chunk], ignore_index=True)
            order = both.sort_values(["seq", "company_name", "id"], kind="stable", na_position="first")
            first = order.drop_duplicates("url")
        new = []
        for url, company in zip(first["url"], first["company_name"], strict=True):
            held = self.met.getValue((url,))[0].split("\n") if self.met.containsKey((url,)) else None
            new.append(held is None or (held != [""] and company not in held))
            if held != [""]:
                self.met.updateValue((url,), ("",))
        yield first[new].drop(columns="bucket")

    def close(self) -> None:
        pass


def first_arrivals(records: DataFrame, target: DataFrame, min_title_length: int = MIN_TITLE_LENGTH) -> DataFrame:
    """Of a stream of records the first valid one of each url, of whatever company.

    A url is looked up in the state store, so what a micro-batch costs does not grow with what has
    been loaded before. The stored rows of ``target`` are read once, when the stream begins.
    """
    bucket = F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).alias("bucket")
    known = target.select(bucket, "url", "company_name").distinct()
    valid = usable(records, min_title_length)
    return (
        valid.select("*", bucket)
        .groupBy("bucket")
        .transformWithStateInPandas(FirstArrivals(), valid.schema, "append", "none", known.groupBy("bucket"))
    )


def load_batch(batch: DataFrame, path: str, config: DataFrame, cutoffs: DataFrame, again: bool) -> None:
    """Store the due rows of one micro-batch of first arrivals (F2, M1).

    Only a batch that may have been stored before (``again``) is compared with the table.
    """
    due = delta_filter(with_load_config(batch, config), cutoffs)
    if again:
        due = rows_to_insert(due, stored(batch.sparkSession, path))
    due.write.mode("append").partitionBy("industry_sector").parquet(path)


def loader(path: str, config: DataFrame, cutoffs: DataFrame) -> Callable[[DataFrame, int], None]:
    """The writer of one run of the stream: only the first batch after a start can be one that was stored before."""
    state = {"again": True}

    def load(batch: DataFrame, _: int) -> None:
        load_batch(batch, path, config, cutoffs, state["again"])
        state["again"] = False

    return load


def continuous_load(
    records: DataFrame, path: str, checkpoint: str, config: DataFrame, cutoffs: DataFrame, once: bool = False
) -> StreamingQuery:
    """Start the load of a record stream; ``once`` takes what is there and stops.

    A url belongs to its first valid arrival, of whatever company and batch, also when that one was not
    due, so where the stream is cut into batches changes nothing.
    """
    spark = records.sparkSession
    use_state_store(spark)
    arrivals = first_arrivals(records, stored(spark, path))
    writer = arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(loader(path, config, cutoffs))
    return (writer.trigger(availableNow=True) if once else writer).start()
