"""Registered streaming queries: files as a stream, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newswatch.operators.load import last_success
from newswatch.session import scratch_path, use_state_store
from newswatch.sources import registry
from newswatch.sources.driver_tables import FLOW, adapted, adapted_stream
from newswatch.streaming.continuous_load import continuous_load
from newswatch.streaming.rate_limiter import SLICE_SECONDS, rate_limited


LIMITS = {"public": 3, "chat": 1}
CALL = "activity_id string, scope string, client_ip string, at_us bigint"
DAY = 86_400


def _calls(activity: DataFrame) -> DataFrame:
    return activity.select(
        "activity_id",
        F.when(F.col("activity_type") == "ai_chat", F.lit("chat")).otherwise(F.lit("public")).alias("scope"),
        "client_ip",
        F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), "created_ts").cast("timestamp")).alias("at_us"),
    )


def _run(limited: DataFrame, out: str) -> None:
    writer = limited.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint")
    writer.trigger(availableNow=True).start(out).awaitTermination()


def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "verdicts")
    use_state_store(spark)
    _run(rate_limited(_calls(adapted_stream(spark, sf_dir, "activity")), 3600, LIMITS), out)
    return spark.read.parquet(out)


def rate_limiter_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls, up to a day late and in two deliveries that are each in no order: the verdicts of the true order."""
    calls = _calls(adapted(spark, sf_dir, "activity"))
    arrival = F.col("at_us") + F.pmod(F.xxhash64("activity_id"), F.lit(DAY)) * 1_000_000
    first, last = calls.agg(F.min("at_us"), F.max("at_us")).first()
    middle = ((first or 0) + (last or 0)) // 2
    lateness = (last or 0) // 1_000_000 - middle // 1_000_000 + DAY + 1  # a delivery has no order of its own
    end = spark.range(1).select(
        *[F.lit(None).cast("string").alias(c) for c in ("activity_id", "scope", "client_ip")],
        F.lit((last or 0) + (lateness + SLICE_SECONDS + 1) * 1_000_000).alias("at_us"),  # a heartbeat
    )
    folder, out = scratch_path(spark, "deliveries"), scratch_path(spark, "late-verdicts")
    use_state_store(spark)
    for k, delivery in enumerate([calls.where(arrival < middle), calls.where(F.coalesce(arrival >= middle, F.lit(True))), end]):
        delivery.write.parquet(f"{folder}/{k}")
        stream = spark.readStream.schema(CALL).option("maxBytesPerTrigger", 4 * 1024**3).parquet(f"{folder}/*")
        _run(rate_limited(stream, 3600, LIMITS, lateness), out)
    return spark.read.parquet(out)


def loaded_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "loaded")
    config = registry.active_config(adapted(spark, sf_dir, "load_config"), FLOW)
    cutoffs = last_success(adapted(spark, sf_dir, "monitoring"), FLOW)
    records = adapted_stream(spark, sf_dir, "records")
    continuous_load(records, out, f"{out}-checkpoint", config, cutoffs, once=True).awaitTermination()
    columns = ["company_name", "id", "url", "title", "published_date", "load_type", "industry_sector"]
    return spark.read.parquet(out).select(*columns)


def queries() -> dict:
    return {"rate_limiter": rate_limiter, "rate_limiter_late": rate_limiter_late, "continuous_load": loaded_stream}
