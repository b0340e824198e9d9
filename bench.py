"""Time the headline queries: one JSON line, wall seconds per query, warm, median of three.

The tables with texts come as one row group each, which is one split. They are first
written as one file per core, as a stored table has many; nothing else is changed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from newswatch.plans import registry  # noqa: E402
from newswatch.session import build_session  # noqa: E402

HEADLINES = [
    "news_all",
    "company_intelligence",
    "kpi_overview",
    "topic_signal_heatmap",
    "feed_filtered",
    "merge_new",
    "extractive_summary",
    "topic_class",
    "structured_summary",
    "enrich_batch",
    "page_text",
    "crawl_records",
    "rate_audit",
]
RUNS = 3


def seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def prepared(spark, sf_dir: str, cpus: int) -> str:
    """The same tables, those with texts in ``cpus`` files."""
    folder = Path(tempfile.mkdtemp(prefix="bench-")) / Path(sf_dir).name
    folder.mkdir()
    for table in Path(sf_dir).glob("*.parquet"):
        if table.stem in ("documents", "pages"):
            spark.read.parquet(str(table)).repartition(cpus).write.parquet(str(folder / table.name))
        else:
            (folder / table.name).symlink_to(table)
    return str(folder)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "newswatch-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_DRIVER_MEMORY", "4g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = prepared(spark, sf_dir, int(cpus))
    queries = registry.queries()
    times = {}
    for name in HEADLINES:
        seconds(queries[name], spark, sf_dir)  # warm-up
        times[name] = round(statistics.median(seconds(queries[name], spark, sf_dir) for _ in range(RUNS)), 3)
    spark.stop()
    articles = registry.ARTICLES_PER_SF * float(Path(sf_dir).name.removeprefix("sf"))
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "seconds_per_article_enriched": round(times["enrich_batch"] / articles, 6),
            }
        )
    )


if __name__ == "__main__":
    main()
