"""The stored warehouse end to end: load, reload, failure, enrich, purge, publish."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newswatch.functions.text import moment
from newswatch.operators import enrich, tables
from newswatch.plans import jobs
from newswatch.plans.jobs import Warehouse
from newswatch.schemas import RECORD
from newswatch.session import shared_dir

FLOW = "NEWS_FLOW"
BODY = "The company announced a trial result. Patients in France did well. More follows here."


def record(n, company="ACME", day="2026-04-20", url=None, title="A title that is long enough", body=BODY):
    return (company, f"id{n}", "https://acme.com/news", url or f"https://acme.com/news/{n}", title, body, day, "2026-04-21T00:00:00+00:00", 8.0, n)


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def log(spark, rows):
    return spark.createDataFrame(rows, "company_name string, attempted boolean, fetched boolean, parsed boolean, response_time_ms double")


@pytest.fixture(scope="module")
def wh(spark):
    tables.create_tables(spark, "newsdb")
    tables.create_tables(spark, "newsdb")  # creating again changes nothing
    warehouse = Warehouse(spark, "newsdb")
    stamp = "2026-01-01 00:00:00"
    sources = [("ACME", "banking", "https://acme.com/news"), ("BROKEN", "banking", "https://broken.com/")]
    warehouse.append("load_sources", spark.createDataFrame(sources, "company_name string, industry_sector string, source_1 string"))
    config = [(FLOW, "ACME", "FULL", "Y", "BANKING", ["a", "b"]), ("OTHER", "ACME", "FULL", "Y", "BANKING", ["c"])]
    rows = spark.createDataFrame(
        config, "flow_name string, company_name string, load_type string, active_flag string, industry_sector string, selectors array<string>"
    )
    warehouse.append("load_config", rows.withColumn("s_created_ts", moment(stamp)))
    return warehouse


def test_the_whole_cycle(spark, wh, tmp_path):
    ok = [("ACME", True, True, True, 8.0), ("BROKEN", True, False, False, 4.0)]
    first = records(spark, [record(1), record(2), record(3, url="https://acme.com/news/1", title="The copy loses, later"), record(4, title="short")])
    code = jobs.load_run(wh, first, log(spark, ok), FLOW, "run-1", "2026-04-21 12:00:00", export_path=str(tmp_path / "csv"))
    assert code == 1  # BROKEN had an error and no row
    assert {r.id for r in wh["articles"].collect()} == {"id1", "id2"}
    runs = {r.company_name: r for r in wh["load_monitoring"].collect()}
    assert (runs["ACME"].run_status, runs["ACME"].records_inserted, runs["ACME"].target_schema) == ("SUCCESS", 2, "stg_banking")
    assert (runs["BROKEN"].run_status, runs["BROKEN"].load_type, runs["BROKEN"].target_schema) == ("FAILURE", "FULL", "stg_lifescience")
    config = {r.flow_name: r for r in wh["load_config"].collect()}
    assert (config[FLOW].load_type, config["OTHER"].load_type) == ("DELTA", "FULL")
    assert config[FLOW].selectors == ["a", "b"] and config[FLOW].s_created_ts == datetime(2026, 1, 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2

    # second run is incremental: old and equal dates dropped, undated and newer kept, known urls not changed
    second = records(
        spark,
        [
            record(5, day="2026-04-21T12:00:00+00:00"),
            record(6, day="2026-04-21T12:00:01+00:00"),
            record(7, day=None),
            record(8, day="unreadable"),
            record(9, url="https://acme.com/news/2", day=None, title="Another title, same url"),
        ],
    )
    for run in ("run-2", "run-2-again"):
        code = jobs.load_run(wh, second, log(spark, ok[:1]), FLOW, run, "2026-04-22 12:00:00" if run == "run-2" else "2026-04-20 12:00:00")
        assert code == 0
    assert {r.id for r in wh["articles"].collect()} == {"id1", "id2", "id6", "id7", "id8"}
    assert wh["articles"].where("id = 'id2'").head().title == "A title that is long enough"
    inserted = {r.run_id: r.records_inserted for r in wh["load_monitoring"].where("company_name = 'ACME'").collect()}
    assert inserted == {"run-1": 2, "run-2": 3, "run-2-again": 0}
    assert "article_content" not in wh["articles"].columns

    # enrich and purge, with one excluded article
    wh.append("title_exclusion", spark.createDataFrame([("ACME", "id1", "x")], "company_name string, id string, title string"))
    assert jobs.enrich_run(wh, "2026-04-23 00:00:00", purge=False) == (4, 0)
    assert jobs.enrich_run(wh, "2026-04-24 00:00:00") == (0, 4)
    assert jobs.enrich_run(wh, "2026-04-25 00:00:00") == (0, 0)
    left = tables.with_bodies(wh["articles"], wh["article_bodies"]).where("article_content IS NOT NULL")
    assert [r.id for r in left.collect()] == ["id1"]
    summary = wh["article_summary"].where("article_id = 'id2'").head()
    assert summary.key_topic == summary.signal_type == "clinical" and summary.geography == "France"
    assert summary.article_summary == "The company announced a trial result. Patients in France did well."

    counts = jobs.publish(wh, "2026-04-25 00:00:00", str(tmp_path / "report"), "20260425T000000Z")
    assert counts["news_all"] == 4 and counts["dea_kpis"] == 6 and counts["overview"] == 5
    assert jobs.latest_sheet(wh, str(tmp_path / "report"), "news_all").count() == 4
    assert len(counts) == 15


def test_replace_keeps_readers_and_partition_pruning(spark, wh):
    pruned = wh["articles"].where("industry_sector = 'BANKING' AND published_date >= TIMESTAMP_NTZ '2026-01-01 00:00:00'").select("id")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(industry_sector" in plan
    assert "GreaterThanOrEqual(published_date" in plan
    assert "ReadSchema: struct<id:string,published_date:timestamp_ntz>" in plan


def test_model_hook_replies_errors_and_refresh(spark):
    articles = spark.createDataFrame(
        [(str(i), "Acme", f"https://a/{i}", f"Title {i}", BODY + f" {i}") for i in range(6)],
        "id string, company_name string, url string, title string, article_content string",
    )
    tag = enrich.model_tag("local", "m")
    assert tag == "local:m:nw-v1"

    def summarizer(prompts):
        out = []
        for p in prompts:
            n = p.rsplit(" ", 1)[1]
            if n == "1":
                raise ValueError("model is down")
            out.append({"2": "no json", "3": 'x {"article_summary": " ", "key_topic": "a"}'}.get(n, f'ok {{"article_summary": "S{n}", "key_topic": " "}}'))
        return out

    empty = spark.createDataFrame([], "article_id string, content_hash string, summary_status string, summary_model string")
    done = enrich.enrich(articles, empty, "2026-01-01 00:00:00", summarizer, tag)
    rows = {r.article_id: r for r in done.collect()}
    assert set(rows) == {"0", "1", "2", "4", "5"}  # an empty summary is dropped
    assert (rows["0"].article_summary, rows["0"].key_topic, rows["0"].summary_status, rows["0"].summary_model) == ("S0", None, "ai", tag)
    assert (rows["1"].summary_status, rows["1"].error_message, rows["1"].key_topic) == ("fallback", "model is down", "clinical")
    assert rows["2"].summary_status == "fallback" and rows["2"].error_message
    again = enrich.enrich(articles, done.select(*empty.columns), "2026-01-02 00:00:00", summarizer, tag)
    assert {r.article_id for r in again.collect()} == {"1", "2"}  # only fallbacks are asked again (3 drops out again)
    rules = enrich.enrich(articles, done.select(*empty.columns), "2026-01-02 00:00:00")
    assert {r.article_id for r in rules.collect()} == {"3"}
    assert enrich.enrich(articles, empty, "2026-01-02 00:00:00", company=" acme ", limit=2).count() == 2


def test_partial_upsert(spark):
    target = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "k string, v int, kept int")
    changes = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("c", 9, 1)], "k string, v int, n int")
    out = tables.upsert_columns(target, tables.last_per_key(changes, ["k"], "n"), ["k"], moment("2026-01-01"))
    assert sorted(tuple(r) for r in out.collect() if r.kept) == [("a", 7, 1), ("b", 2, 2)]
    assert [r.v for r in out.where(F.col("k") == "c").collect()] == [9]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) == named.rstrip("/")


def summaries(spark, ids, text):
    rows = [(i, f"{text} {i}", "2026-01-01") for i in ids]
    return spark.createDataFrame(rows, "article_id string, article_summary string, content_hash string")


def test_an_upsert_rewrites_only_pieces_with_a_replaced_key(spark, monkeypatch):
    tables.create_tables(spark, "piecedb")
    wh = Warehouse(spark, "piecedb")
    monkeypatch.setattr(tables, "PIECE_ROWS", 10)
    files = lambda: set(wh["article_summary"].inputFiles())
    first = [f"a{k}" for k in range(40)]
    assert wh.upsert("article_summary", summaries(spark, first, "one"), 40) == []
    assert wh["article_summary"].select("part").distinct().count() == 4
    before = files()
    assert wh.upsert("article_summary", summaries(spark, ["b1", "b2", None], "two"), 3) == []
    assert before < files()  # new keys touch no stored file
    before = files()
    reader = wh["article_summary"].where("article_id = 'a7'")
    assert reader.head().article_summary == "one a7"
    piece = reader.head().part
    assert wh.upsert("article_summary", summaries(spark, ["a7", "c1"], "three"), 2) == [piece]
    gone = before - files()
    assert gone and all(f"part={piece}/" in f for f in gone)
    got = {r.article_id: r.article_summary for r in wh["article_summary"].where("article_id IS NOT NULL").collect()}
    want = {i: f"one {i}" for i in first} | {"b1": "two b1", "b2": "two b2", "a7": "three a7", "c1": "three c1"}
    assert got == want and wh["article_summary"].count() == len(want) + 1
    assert wh["article_summary"].where("article_id = 'a7'").head().part == piece
    assert wh.upsert("article_summary", summaries(spark, [], "none"), 0) == []
    # pieces moved once are found and moved again; one run may touch many
    touched = wh.upsert("article_summary", summaries(spark, first, "four"), 40)
    assert len(touched) == 4 and piece in touched
    rows = wh["article_summary"].where("article_summary LIKE 'four%'")
    assert rows.count() == 40 and wh["article_summary"].count() == len(want) + 1


def test_an_upsert_that_stopped_before_its_new_keys_is_repeated(spark, monkeypatch):
    tables.create_tables(spark, "halfdb")
    wh = Warehouse(spark, "halfdb")
    wh.upsert("article_summary", summaries(spark, ["a", "b"], "old"), 2)
    append = tables.append

    def stops(*args):
        raise RuntimeError("stopped")

    monkeypatch.setattr(tables, "append", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        wh.upsert("article_summary", summaries(spark, ["a", "c"], "new"), 2)
    texts = lambda: sorted(r.article_summary for r in wh["article_summary"].collect())
    assert texts() == ["new a", "old b"]
    monkeypatch.setattr(tables, "append", append)
    wh.upsert("article_summary", summaries(spark, ["a", "c"], "new"), 2)
    assert texts() == ["new a", "new c", "old b"]


class Interrupted(Warehouse):
    """Stops at its second append, as if the driver died between bodies and articles."""

    def append(self, name, rows):
        if name == "articles":
            raise RuntimeError("stopped")
        super().append(name, rows)


def test_a_load_that_stopped_between_its_appends_is_repeated(spark):
    tables.create_tables(spark, "stopdb")
    wh = Warehouse(spark, "stopdb")
    wh.append("load_sources", spark.createDataFrame([("ACME", "banking", "https://acme.com/")], "company_name string, industry_sector string, source_1 string"))
    rows, fetched = records(spark, [record(1), record(2)]), log(spark, [("ACME", True, True, True, 8.0)])
    with pytest.raises(RuntimeError, match="stopped"):
        jobs.load_run(Interrupted(spark, "stopdb"), rows, fetched, FLOW, "run-1", "2026-04-21 12:00:00")
    assert (wh["articles"].count(), wh["article_bodies"].count()) == (0, 2)
    for run in ("run-1", "run-2"):
        assert jobs.load_run(wh, rows, fetched, FLOW, run, "2026-04-21 12:00:00") == 0
    assert (wh["articles"].count(), wh["article_bodies"].count()) == (2, 2)
    assert tables.with_bodies(wh["articles"], wh["article_bodies"]).count() == 2


class Broken(Warehouse):
    """Cannot store articles of one company: the tasks that write them fail."""

    def append(self, name, rows):
        if name == "articles":
            fails = F.raise_error(F.lit("no room for SECOND"))
            rows = rows.withColumn("title", F.when(F.col("company_name") == "SECOND", fails).otherwise(F.col("title")))
        super().append(name, rows)


def test_a_company_that_cannot_be_stored_leaves_the_others_loaded(spark):
    tables.create_tables(spark, "brokendb")
    wh = Warehouse(spark, "brokendb")
    names = ["FIRST", "SECOND", "THIRD"]
    wh.append("load_sources", spark.createDataFrame([(n, "banking", f"https://{n}.com/") for n in names], "company_name string, industry_sector string, source_1 string"))
    config = [(FLOW, n, "FULL", "Y", "BANKING") for n in names]
    wh.append("load_config", spark.createDataFrame(config, "flow_name string, company_name string, load_type string, active_flag string, industry_sector string"))
    rows = records(spark, [record(10 * k + j, company=n, url=f"https://{n}.com/{j}") for k, n in enumerate(names) for j in range(2)])
    fetched = log(spark, [(n, True, True, True, 8.0) for n in names])
    assert jobs.load_run(Broken(spark, "brokendb"), rows, fetched, FLOW, "run-1", "2026-04-21 12:00:00") == 1
    runs = {r.company_name: (r.run_status, r.run_message, r.records_inserted) for r in wh["load_monitoring"].collect()}
    done = ("SUCCESS", "Data loaded successfully", 2)
    status, message, inserted = runs.pop("SECOND")
    assert runs == {"FIRST": done, "THIRD": done} and (status, inserted) == ("FAILURE", 0)
    assert message and message != done[1] and "\n" not in message and len(message) <= jobs.MESSAGE_CHARS
    assert {r.company_name for r in wh["articles"].collect()} == {"FIRST", "THIRD"}
    assert {r.company_name: r.load_type for r in wh["load_config"].collect()} == {"FIRST": "DELTA", "SECOND": "FULL", "THIRD": "DELTA"}
    # the next run adds only what is missing
    assert jobs.load_run(wh, rows, fetched, FLOW, "run-2", "2026-04-21 12:00:00") == 0
    again = {r.company_name: r.records_inserted for r in wh["load_monitoring"].where("run_id = 'run-2'").collect()}
    assert again == {"FIRST": 0, "SECOND": 2, "THIRD": 0}
    assert (wh["articles"].count(), wh["article_bodies"].count()) == (6, 6)


def test_enrichment_reads_bodies_of_due_articles_only(spark, monkeypatch):
    tables.create_tables(spark, "duedb")
    wh = Warehouse(spark, "duedb")
    names = "id string, company_name string, url string, title string, industry_sector string"
    wh.append("articles", spark.createDataFrame([(f"a{k}", "ACME", f"https://a/{k}", "T", "S") for k in range(6)], names))
    bodies = [(f"a{k}", "ACME", f"https://a/{k}", BODY + str(k) if k < 5 else " ", "S") for k in range(6)]
    frame = spark.createDataFrame(bodies, "id string, company_name string, url string, article_content string, industry_sector string")
    hashed = frame.withColumn("content_hash", F.when(F.col("id") != "a0", enrich.body_hash(F.col("article_content"))))  # a0: stored before hashes were
    wh.append("article_bodies", hashed)
    fetched = []
    with_bodies = tables.with_bodies
    monkeypatch.setattr(tables, "with_bodies", lambda due, bodies: fetched.append(sorted(r.id for r in due.select("id").collect())) or with_bodies(due, bodies))
    assert jobs.enrich_run(wh, "2026-04-23 00:00:00", purge=False, limit=2) == (2, 0)
    assert jobs.enrich_run(wh, "2026-04-23 00:00:00", purge=False) == (3, 0)
    assert jobs.enrich_run(wh, "2026-04-24 00:00:00", purge=False) == (0, 0)
    assert fetched == [["a0", "a1"], ["a2", "a3", "a4"]]  # the last run fetched none
    plan = jobs._hashes(wh["article_bodies"])._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(content_hash)" in plan and plan.count("article_content:string") <= 1  # the known side reads hashes only
    assert jobs.enrich_run(wh, "2026-04-25 00:00:00") == (0, 5)
    assert jobs.enrich_run(wh, "2026-04-26 00:00:00") == (0, 0)
    assert {r.id for r in wh["article_bodies"].where("article_content IS NOT NULL").collect()} == {"a5"}
