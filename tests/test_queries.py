"""All registered queries against their SQL, and the shape of the plans that matter."""

import re

import pytest

import __spark_entry__ as entry
import oracle
from pyspark.sql import functions as F

from jobquarry.operators import dedup, downloads
from jobquarry.queries import ORACLE, QUERIES
from jobquarry.sources import readers

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)
    assert oracle.differences(spark, SMALL, lambda *_: df, ORACLE[name]) is None


def test_entry(spark):
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["extract_posting", "extraction_summary", "extract_links", "list_items", "required_present", "dedup_url", "embed_text"]
)
def test_python_runs_once(spark, name):
    assert plan(QUERIES[name](spark, SMALL)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["dedup_url", "process_urls", "topk_hits", "knn_search"])
def test_rows_are_limited_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert re.search(r"WindowGroupLimit .*Final[\s\S]*Exchange hashpartitioning[\s\S]*WindowGroupLimit .*Partial", text)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("knn_search", {"vec_id", "embedding"}),
        ("topk_hits", {"o_custkey", "o_orderkey", "o_totalprice"}),
        ("process_urls", {"page_id", "url"}),
        ("extract_skills", {"doc_id", "text"}),
        ("empty_page_runs", {"user_id", "event_id", "value"}),
    ],
)
def test_scans_read_only_what_is_used(spark, monkeypatch, name, columns):
    # With steps that are stored on the way planned as one.
    monkeypatch.setattr(dedup, "stored", lambda df, name: df)
    read = re.findall(r"ReadSchema: struct<(.*)>", plan(QUERIES[name](spark, SMALL)))
    assert {part.split(":")[0] for schema in read for part in re.split(r",(?![^<]*>)", schema)} == columns


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[.*In\(label", plan(QUERIES["filtered_knn"](spark, SMALL)))


@pytest.fixture
def small_joins_shuffle(spark):
    """Joins as they are on large tables: shuffled, with skew noticed from 64 KB on."""
    settings = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("operator", ["download_plan", "skip_existing", "latest_snapshot"])
def test_a_hot_key_is_split(spark, small_joins_shuffle, operator):
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    rows = spark.range(0, 200_000, 1, 8).select(
        hot.cast("string").alias("file_name"), F.sha2(F.col("id").cast("string"), 256).alias("url"), F.when(F.col("id") % 5 == 0, "6").otherwise("7").alias("day")
    )
    landed = rows.where(F.col("file_name").cast("long") % 2 == 1)
    result = {
        "download_plan": lambda: downloads.download_plan(rows, landed),
        "skip_existing": lambda: downloads.skip_existing(rows, landed),
        "latest_snapshot": lambda: readers.latest_snapshot(rows, "file_name", "day"),
    }[operator]()
    tail = result.columns[-1]
    counted = result.agg(F.count(F.lit(1)), F.max("url"), F.max(tail))
    left = counted.collect()[0][0]
    assert operator == "skip_existing" or left > 66_000
    assert "skew=true" in plan(counted)


def test_every_page_is_counted_by_its_own_html(spark, tmp_path):
    """Ids up to 5, null ids and every remainder by 5 keep their page and its text."""
    rows = [(i, f"https://h.org/{i}", f"<script>track({100 + (i or 0)})</script>") for i in (None, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)]
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    texts = {r.page_id: r.html for r in pages.where("page_id <= 10").select("page_id", "html").collect()}
    made = spark.createDataFrame([(i, u, texts[min(texts)] if i is None else texts.get(i, h)) for i, u, h in rows], "page_id long, url string, html string")
    made.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.page_count for r in QUERIES["detect_page_count_own_html"](spark, str(tmp_path)).collect()}
    want = {r.page_id: int(re.search(r"track\((\d+)\)", r.html)[1]) for r in made.collect() if "track(" in r.html}
    assert set(got) == {i for i, _, _ in rows}
    assert {i: got[i] for i in want} == want and len(want) >= 6
