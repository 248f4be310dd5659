"""What a pattern file's `error_handling` and `validation` do to extracted rows, and counting while writing."""

import pytest

from jobquarry.config import PatternConfig
from jobquarry.plans import process_urls as plan
from jobquarry.plans.process_pages import judge

ROWS = [("ok", None, "1", "A long title", "c"), ("ok", None, "x", "A long title", "c"), ("missing_required", None, "", "T", None), ("failed", "broken", None, None, None)]


def judged(spark, **handling):
    rules = {"job_id": [{"type": "numeric"}], "title": [{"type": "min_length", "value": 5}]}
    config = PatternConfig({"html_extraction": {"validation": rules, "error_handling": handling}})
    rows = spark.createDataFrame(ROWS, "status string, failure string, job_id string, title string, company string")
    return [(r.status, r.failure, r.job_id, r.company, r.violations) for r in judge(rows, config).collect()]


def test_by_default_rules_are_named_and_rows_without_a_key_rejected(spark):
    got = judged(spark)
    assert [r[0] for r in got] == ["ok", "ok", "missing_required", "failed"]
    assert [r[4] for r in got[:2]] == [[], ["job_id:numeric"]]


def test_defaults_and_skips(spark):
    got = judged(spark, missing_required_fields="use_default", invalid_fields="skip_record")
    assert got[1][:2] == ("invalid", "job_id:numeric") and got[3][:2] == ("failed", "broken")
    # The row without a key has its defaults, and then breaks the rules for them.
    assert got[2][0] == "invalid" and got[2][2:4] == ("", "")
    assert judged(spark, missing_required_fields="use_default")[2][0] == "ok"


@pytest.mark.parametrize("handling, match", [({"missing_required_fields": "raise_error"}, "lacks a key field"), ({"invalid_fields": "raise_error"}, "rules broken")])
def test_errors_end_the_job(spark, handling, match):
    with pytest.raises(Exception, match=match):
        judged(spark, **handling)


def test_unknown_reactions_are_refused(spark):
    with pytest.raises(ValueError, match="unknown reaction"):
        judged(spark, invalid_fields="use_default")


def test_listings_are_counted_while_they_are_written(spark, tmp_path):
    config = PatternConfig({"company_name": "c", "url_validation": {"valid_pattern": r"/(?P<job_id>\d*)$", "invalid_patterns": [], "extracted_fields": ["job_id"]}})
    urls = ["h/1", "h/2", "h/1", "h/", "h/", "bad", None]
    rows = spark.createDataFrame(list(enumerate(urls)), "pos int, url string").repartition(3)
    header = plan.run_process_urls(rows, config, str(tmp_path / "out"), "s", 2, "pos").first()
    stats = plan.processing_stats(rows, config).first()
    assert header.processing_stats.asDict() == stats.asDict() and header.processed_total_jobs == stats.final_count
    assert spark.read.json(str(tmp_path / "out" / "jobs")).count() == stats.final_count
    empty = plan.run_process_urls(rows.limit(0), config, str(tmp_path / "none"), "s", 0, "pos").first()
    assert empty.original_total_jobs == 0
