"""Record layouts shared by the readers, the extraction job and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Closed sets of the posting model.
JOB_TYPES = [
    "full_time", "part_time", "contract", "temporary", "internship", "freelance", "volunteer",
]
EXPERIENCE_LEVELS = [
    "entry_level", "associate", "mid_level", "senior_level", "director", "executive",
    "internship", "not_applicable",
]
WORK_ARRANGEMENTS = ["on_site", "remote", "hybrid"]

ENUM_FIELDS = {
    "job_type": JOB_TYPES,
    "experience_level": EXPERIENCE_LEVELS,
    "work_arrangement": WORK_ARRANGEMENTS,
}
REQUIRED_FIELDS = ["job_id", "title", "company"]

# The posting's fields in order, with type and default.
# "text" = string, default ''; "text?" = nullable string; likewise for the others.
_FIELDS = """
job_id text
title text
company text
description text
summary text
location text
city text
state text
country text
work_arrangement text?
remote_work_option flag
hybrid_option flag
publish_date text?
application_deadline text?
start_date text?
scraped_date text?
job_type text?
experience_level text?
department text
team text
division text
salary_min number?
salary_max number?
salary_currency currency
hourly_rate_min number?
hourly_rate_max number?
benefits list
pay_benefit text
equity_compensation flag
required_skills list
preferred_skills list
minimum_qualifications list
preferred_qualifications list
education_requirements list
experience_requirements list
certifications list
languages list
application_url text
contact_email text
contact_person text
application_instructions text
company_size text
industry text
company_website text
company_description text
work_schedule text
visa_sponsorship flag?
security_clearance_required flag?
travel_required text?
relocation_assistance flag?
source_url text
source_platform text
metadata map
"""
FIELD_KINDS = dict(line.split() for line in _FIELDS.strip().splitlines())

_TYPES = {
    "text": T.StringType(),
    "currency": T.StringType(),
    "flag": T.BooleanType(),
    "number": T.DoubleType(),
    "list": T.ArrayType(T.StringType()),
    "map": T.MapType(T.StringType(), T.StringType()),
}
POSTING_SCHEMA = T.StructType(
    [T.StructField(name, _TYPES[kind.rstrip("?")]) for name, kind in FIELD_KINDS.items()]
)

LISTING_ROW = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "url", "title", "location", "department", "job_type", "posted_date", "company",
            "source_url",
        )
    ]
    + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
LISTING_SCHEMA = T.StructType(
    [
        T.StructField("source_url", T.StringType()),
        T.StructField("total_jobs", T.LongType()),
        T.StructField("extraction_timestamp", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("total_pages_crawled", T.LongType()),
        T.StructField("total_pages_attempted", T.StringType()),
        T.StructField("jobs", T.ArrayType(LISTING_ROW)),
    ]
)


def field_default(name: str) -> Column:
    """The value a posting field takes when nothing was extracted for it."""
    kind = FIELD_KINDS[name]
    if kind == "list":
        return F.array().cast("array<string>")
    if kind == "map":
        return F.create_map().cast("map<string,string>")
    literal = {"text": "", "currency": "USD", "flag": False}.get(kind)
    return F.lit(literal).cast(POSTING_SCHEMA[name].dataType)


def enum_or_null(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(allowed), value)


def conform_postings(df: DataFrame, *keep: str) -> DataFrame:
    """Give a frame the full posting layout.

    Unknown columns are dropped (but for ``keep``), absent or null ones take their
    default, values outside a closed set become null.
    """
    present, columns = set(df.columns), []
    for name, kind in FIELD_KINDS.items():
        if name not in present:
            columns.append(field_default(name).alias(name))
            continue
        value = F.col(name).cast(POSTING_SCHEMA[name].dataType)
        if name in ENUM_FIELDS:
            value = enum_or_null(value, ENUM_FIELDS[name])
        elif not kind.endswith("?") and name not in REQUIRED_FIELDS:
            value = F.coalesce(value, field_default(name))
        columns.append(value.alias(name))
    return df.select(*keep, *columns)


def postings_from_json(df: DataFrame, json_column: str, *keep: str) -> DataFrame:
    """One JSON object per row to posting rows; ``valid`` is false without key fields.

    A generator over the one parsed value keeps later filters from parsing it again.
    """
    parsed = df.select(*keep, F.inline_outer(F.array(F.from_json(json_column, POSTING_SCHEMA))))
    complete = F.lit(True)
    for name in REQUIRED_FIELDS:
        complete = complete & F.col(name).isNotNull()
    return conform_postings(parsed, *keep).withColumn("valid", complete)
