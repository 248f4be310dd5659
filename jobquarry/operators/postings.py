"""Detail pages to posting rows under a pattern file."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.config import PatternConfig
from jobquarry.functions import enrich
from jobquarry.functions.html import PageReader, Probe, probe
from jobquarry.functions.text import empty_to_null
from jobquarry.functions.urls import url_param
from jobquarry.schema import (
    EXPERIENCE_LEVELS,
    JOB_TYPES,
    WORK_ARRANGEMENTS,
    conform_postings,
)

# A page whose text has one of these is an error page.
ERROR_MARKS = [
    "Page not found", "Sorry, this role does not exist", "is no longer available",
    "page-not-found-wrapper",
]
NOW = "current_timestamp"
OK, ERROR_PAGE, MISSING_FIELDS, FAILED = "ok", "error_page", "missing_required", "failed"

# Where each single-value posting field is configured.
_RULES = {
    "job_id": "basic_info",
    "title": "basic_info",
    "company": "basic_info",
    "source_url": "basic_info",
    "source_platform": "basic_info",
    "publish_date": "time_info",
    "scraped_date": "time_info",
    "location": "location",
    "summary": "content",
    "description": "content",
    "required_qualifications": "content",
    "preferred_qualifications": "content",
    "pay_benefit": "content",
    "team": "team_info",
    "department": "team_info",
    "application_url": "application",
}
_LISTS = ["required_qualifications", "preferred_qualifications"]


@dataclass(frozen=True)
class FieldRule:
    """How one field is read: a constant, a URL parameter, or page selectors."""

    name: str
    default: str | None = None
    url_param: str | None = None
    selectors: tuple[str, ...] = ()
    attribute: str = "text"
    transform: dict | None = None

    @classmethod
    def of(cls, name: str, rule, transforms: dict) -> "FieldRule":
        if isinstance(rule, str):
            return cls(name, selectors=(rule,))
        rule = rule or {}
        if "default" in rule and not rule.get("selector"):
            return cls(name, default=rule["default"])
        selectors = [rule.get("selector"), *(rule.get("fallback_selectors") or [])]
        return cls(
            name,
            url_param=rule.get("url_param"),
            selectors=tuple(css for css in selectors if css),
            attribute=rule.get("attribute") or "text",
            transform=transforms.get(rule.get("transform")),
        )

    def probe(self) -> Probe | None:
        """The page read this rule needs; an unusable selector costs the field only."""
        if not self.selectors:
            return None
        try:
            return probe(self.name, "value", list(self.selectors), self.attribute)
        except ValueError as err:
            warnings.warn(f"field {self.name}: {err}", stacklevel=2)
            return None

    def column(self, probed: set[str], source_url: Column, now: Column) -> Column:
        if self.default is not None:
            return now if self.default == NOW else F.lit(self.default).cast("string")
        value = F.lit(None).cast("string")
        if self.name in probed:
            value = enrich.transform_value(F.col(f"_dom.{self.name}"), self.transform, source_url)
        if self.url_param:
            parameter = url_param(source_url, self.url_param)
            value = F.when(F.coalesce(source_url, F.lit("")) != "", parameter).otherwise(value)
        return value


def select_fields(
    pages: DataFrame, rules: dict[str, dict | str], *keep: str, html: str = "html",
    source_url: str | None = None, transforms: dict | None = None,
) -> DataFrame:
    """Any set of field rules over pages: one output column per rule."""
    parsed = [FieldRule.of(name, rule, transforms or {}) for name, rule in rules.items()]
    probes = [p for p in (rule.probe() for rule in parsed) if p]
    url = F.col(source_url) if source_url else F.lit("")
    read = pages.select(
        *keep,
        url.alias("_url"),
        F.explode_outer(PageReader(tuple(probes)).column(F.col(html))).alias("_dom"),
    )
    names = {p.name for p in probes}
    return read.select(
        *keep, *(r.column(names, F.col("_url"), _iso_now()).alias(r.name) for r in parsed)
    )


def _iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def extract_postings(
    pages: DataFrame,
    config: PatternConfig,
    *keep: str,
    html: str = "html",
    source_url: str | None = None,
    default_company: str | None = None,
    default_platform: str = "",
    scraped_at: Column | None = None,
    error_marks: list[str] = ERROR_MARKS,
    source_marks: list[str] = (),
) -> DataFrame:
    """Every page as posting columns plus ``status``; no shuffle.

    Pages that give no posting stay as rows with the reason in ``status``, so one
    parse serves the postings, the rejects and the counts. ``keep`` columns come first.
    ``error_marks`` are texts of error pages, ``source_marks`` pieces of their markup.
    """
    transforms = config.section("transformations")
    rules = {
        name: FieldRule.of(name, config.field_rule(section, name), transforms)
        for name, section in _RULES.items()
    }
    probes = [p for p in (rule.probe() for rule in rules.values()) if p]
    names = {p.name for p in probes}
    for name in _LISTS:
        if name in names:
            css = rules[name].selectors[0]
            probes += [probe(f"{name}_items", "items", css), probe(f"{name}_block", "block", css)]
    reader = PageReader(
        tuple(probes), tuple(mark.lower() for mark in error_marks), tuple(source_marks)
    )

    given = F.col(source_url) if source_url else F.lit("")
    dom = pages.select(
        *keep, given.alias("_given"), F.explode_outer(reader.column(F.col(html))).alias("_dom")
    )
    now = scraped_at if scraped_at is not None else _iso_now()

    # The page's own address comes first, because other fields are resolved against it.
    own = rules["source_url"].column(names, F.lit(""), now)
    addressed = dom.withColumn("_url", F.coalesce(empty_to_null(F.col("_given")), own, F.lit("")))
    value = {name: rule.column(names, F.col("_url"), now) for name, rule in rules.items()}
    for name in _LISTS:
        value[f"{name}_list"] = (
            enrich.list_items(F.col(f"_dom.{name}_items"), F.col(f"_dom.{name}_block"))
            if name in names
            else F.array().cast("array<string>")
        )
    fields = addressed.select(
        *keep,
        "_url",
        F.col("_dom.failure").alias("_failure"),
        F.col("_dom.error_page").alias("_error"),
        *(column.alias(f"_{name}") for name, column in value.items()),
    )

    text = lambda name: F.coalesce(F.col(f"_{name}"), F.lit(""))
    quals = F.concat_ws(" ", text("required_qualifications"), text("preferred_qualifications"))
    with_quals = F.concat_ws(" ", text("description"), quals)
    minimum, preferred = F.col(f"_{_LISTS[0]}_list"), F.col(f"_{_LISTS[1]}_list")
    skills = config.section("skills_extraction")
    columns = {
        "job_id": F.col("_job_id"),
        "title": F.col("_title"),
        "company": F.coalesce(
            empty_to_null(F.col("_company")),
            F.lit(config.company_name if default_company is None else default_company),
        ),
        "description": text("description"),
        "summary": text("summary"),
        **enrich.parse_location(F.col("_location")),
        "work_arrangement": enrich.classify(
            with_quals, config.section("work_arrangement_patterns"), WORK_ARRANGEMENTS
        ),
        "publish_date": F.col("_publish_date"),
        "scraped_date": now,
        "job_type": enrich.classify(
            F.concat_ws(" ", text("title"), text("description")),
            config.section("job_type_patterns"),
            JOB_TYPES,
            enrich.DEFAULT_JOB_TYPE,
        ),
        "experience_level": enrich.classify(
            F.concat_ws(" ", text("title"), with_quals),
            config.section("experience_patterns"),
            EXPERIENCE_LEVELS,
        ),
        "team": text("team"),
        "department": text("department"),
        "required_skills": enrich.extract_skills(
            quals,
            skills.get("technical_skills_patterns") or [],
            skills.get("soft_skills_patterns") or [],
        ),
        "minimum_qualifications": minimum,
        "preferred_qualifications": preferred,
        "education_requirements": enrich.education_requirements(minimum),
        "experience_requirements": enrich.experience_requirements(minimum, preferred),
        "pay_benefit": text("pay_benefit"),
        **enrich.extract_salary(text("pay_benefit"), config.section("salary_patterns")),
        "application_url": text("application_url"),
        "source_url": F.col("_url"),
        "source_platform": F.coalesce(
            empty_to_null(F.col("_source_platform")), F.lit(default_platform)
        ),
    }
    status = (
        F.when(F.col("_failure").isNotNull(), F.lit(FAILED))
        .when(F.col("_error"), F.lit(ERROR_PAGE))
        .when((text("job_id") == "") | (text("title") == ""), F.lit(MISSING_FIELDS))
        .otherwise(F.lit(OK))
    )
    built = fields.select(
        *keep,
        status.alias("status"),
        F.col("_failure").alias("failure"),
        *(column.alias(name) for name, column in columns.items()),
    )
    return conform_postings(built, *keep, "status", "failure")


def not_error_page(
    pages: DataFrame, *keep: str, html: str = "html", error_marks: list[str] = ERROR_MARKS
) -> DataFrame:
    """Pages whose text, in any case, has no error mark, with that text as ``page_text``."""
    reader = PageReader((probe("page_text", "page"),), tuple(mark.lower() for mark in error_marks))
    read = pages.select(*keep, F.inline_outer(reader.column(F.col(html))))
    return read.where(~F.col("error_page") & F.col("failure").isNull()).select(*keep, "page_text")


def required_present(df: DataFrame, *names: str) -> DataFrame:
    """Adds ``reason``: the key fields a row lacks, null when it has them all."""
    missing = F.array_compact(
        F.array(*(F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(n)) for n in names))
    )
    return df.withColumn(
        "reason",
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ","))),
    )


def extraction_summary(extracted: DataFrame) -> DataFrame:
    ok = F.col("status") == OK
    return extracted.agg(
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def stamp_scraped(postings: DataFrame, at: Column | None = None) -> DataFrame:
    """Processing time replaces whatever date was extracted."""
    return postings.withColumn("scraped_date", at if at is not None else _iso_now())
