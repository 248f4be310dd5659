"""Listing pages to link rows, and pagination read from stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.config import PatternConfig
from jobquarry.functions.html import PageReader, page_links, probe
from jobquarry.functions.regex import translate
from jobquarry.functions.urls import is_job_url, page_url, resolve_url
from jobquarry.operators.unnest import unnest

# Metadata fields with a column of their own, and pagination defaults.
LISTING_FIELDS = ["title", "location", "department", "job_type", "posted_date"]
NEXT_BUTTON = 'button[data-analytics-pagination="next"]'
NEXT_LINK = ".pagination .next, .pager .next"
PAGE_OF_TEXT = r"Page \d+ of (\d+)"
RESULT_LINE = r"(\d+)-(\d+) of (\d+)"


def extract_links(
    pages: DataFrame,
    config: PatternConfig,
    home_url: Column | str,
    *,
    html: str = "html",
    keep: list[str],
    job_urls_only: bool = True,
) -> DataFrame:
    """One row per link on a page: ``keep`` columns, pos, url, metadata.

    ``pos`` orders the links of a page as the selectors and the document do. Only the
    ``keep`` columns and the page source are read, and the page source stops here.
    """
    config.require("job_url_selectors")
    base = F.lit(home_url) if isinstance(home_url, str) else home_url
    links = unnest(
        pages.select(
            *keep, base.alias("_home"), page_links(F.col(html), config.link_selectors).alias("_read")
        ),
        F.col("_read.links"),
        *keep,
        "_home",
        item="_link",
    ).select(*keep, "_home", "pos", "_link.*")
    # A literal home URL is folded into constants.
    home = base if isinstance(home_url, str) else F.col("_home")
    found = resolve_url(links, home, "link").select(*keep, "pos", "url", "metadata")
    return found.where(is_job_url(F.col("url"))) if job_urls_only else found


def unread_pages(pages: DataFrame, config: PatternConfig, *keep: str, html: str = "html") -> DataFrame:
    """``keep`` and the ``failure`` of pages whose links could not be read.

    They have no rows in ``extract_links``, and must not pass for pages without jobs.
    """
    config.require("job_url_selectors")
    read = pages.select(*keep, page_links(F.col(html), config.link_selectors).alias("_read"))
    return read.select(*keep, F.col("_read.failure").alias("failure")).where("failure IS NOT NULL")


def listing_rows(links: DataFrame, company: str, source_url: str, *keep: str) -> DataFrame:
    """Link rows in listing layout, absent metadata as ''."""
    return links.select(
        *keep,
        "url",
        *(
            F.coalesce(F.try_element_at("metadata", F.lit(name)), F.lit("")).alias(name)
            for name in LISTING_FIELDS
        ),
        F.lit(company).alias("company"),
        F.col(source_url).alias("source_url"),
        "metadata",
    )


def has_next_page(pages: DataFrame, config: PatternConfig, *keep: str, html: str = "html") -> DataFrame:
    """Whether a page's next button is there and enabled."""
    rule = config.pagination
    button = rule.get("next_button_selector") or NEXT_BUTTON
    disabled = rule.get("next_button_disabled_attribute") or "disabled"
    # Only the first matching button counts, so its attributes come as separate reads.
    reader = PageReader(
        (
            probe("button", "exists", button),
            probe("disabled", "first", button, disabled),
            probe("aria", "first", button, "aria-disabled"),
        )
    )
    return (
        pages
        .select(*keep, F.inline_outer(reader.column(F.col(html))))
        .select(
            *keep,
            F.coalesce(
                F.col("button")
                & F.col("disabled").isNull()
                & F.coalesce(F.col("aria") != "true", F.lit(True)),
                F.lit(False),
            ).alias("has_next"),
        )
    )


def detect_page_count(
    pages: DataFrame, config: PatternConfig, *keep: str, html: str = "html", cap: int | None = None
) -> DataFrame:
    """How many listing pages there are, from whatever pagination a page shows.

    Tried in turn: the configured text, page numbers in links, a "last" link, and the
    "a-b of n" line (only with a next button); otherwise one page. With a ``cap``, a
    number from that line is cut to it, and ``capped`` says where.
    """
    rule = config.pagination
    detection = rule.get("page_detection") or {}
    if detection.get("method", "selector") == "manual":
        count = F.lit(rule.get("max_pages", 1)).cast("long")
        return pages.select(*keep, count.alias("page_count"), F.lit(False).alias("capped"))

    by_selector = detection.get("method", "selector") == "selector"
    probes = [probe("next", "exists", detection.get("next_button_selector") or NEXT_LINK)]
    if by_selector:
        probes.append(probe("hrefs", "values", "a[href*='page=']", "href"))
        probes.append(probe("labels", "values", "a[href*='page=']"))
        if detection.get("selector"):
            probes.append(probe("texts", "values", detection["selector"]))
    read = pages.select(
        *keep, F.col(html).alias("_html"), F.inline_outer(PageReader(tuple(probes)).column(F.col(html)))
    )

    found = lambda numbers: F.get(F.filter(numbers, lambda n: n.isNotNull()), 0)
    steps = []
    if by_selector:
        if detection.get("selector"):
            pattern = detection.get("text_pattern") or PAGE_OF_TEXT
            steps.append(found(F.transform("texts", lambda text: _number(text, pattern))))
        numbers = F.transform("hrefs", lambda href: _number(href, r"page=(\d+)"))
        highest = F.array_max(numbers)
        steps.append(F.when(highest > 0, highest))
        last = F.zip_with(
            "labels", numbers, lambda label, n: F.when(label.contains("Last") | label.contains("»"), n)
        )
        steps.append(found(last))
    first, until, total = (_number(F.col("_html"), RESULT_LINE, group) for group in (1, 2, 3))
    read = read.withColumns({"_per_page": until - first + 1, "_total": total})
    pages_needed = F.when(
        F.col("next") & (F.col("_per_page") > 0), F.expr("(_total + _per_page - 1) div _per_page")
    )
    read = read.withColumn("_shown", F.coalesce(*steps, F.lit(None).cast("long"))).withColumn("_needed", pages_needed)
    bit = F.col("_shown").isNull() & (F.col("_needed") > cap) if cap is not None else F.lit(False)
    return read.select(
        *keep,
        F.coalesce("_shown", F.least("_needed", F.lit(cap).cast("long")), F.lit(1)).cast("long").alias("page_count"),
        F.coalesce(bit, F.lit(False)).alias("capped"),
    )


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, translate(pattern).search, group).try_cast("long")


def page_frontier(
    sources: DataFrame,
    home_url: str,
    page_count: str,
    *keep: str,
    page_param: str = "page",
    start_page: int = 1,
) -> DataFrame:
    """Every listing page still to visit: one row per source and page number."""
    numbered = sources.where(F.col(page_count) >= start_page).select(
        *keep,
        home_url,
        F.explode(F.sequence(F.lit(start_page).cast("long"), F.col(page_count).cast("long"))).alias(
            "page_number"
        ),
    )
    return numbered.select(
        *keep, "page_number", page_url(F.col(home_url), F.col("page_number"), page_param).alias("page_url")
    )
