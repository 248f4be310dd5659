"""URLs, links, deduplication and crawl statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.config import PatternConfig
from jobquarry.functions import urls
from jobquarry.operators import dedup, downloads, links
from jobquarry.plans import process_urls as plan
from jobquarry.queries.bindings import HOME_URL, LINKS_SQL, SAMPLE
from jobquarry.queries.registry import query, split_table, table
from jobquarry.session import scratch_path

WITH_LINKS = "WITH" + LINKS_SQL


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, page_url, pos, url, metadata) of all links on all pages."""
    pages = split_table(spark, sf, "pages", "page_id").select("page_id", F.col("url").alias("page_url"), "html")
    return links.extract_links(
        pages, SAMPLE, HOME_URL, keep=["page_id", "page_url"], job_urls_only=False
    )


def stored_links(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stored table, for queries that read the links more than once."""
    path = scratch_path(spark, "links")
    page_links(spark, sf).select("page_id", "page_url", "pos", "url").write.parquet(path)
    return spark.read.parquet(path)


@query(
    "extract_links",
    WITH_LINKS
    + """
SELECT page_id, pos, 'https://careers.example.com' || href AS url,
       regexp_replace(href, '^/', '') AS title, regexp_replace(href, '^/', '') AS location,
       upper(replace(href, 'ß', 'SS')) AS department, 3 AS n_fields
FROM links
WHERE NOT regexp_matches(lower(href), '/search|/filter|#')
  AND (contains(lower(href), '/th') OR contains(lower(href), '/die'))""",
)
def extract_links(spark, sf):
    found = page_links(spark, sf).where(
        urls.is_job_url(F.col("url"), include=["/th", "/die"])
    )
    field = lambda name: F.try_element_at("metadata", F.lit(name)).alias(name)
    return found.select(
        "page_id", "pos", "url", field("title"), field("location"), field("department"),
        F.size("metadata").alias("n_fields"),
    )


@query(
    "resolve_url",
    WITH_LINKS
    + """,
parts AS (
  SELECT *, regexp_extract(page_url, '^(https?://[^/]+)', 1) AS host,
         regexp_extract(page_url, '^https?://[^/]+([^?#]*)', 1) AS path,
         regexp_extract(page_url, '^([a-z]+):', 1) AS scheme
  FROM links),
folders AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM parts)
SELECT page_id, pos, unnest(['rooted', 'relative', 'parent', 'query', 'host', 'page', 'foreign']) AS form,
       unnest([
         host || href,
         host || folder || substr(href, 2),
         host || regexp_replace(folder, '[^/]+/$', '') || substr(href, 2),
         host || path || '?q=' || substr(href, 2),
         scheme || '://other.example.org' || href,
         page_url,
         'ftp://files.example.org' || href]) AS resolved
FROM folders""",
)
def resolve_url(spark, sf):
    """Every link of a page in seven forms, seen from the page it is on."""
    found = table(spark, sf, "pages").select(
        "page_id", "url",
        F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))),
    )
    bare = F.substr("col", F.lit(2))
    forms = {
        "rooted": F.col("col"),
        "relative": bare,
        "parent": F.concat(F.lit("./../"), bare),
        "query": F.concat(F.lit("?q="), bare),
        "host": F.concat(F.lit("//other.example.org"), "col"),
        "page": F.col("url"),
        "foreign": F.concat(F.lit("ftp://files.example.org"), "col"),
    }
    pairs = [part for name, link in forms.items() for part in (F.lit(name), link)]
    rows = found.select(
        "page_id", "url", F.col("pos").cast("long").alias("pos"),
        F.explode(F.create_map(*pairs)).alias("form", "link"),
    )
    return urls.resolve_url(rows, F.col("url"), "link", "resolved").select(
        "page_id", "pos", "form", "resolved"
    )


@query(
    "is_job_url",
    """
SELECT page_id,
       NOT contains(lower(url), '#') AS as_job_path,
       FALSE AS as_is,
       (contains(url, '/en/') OR contains(url, '/de/'))
         AND NOT contains(url, 'utm_source') AND NOT contains(url, '.html') AS own_lists
FROM pages""",
)
def is_job_url(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.is_job_url(F.regexp_replace(url, "/[a-z]{2}/", "/Jobs/")).alias("as_job_path"),
        urls.is_job_url(url).alias("as_is"),
        urls.is_job_url(url, ["/EN/", "/de/"], ["utm_Source", ".html"]).alias("own_lists"),
    )


@query(
    "listing_row",
    WITH_LINKS
    + """
SELECT page_id, pos, 'https://careers.example.com' || href AS url,
       regexp_replace(href, '^/', '') AS title, regexp_replace(href, '^/', '') AS location,
       upper(replace(href, 'ß', 'SS')) AS department, '' AS job_type, '' AS posted_date, 'Sample Pages' AS company,
       page_url AS source_url
FROM links""",
)
def listing_row(spark, sf):
    rows = links.listing_rows(page_links(spark, sf), SAMPLE.company_name, "page_url", "page_id", "pos")
    return rows.drop("metadata")


@query(
    "listing_metadata",
    WITH_LINKS
    + """
SELECT page_id, pos, unnest(['department', 'location', 'title']) AS field,
       unnest([upper(replace(href, 'ß', 'SS')), regexp_replace(href, '^/', ''), regexp_replace(href, '^/', '')]) AS content
FROM links""",
)
def listing_metadata(spark, sf):
    return page_links(spark, sf).select(
        "page_id", "pos", F.explode("metadata").alias("field", "content")
    )


PAGE_URL_SQL = """
SELECT {keys}, CASE
  WHEN n = 1 AND NOT contains(url, 'page=') THEN url
  WHEN contains(url, 'page=2&ref=x') THEN replace(url, 'page=2', 'page=' || n)
  WHEN contains(url, '?utm_source=feed') THEN url || '&page=' || n
  WHEN contains(url, '#top') THEN replace(url, '#top', '?page=' || n || '#top')
  ELSE url || '?page=' || n END AS page_url
FROM ({source})"""


@query(
    "page_url",
    PAGE_URL_SQL.format(
        keys="page_id", source="SELECT page_id, url, page_id + 1 AS n FROM pages"
    ),
)
def page_url(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.page_url(F.col("url"), F.col("page_id") + 1).alias("page_url")
    )


@query(
    "page_frontier",
    PAGE_URL_SQL.format(
        keys="page_id, n AS page_number",
        source="""SELECT page_id, url, unnest(generate_series(1, len(regexp_extract_all(html, '<li>')))) AS n
                  FROM pages""",
    ),
)
def page_frontier(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_count("html", F.lit("<li>")).alias("page_count")
    )
    return links.page_frontier(pages, "url", "page_count", "page_id")


@query(
    "detect_page_count",
    """
SELECT page_id, 'own' AS kind, CAST(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS BIGINT) AS page_count, FALSE AS capped_at_150 FROM pages
UNION ALL SELECT page_id, 'links', page_id % 97 + 3, FALSE FROM pages
UNION ALL SELECT page_id, 'last', 12, FALSE FROM pages
UNION ALL SELECT page_id, 'line', (page_id * 7 + 40) // 20, page_id * 7 + 21 > 20 * 150 FROM pages
UNION ALL SELECT page_id, 'none', 1, FALSE FROM pages""",
)
def detect_page_count(spark, sf):
    """Every page's own html, and for every page each other way a page can show its count.

    Those are links with numbers, a last link, a result line, or nothing.
    """
    pages = split_table(spark, sf, "pages", "page_id")
    number = F.col("page_id")
    made = {
        "links": F.format_string("<a href='?page=2'>2</a><a href='?page=%d'>more</a>", (number % 97 + 3).cast("int")),
        "last": F.lit("<a href='?page=0'>1</a><a href='?page=12'>Last »</a>"),
        "line": F.format_string("<p class='pager'><a class='next'>n</a></p>1-20 of %d results", number * 7 + 21),
        "none": F.lit("<p>1-20 of 400 results</p>"),
    }
    plain = PatternConfig({"pagination": {}})
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), html.alias("html")) for k, html in made.items())))
    cases = pages.select("page_id", kinds.alias("case")).select("page_id", "case.kind", "case.html")
    own = links.detect_page_count(pages.withColumn("kind", F.lit("own")), SAMPLE, "page_id", "kind")
    found = own.unionByName(links.detect_page_count(cases, plain, "page_id", "kind")).drop("capped")
    cut = links.detect_page_count(cases.where("kind = 'line'"), plain, "page_id", "kind", cap=150)
    cut = cut.where("capped").select("page_id", "kind", F.lit(True).alias("cut"))
    return found.join(cut, ["page_id", "kind"], "left").select("page_id", "kind", "page_count", F.coalesce("cut", F.lit(False)).alias("capped_at_150"))


@query(
    "detect_page_count_own_html",
    "SELECT page_id, CAST(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS BIGINT) AS page_count FROM pages",
)
def detect_page_count_own_html(spark, sf):
    """Every page by its own html; the branches that no page takes are in ``detect_page_count``."""
    pages = split_table(spark, sf, "pages", "page_id")
    return links.detect_page_count(pages, SAMPLE, "page_id").select("page_id", "page_count")


@query(
    "has_next_page",
    "SELECT page_id, regexp_matches(html, '<a href=\"[^\"]*th') AS has_next FROM pages",
)
def has_next_page(spark, sf):
    return links.has_next_page(split_table(spark, sf, "pages", "page_id"), SAMPLE, "page_id")


VALID_SQL = """
checked AS (
  SELECT page_id, url,
         regexp_matches(url, '^https?://[^/]+/[a-z]{2}/\\d+')
           AND NOT contains(url, 'utm_source=') AND NOT suffix(url, '.html') AS valid,
         regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang,
         regexp_extract(url, '^https?://[^/]+/[a-z]{2}/(\\d+)', 1) AS job_id,
         nullif(regexp_extract(url, '^https?://[^/]+/[a-z]{2}/\\d+\\?page=(\\d+)', 1), '') AS team
  FROM pages)"""


@query(
    "validate_url",
    "WITH" + VALID_SQL + """
SELECT page_id, valid, CASE WHEN valid THEN lang END AS lang, CASE WHEN valid THEN job_id END AS job_id,
       CASE WHEN valid THEN team END AS team, CASE WHEN valid THEN '' END AS job_title
FROM checked""",
)
def validate_url(spark, sf):
    checked = plan.validate_urls(table(spark, sf, "pages").select("page_id", "url"), SAMPLE)
    return checked.select(
        "page_id", "valid",
        *(F.col("extracted_fields")[name].alias(name) for name in ("lang", "job_id", "team", "job_title")),
    )


@query(
    "prettify_title",
    r"""
SELECT doc_id, array_to_string(list_transform(
         regexp_extract_all(replace(text, '-', ' '), '\p{L}+|\P{L}+'),
         lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '') AS title
FROM documents""",
)
def prettify_title(spark, sf):
    texts = split_table(spark, sf, "documents", "doc_id").select("doc_id", "text")
    return texts.select(
        "doc_id", urls.prettify_title(F.col("text")).alias("title")
    )


@query(
    "processed_row",
    "WITH" + VALID_SQL + """
SELECT page_id, url, job_id, team, '' AS job_title, lang AS title, '' AS location,
       'Sample Pages' AS company, 4 AS n_fields
FROM checked WHERE valid""",
)
def processed_row(spark, sf):
    rows = plan.processed_rows(
        plan.validate_urls(listing_input(spark, sf), SAMPLE).where("valid"), "page_id"
    )
    return rows.select(
        "page_id", "url", "job_id", "team", "job_title", "title", "location", "company",
        F.size("extracted_fields").alias("n_fields"),
    )


def listing_input(spark, sf):
    """Pages as listing rows; the language code serves as the listing's own title."""
    return table(spark, sf, "pages").select(
        "page_id", "url",
        F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1).alias("title"),
        F.lit("Sample Pages").alias("company"),
    )


FIRST_SQL = """
firsts AS (
  SELECT * FROM checked WHERE valid
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY page_id) = 1)"""


@query(
    "process_urls",
    "WITH" + VALID_SQL + "," + FIRST_SQL + """
SELECT page_id, url, job_id, team, lang AS title, 'Sample Pages' AS company FROM firsts""",
)
def process_urls(spark, sf):
    rows = plan.process_urls(listing_input(spark, sf), SAMPLE, "page_id")
    return rows.select("page_id", "url", "job_id", "team", "title", "company")


@query(
    "dedup_job_id",
    """
WITH keyed AS (SELECT page_id, regexp_extract(url, '\\?page=(\\d+)', 1) AS job_id, url FROM pages)
SELECT * FROM keyed
QUALIFY job_id = '' OR row_number() OVER (PARTITION BY job_id ORDER BY page_id) = 1""",
)
def dedup_job_id(spark, sf):
    """Most pages have no page parameter, and those must all stay."""
    keyed = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", r"\?page=(\d+)", 1).alias("job_id"), "url"
    )
    return dedup.dedup_job_id(keyed, "page_id")


@query(
    "processing_stats",
    "WITH" + VALID_SQL + "," + FIRST_SQL + """
SELECT count(*) AS original_count, count(*) FILTER (valid) AS valid_count,
       count(*) FILTER (NOT valid) AS invalid_count,
       count(*) FILTER (valid) - (SELECT count(*) FROM firsts) AS duplicate_count,
       (SELECT count(*) FROM firsts) AS final_count
FROM checked""",
)
def processing_stats(spark, sf):
    return plan.processing_stats(listing_input(spark, sf), SAMPLE)


FILE_SQL = """
named AS (
  SELECT page_id, url, starts_with(url, 'https:') AS secure,
         trim(replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/', '_'), '_') AS stem
  FROM pages),
files AS (
  SELECT page_id, url, secure, CASE WHEN suffix(stem, '.html') THEN stem ELSE stem || '.html' END AS file_name
  FROM named)"""


@query(
    "page_file_name",
    "WITH" + FILE_SQL + """
SELECT page_id, file_name, 'doc|' || page_id AS job_id,
       'doc_' || page_id || '__' || file_name AS id_file_name
FROM files""",
)
def page_file_name(spark, sf):
    job_id = F.concat(F.lit("doc|"), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select(
        "page_id",
        urls.page_file_name(F.col("url")).alias("file_name"),
        job_id.alias("job_id"),
        urls.page_file_name(F.col("url"), job_id).alias("id_file_name"),
    )


def planned_and_landed(spark, sf):
    """Pages fetched over https have landed; those over http were planned later."""
    files = downloads.with_file_name(table(spark, sf, "pages").select("page_id", "url"), job_id=None)
    secure = F.col("url").startswith("https:")
    return files.where(~secure), files.where(secure)


PLAN_SQL = "WITH" + FILE_SQL + """,
plan AS (
  SELECT page_id, file_name, CASE WHEN file_name IN (SELECT file_name FROM files WHERE secure)
                                  THEN 'skip' ELSE 'fetch' END AS status
  FROM files WHERE NOT secure)"""


@query("download_plan", PLAN_SQL + " SELECT page_id, file_name, status FROM plan")
def download_plan(spark, sf):
    return downloads.download_plan(*planned_and_landed(spark, sf)).select(
        "page_id", "file_name", "status"
    )


@query("skip_existing", PLAN_SQL + " SELECT page_id, file_name FROM plan WHERE status = 'fetch'")
def skip_existing(spark, sf):
    return downloads.skip_existing(*planned_and_landed(spark, sf)).select("page_id", "file_name")


@query(
    "download_summary",
    PLAN_SQL + """
SELECT count(*) FILTER (status = 'skip') AS success_count,
       count(*) FILTER (status = 'fetch') AS failed_count, count(*) AS total_count
FROM plan""",
)
def download_summary(spark, sf):
    """Nothing is fetched here, so every planned fetch counts as failed."""
    planned, landed = planned_and_landed(spark, sf)
    steps = downloads.download_plan(planned, landed)
    return downloads.download_summary(steps, steps.where(F.col("status") == downloads.FETCH))


FIRST_LINKS_SQL = WITH_LINKS + """,
first_links AS (
  SELECT page_id, pos, page_url, href FROM links
  QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1)"""


@query(
    "dedup_url",
    FIRST_LINKS_SQL
    + " SELECT page_id, pos, 'https://careers.example.com' || href AS url FROM first_links",
)
def dedup_url(spark, sf):
    return dedup.dedup_url(page_links(spark, sf), "page_id", "pos").select("page_id", "pos", "url")


def two_runs(spark, sf):
    """An earlier crawl (http pages) and a later one (https pages)."""
    found = stored_links(spark, sf)
    secure = F.col("page_url").startswith("https:")
    return found.where(~secure), found.where(secure)


@query(
    "resume_merge",
    WITH_LINKS + """,
old AS (SELECT page_id, pos, href FROM links WHERE NOT starts_with(page_url, 'https:')),
fresh AS (
  SELECT page_id, pos, href FROM links
  WHERE starts_with(page_url, 'https:') AND href NOT IN (SELECT href FROM old)
  QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1)
SELECT page_id, pos, 'https://careers.example.com' || href AS url
FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh)""",
)
def resume_merge(spark, sf):
    old, new = two_runs(spark, sf)
    return dedup.resume_merge(old, new, "page_id", "pos").select("page_id", "pos", "url")


@query(
    "union_runs",
    WITH_LINKS + """
SELECT page_id, pos, 'https://careers.example.com' || href AS url,
       CASE WHEN starts_with(page_url, 'https:') THEN 1 ELSE 0 END AS run
FROM links""",
)
def union_runs(spark, sf):
    old, new = two_runs(spark, sf)
    return dedup.union_runs(old, new).select("page_id", "pos", "url", "run")


@query(
    "crawl_order",
    WITH_LINKS + """
SELECT page_id, pos, 'https://careers.example.com' || href AS url FROM links ORDER BY page_id, pos""",
)
def crawl_order(spark, sf):
    return dedup.crawl_order(stored_links(spark, sf), "page_id", "pos").select("page_id", "pos", "url")


@query(
    "crawl_summary",
    WITH_LINKS + """
SELECT regexp_extract(page_url, '^https?://([^/]+)', 1) AS host,
       count(DISTINCT href) AS total_jobs, count(DISTINCT page_id) AS total_pages_crawled
FROM links GROUP BY 1""",
)
def crawl_summary(spark, sf):
    found = page_links(spark, sf).withColumn("host", F.regexp_extract("page_url", "^https?://([^/]+)", 1))
    return dedup.crawl_summary(found, "host", page="page_id")


@query(
    "page_counts",
    FIRST_LINKS_SQL + """
SELECT page_id, count(*) AS jobs_found,
       (SELECT count(*) FROM first_links f WHERE f.page_id = l.page_id) AS jobs_new
FROM links l GROUP BY page_id""",
)
def page_counts(spark, sf):
    return dedup.page_counts(stored_links(spark, sf), "page_id")


@query(
    "empty_page_runs",
    """
WITH flagged AS (SELECT user_id, event_id, floor(value / 40) = 0 AS is_empty FROM events),
grouped AS (
  SELECT *, sum(CASE WHEN is_empty THEN 0 ELSE 1 END)
              OVER (PARTITION BY user_id ORDER BY event_id) AS island
  FROM flagged),
runs AS (
  SELECT *, CAST(sum(CASE WHEN is_empty THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS empty_run
  FROM grouped)
SELECT user_id, event_id, is_empty, empty_run, empty_run >= 5 AS limit_reached FROM runs""",
)
def empty_page_runs(spark, sf):
    """A user's events stand for a crawl's pages, small values for pages without jobs."""
    pages = table(spark, sf, "events").select(
        "user_id", "event_id", F.floor(F.col("value") / 40).alias("jobs")
    )
    return dedup.empty_page_runs(pages, "user_id", "event_id", "jobs")
