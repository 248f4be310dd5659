"""Readers, writers and incremental runs, over files written from the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobquarry.plans import process_urls as plan
from jobquarry.queries.bindings import SAMPLE
from jobquarry.queries.registry import query, split_table, table
from jobquarry.queries.url_side import (
    FIRST_LINKS_SQL,
    FIRST_SQL,
    VALID_SQL,
    WITH_LINKS,
    listing_input,
    page_links,
)
from jobquarry.schema import POSTING_SCHEMA, conform_postings, postings_from_json
from jobquarry.sources import envelopes, readers, writers
from jobquarry.sources.files import write_files
from jobquarry.session import scratch_path
from jobquarry.streaming.incremental import ingest, stream_dedup


LISTINGS_SQL = WITH_LINKS + """
SELECT CAST(page_id AS VARCHAR) AS file, page_url AS listing_url, pos, 'https://careers.example.com' || href AS url,
       substr(href, 2) AS title, 'x' || page_id AS tag, CAST(NULL AS VARCHAR) AS reason
FROM links WHERE NOT suffix(page_url, '.html') AND page_id % 10 <> 3
UNION ALL
SELECT CAST(page_id AS VARCHAR), CASE WHEN page_id % 10 = 3 THEN url END, NULL, NULL, NULL, NULL,
       CASE WHEN page_id % 10 = 3 THEN 'no list of jobs' ELSE 'invalid JSON' END
FROM pages WHERE suffix(url, '.html') OR page_id % 10 = 3"""


def envelope_files(spark, sf):
    """One envelope file per page: of several lines, without a list of jobs, or cut off."""
    links = F.transform(
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)),
        lambda href: F.struct(
            F.concat(F.lit("https://careers.example.com"), href).alias("url"),
            F.substr(href, F.lit(2)).alias("title"),
            F.create_map(F.lit("tag"), F.concat(F.lit("x"), F.col("page_id"))).alias("metadata"),
        ),
    )
    head = F.struct(F.col("url").alias("source_url"), F.size(links).alias("total_jobs"))
    whole = F.to_json(F.struct(F.col("url").alias("source_url"), F.size(links).alias("total_jobs"), links.alias("jobs")), {"pretty": "true"})
    text = F.when(F.col("page_id") % 10 == 3, F.to_json(head)).when(F.col("url").endswith(".html"), F.left(whole, F.length(whole) - 2)).otherwise(whole)
    path = scratch_path(spark, "listings")
    write_files(split_table(spark, sf, "pages", "page_id"), path, F.concat("page_id", F.lit(".json")), text)
    return path


def listing_columns(rows):
    return rows.select(
        F.regexp_extract("file_path", r"([^/]*)\.json$", 1).alias("file"), "listing_url", "pos", "url", "title",
        F.col("metadata")["tag"].alias("tag"), "reason",
    )


@query("read_listings", LISTINGS_SQL)
def read_listings(spark, sf):
    """Envelope files of many lines, some of them broken, read whole."""
    return listing_columns(readers.read_listings(spark, envelope_files(spark, sf)))


@query("read_huge_listings", LISTINGS_SQL)
def read_huge_listings(spark, sf):
    """The same files read in pieces, as one huge envelope would be."""
    return listing_columns(envelopes.read_huge_listings(spark, envelope_files(spark, sf)))


@query("read_html_dump", "SELECT 'page ' || page_id AS file_stem, md5(html) AS html_md5 FROM pages WHERE html <> ''")
def read_html_dump(spark, sf):
    """One html file per page, as a crawl leaves them."""
    path = scratch_path(spark, "dump")
    pages = split_table(spark, sf, "pages", "page_id")
    write_files(pages, path, F.concat(F.lit("page "), "page_id", F.lit(".html")), F.col("html"))
    return readers.read_html_dump(spark, path).select("file_stem", F.md5("html").alias("html_md5"))


@query(
    "read_packed_dump",
    """
SELECT regexp_replace(regexp_extract(url, '([^/]+//?[^/]*)$', 1), '[.][^.]*$', '') AS file_stem,
       md5(html) AS html_md5 FROM pages""",
)
def read_packed_dump(spark, sf):
    """The packed form of a dump, in one table."""
    name = F.regexp_extract("url", "([^/]+//?[^/]*)$", 1)
    pages = readers.read_packed_dump(spark, f"{sf}/pages.parquet", name)
    return pages.select("file_stem", F.md5("html").alias("html_md5"))


@query(
    "read_latest_snapshots",
    """
SELECT 'c' || page_id % 40 AS company, CAST(page_id * 31 % 7 AS VARCHAR) AS snapshot, page_id, md5(url) AS url_md5
FROM pages WHERE page_id % 9 <> 4
QUALIFY rank() OVER (PARTITION BY page_id % 40 ORDER BY page_id * 31 % 7 DESC) = 1""",
)
def read_latest_snapshots(spark, sf):
    """A tree of one JSON file per page below company and snapshot; some snapshots are no numbers."""
    path = scratch_path(spark, "tree")
    number = (F.col("page_id") * 31 % 7).cast("string")
    snapshot = F.when(F.col("page_id") % 9 == 4, F.concat(F.lit("v9"), number)).otherwise(number)
    name = F.concat(F.lit("c"), F.col("page_id") % 40, F.lit("/"), snapshot, F.lit("/"), "page_id", F.lit(".json"))
    write_files(split_table(spark, sf, "pages", "page_id"), path, name, F.to_json(F.struct("page_id", "url")))
    rows = readers.read_latest_snapshots(spark, path).where("readable")
    parts = r"([^/]+)/([^/]+)/[^/]+$"
    fields = F.from_json("document", "page_id long, url string")
    return rows.select(
        F.regexp_extract("file_path", parts, 1).alias("company"), F.regexp_extract("file_path", parts, 2).alias("snapshot"),
        fields["page_id"].alias("page_id"), F.md5(fields["url"]).alias("url_md5"),
    )


@query(
    "latest_snapshot",
    """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y%m') AS snapshot FROM orders
WHERE o_orderpriority <> '2-HIGH'
QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) DESC) = 1""",
)
def latest_snapshot(spark, sf):
    """Customers stand for companies, order months for snapshots; some names are no numbers."""
    month = F.date_format("o_orderdate", "yyyyMM")
    rows = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey",
        F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("."), month)).otherwise(month).alias("snapshot"),
    )
    return readers.latest_snapshot(rows, "o_custkey", "snapshot")


def link_postings(spark, sf):
    """Links as posting rows under the page they are on."""
    links = page_links(spark, sf)
    return links.select(
        "page_id", "pos",
        F.concat_ws("-", "page_id", "pos").alias("job_id"),
        F.element_at("metadata", "title").alias("title"),
        F.lit("Sample Pages").alias("company"),
        F.col("url").alias("source_url"),
        F.array("page_url").alias("required_skills"),
    )


POSTINGS_SQL = WITH_LINKS + """
SELECT page_id || '-' || pos AS job_id, substr(href, 2) AS title, 'Sample Pages' AS company,
       'https://careers.example.com' || href AS source_url, page_url AS skill, 'USD' AS salary_currency
FROM links"""


def posting_columns(df):
    return df.select(
        "job_id", "title", "company", "source_url",
        F.array_join("required_skills", "|").alias("skill"), "salary_currency",
    )


@query("write_postings", POSTINGS_SQL)
def write_postings(spark, sf):
    path = scratch_path(spark, "postings")
    writers.write_postings(conform_postings(link_postings(spark, sf), "page_id"), path, "page_id")
    return posting_columns(spark.read.schema(POSTING_SCHEMA).json(path))


@query("read_postings_tree", POSTINGS_SQL)
def read_postings_tree(spark, sf):
    """Postings below company and snapshot folders, one JSON file per posting."""
    path = scratch_path(spark, "tree")
    rows = writers.posting_json(conform_postings(link_postings(spark, sf)), "job_id")
    company = F.concat(F.lit("c"), F.crc32("job_id") % 64)
    write_files(rows, path, F.concat(company, F.lit("/1/"), "job_id", F.lit(".json")), F.col("posting"))
    return posting_columns(readers.read_postings_tree(spark, path))


def posting_documents(spark, sf):
    """One text per page with its links as jobs: a list, an object, or a wrong shape."""
    job = F.struct("job_id", "title", "company", "source_url", "required_skills")
    jobs = (
        link_postings(spark, sf)
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", job.alias("job")))).alias("jobs"))
        .select("page_id", F.transform("jobs", lambda j: j["job"]).alias("jobs"))
    )
    pages = table(spark, sf, "pages").select("page_id", "url")
    as_list, as_object = F.to_json("jobs"), F.to_json(F.struct("jobs"))
    document = (
        F.when(F.col("url").endswith(".html"), F.lit('"no postings"'))
        .when(F.col("url").startswith("https:"), F.concat(F.lit("\n "), as_list))
        .otherwise(as_object)
    )
    return jobs.join(pages, "page_id").select("page_id", document.alias("document"))


@query(
    "load_postings",
    WITH_LINKS + """
SELECT page_id, pos, page_id || '-' || pos AS job_id, substr(href, 2) AS title, NULL AS reason
FROM links WHERE NOT suffix(page_url, '.html')
UNION ALL
SELECT page_id, NULL, NULL, NULL, 'neither a list of jobs nor an object with a jobs list'
FROM pages WHERE suffix(url, '.html')""",
)
def load_postings(spark, sf):
    rows = readers.load_postings(posting_documents(spark, sf), "document", "page_id")
    return rows.select("page_id", "pos", "job_id", "title", "reason")


ORDER_JSON_SQL = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'o' || o_orderkey END AS job_id,
       o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN 'full_time' END AS job_type,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS salary_min,
       'USD' AS salary_currency, 0 AS n_benefits, o_orderstatus <> 'P' AS valid
FROM orders"""


def order_json(spark, sf):
    """Orders as posting texts with unknown keys, odd enum values and wrong types."""
    price = F.when(F.col("o_orderpriority") == "5-LOW", F.lit('"a lot"')).otherwise(
        F.col("o_totalprice").cast("string")
    )
    job_id = F.when(F.col("o_orderstatus") == "P", F.lit("null")).otherwise(
        F.concat(F.lit('"o'), "o_orderkey", F.lit('"'))
    )
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("full_time")).otherwise("night_shift")
    text = F.format_string(
        '{"job_id": %s, "title": "%s", "company": "c", "job_type": "%s", "salary_min": %s, "unknown": {"x": 1}}',
        job_id, F.col("o_orderpriority"), kind, price,
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("document"))


@query("coerce_posting", ORDER_JSON_SQL)
def coerce_posting(spark, sf):
    rows = postings_from_json(order_json(spark, sf), "document", "o_orderkey")
    return rows.select(
        "o_orderkey", "job_id", "title", "job_type", "salary_min", "salary_currency",
        F.size("benefits").alias("n_benefits"), "valid",
    )


@query("load_posting", ORDER_JSON_SQL.replace("o_orderstatus <> 'P' AS valid", "TRUE AS valid") + " WHERE o_orderstatus <> 'P'")
def load_posting(spark, sf):
    """The loader keeps the texts that hold a whole posting."""
    return coerce_posting(spark, sf).where("valid")


@query(
    "document_pages_text",
    """
SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id""",
)
def document_pages_text(spark, sf):
    return readers.document_pages_text(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query(
    "write_processed_envelope",
    "WITH" + VALID_SQL + "," + FIRST_SQL + """
SELECT url, job_id, lang AS title, (SELECT count(*) FROM checked) AS original_total_jobs,
       (SELECT count(*) FROM firsts) AS processed_total_jobs, 'Sample Pages' AS company_name
FROM firsts""",
)
def write_processed_envelope(spark, sf):
    """The written summary beside each of the written rows, counted while they were written."""
    path = scratch_path(spark, "processed")
    plan.run_process_urls(listing_input(spark, sf), SAMPLE, path, "pages", 1, "page_id")
    summary = spark.read.json(f"{path}/summary").first()  # one row by construction
    return spark.read.json(f"{path}/jobs").select(
        "url", "job_id", "title",
        F.lit(summary["original_total_jobs"]).cast("long").alias("original_total_jobs"),
        F.lit(summary["processed_total_jobs"]).cast("long").alias("processed_total_jobs"),
        F.lit(summary["company_name"]).alias("company_name"),
    )


@query(
    "index_corpus",
    """
SELECT vec_id, label AS company, CASE
    WHEN label = 1 THEN 'no embedding' WHEN label = 2 THEN 'embedding length differs'
    WHEN label = 3 THEN 'embedding holds nulls' WHEN label = 4 THEN 'embedding has no direction'
    END AS reason, label NOT BETWEEN 1 AND 4 AS searchable,
  CASE WHEN label NOT BETWEEN 1 AND 4 THEN len(embedding) END AS dims
FROM embeddings""",
)
def index_corpus(spark, sf):
    """Vectors of four labels are spoilt, each in another way."""
    label, vector = F.col("label"), F.col("embedding")
    spoilt = (
        F.when(label == 1, F.lit(None))
        .when(label == 2, F.slice(vector, 1, 10))
        .when(label == 3, F.transform(vector, lambda x, i: F.when(i != 7, x)))
        .when(label == 4, F.transform(vector, lambda x: F.lit(0.0).cast("float")))
        .otherwise(vector)
    )
    rows = table(spark, sf, "embeddings").select("vec_id", label.alias("company"), spoilt.alias("embedding"))
    path = scratch_path(spark, "corpus")
    writers.index_corpus(rows, "embedding", 64, path, "company")
    return writers.read_indexed(spark, path).select(
        "vec_id", "company", "reason", "searchable",
        F.when(F.col("searchable"), F.size("embedding").cast("long")).alias("dims"),
    )


@query("stream_ingest", "SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def stream_ingest(spark, sf):
    """The page table as a stream of files, run until nothing is left."""
    path = scratch_path(spark, "ingest")
    schema = table(spark, sf, "pages").schema
    stream = ingest(
        spark, f"{sf}/page[s].parquet", f"{path}/landed", f"{path}/checkpoint", schema=schema,
        transform=lambda df: df.select("page_id", "url", F.md5("html").alias("html_md5")),
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{path}/landed")


@query(
    "stream_dedup",
    FIRST_LINKS_SQL + " SELECT page_id, pos, 'https://careers.example.com' || href AS url FROM first_links",
)
def stream_dedup_query(spark, sf):
    path = scratch_path(spark, "dedup")
    page_links(spark, sf).select("page_id", "pos", "url").write.parquet(f"{path}/links")
    links = spark.readStream.schema("page_id long, pos long, url string").parquet(f"{path}/links")
    stream_dedup(links, f"{path}/seen", f"{path}/checkpoint", "page_id", "pos").awaitTermination()
    return spark.read.parquet(f"{path}/seen").select("page_id", "pos", "url")


