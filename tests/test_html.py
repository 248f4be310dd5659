"""The page reader and the extraction of whole pages."""

import sys
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobquarry import PatternConfig
from jobquarry.functions.html import Page, Selector, in_pieces
from jobquarry.operators import links, postings
from jobquarry.sources.readers import read_html_dump


def texts(html, css):
    page = Page(html)
    return [page.stripped_text(e) for e in Selector.compile(css).select(page)]


def test_text_rules():
    page = Page("<p>a <b> b </b>c<script>x</script>&amp;&lt;&#65;&#x42;&unknown; <!-- no -->d</p>")
    p = page.elements[0]
    assert page.text(p) == "a  b c&<AB&unknown d"
    assert page.stripped_text(p) == "abc&<AB&unknownd"
    assert page.text() == page.text(p)
    script = page.elements[2]
    assert page.text(script) == "x"  # its own text counts for itself


def test_tree_rules():
    # No implied closing: an open p holds what follows; a stray end tag is ignored.
    assert texts("<p>one<p>two</p></i>three", "p") == ["onetwothree", "two"]
    # Void elements never hold content, written either way.
    assert texts("<div>a<br>b<br/>c</br>d</div>", "div") == ["abcd"]
    assert texts("<div/>out<div>in</div>", "div") == ["", "in"]
    assert Page("<p>a<![CDATA[b]]>c</p>").text() == "abc"
    assert Page("<pre>  \n </pre><p>  \n </p>").text() == "  \n \n"


def test_unclosed_elements_cost_no_more_than_closed_ones():
    start = time.perf_counter()
    page = Page("<p><b>x</i>" * 30_000)
    assert len(page.elements) == 60_000 and len(page.text()) == 30_000
    assert Selector.compile("p b").first(page) is page.elements[1]
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize(
    "piece, css",
    [("<br><p>x</p>", "p"), ("<div><i><a href=x>", "div i a"), ("<div><a href=x>", "table div a"), ("<p>a<li>", "ul p li")],
)
def test_broken_pages_cost_time_in_proportion(piece, css):
    """Steps of the matcher, not seconds: twice the page, about twice the steps."""
    selector = Selector.compile(css)

    def steps(n):
        page, count = Page(piece * n), 0

        def tick(frame, event, arg):
            nonlocal count
            count += 1
            return tick

        before = sys.gettrace()
        sys.settrace(tick)
        try:
            selector.select(page)
        finally:
            sys.settrace(before)
        return count

    assert steps(4_000) < 2.2 * steps(2_000)


@pytest.mark.parametrize(
    "css, expected",
    [
        ("#a", ["1"]), (".x", ["1", "2"]), ("p.x", ["2"]), ("[data-k]", ["2", "3"]),
        ('i[data-k="v w"]', ["3"]), ("[data-k*='v']", ["3"]), ("div .x", ["2"]), ("div p.x, #a", ["1", "2"]),
        ("[data-k^=v]", ["3"]), ("[data-k$='w']", ["3"]), ("span div p", []), ("*[id=a]", ["1"]),
        ("[data-k*='']", []),
    ],
)
def test_selectors(css, expected):
    html = "<b id=a class='x y'>1</b><div><p class='z x' data-k=q>2</p><i data-k='v w'>3</i></div>"
    assert texts(html, css) == expected


@pytest.mark.parametrize("css", ["a > b", "a:first-child", "a + b", "", "a,,b"])
def test_unknown_selector_forms_are_refused(css):
    with pytest.raises(ValueError):
        Selector.compile(css)


@pytest.fixture(scope="module")
def postings_by_file(spark, fixtures, config):
    pages = read_html_dump(spark, str(fixtures / "dump"))
    rows = postings.extract_postings(pages, config, "file_stem", scraped_at=F.lit("now")).collect()
    return {row.file_stem: row for row in rows}


def test_full_page(postings_by_file):
    row = postings_by_file["1001_full"]
    assert row.status == "ok"
    assert (row.job_id, row.title, row.company) == ("1001", "Senior Data Engineer", "Example Works Ltd.")
    assert (row.location, row.city, row.state, row.country) == (
        "Berlin, BE, Germany", "Berlin", "BE", "Germany",
    )
    # Pieces are joined without a blank; a no-break space is white space like any other.
    assert row.summary == "Build pipelines.Run them well."
    assert row.description == "You workremote, full-time & with cafés."
    assert row.minimum_qualifications == [
        "Bachelor degree incomputerscience",
        "5+ years experience with Python, SQL and C++ code",
        "Strong communication skills",
    ]
    assert row.education_requirements == ["Bachelor degree incomputerscience"]
    # "communication skills" holds no experience word, "bs"/"ms" and so on are substrings.
    assert row.experience_requirements == [
        "5+ years experience with Python, SQL and C++ code", "Knowledge of Kubernetes or docker",
    ]
    # \b after "C++" wants a word character next, so "C++ code" is no match.
    assert row.required_skills == ["Kubernetes", "Python", "SQL", "communication skills", "docker"]
    assert (row.salary_min, row.salary_max, row.salary_currency) == (120000.0, 180500.0, "USD")
    assert row.hourly_rate_min is None
    assert (row.experience_level, row.job_type, row.work_arrangement) == ("senior_level", "full_time", "remote")
    assert row.publish_date == "2024-05-01"
    assert row.source_url.endswith("1001/senior-data-engineer?team=DATA%20CORE")
    assert row.team == "DATA CORE"
    assert row.application_url == "https://careers.example.com/apply/1001?src=x"
    assert row.source_platform == "careers.example.com"
    assert row.scraped_date == "now"


def test_page_without_list_elements(postings_by_file):
    row = postings_by_file["1002_bullets"]
    assert row.minimum_qualifications == [
        "Speak two languages", "Be on time", "A longer line without any mark",
    ]
    assert row.job_type == "internship"
    assert row.location.startswith("Remote") and row.city == ""
    assert (row.salary_min, row.hourly_rate_min) == (None, 19.5)
    assert row.application_url == "https://other.example.org/apply"
    assert row.source_url == "" and row.team == "" and row.preferred_qualifications == []


def test_pages_without_a_posting_keep_their_reason(spark, postings_by_file):
    assert postings_by_file["1003_gone"].status == "error_page"
    assert postings_by_file["1004_no_id"].status == "missing_required"
    assert set(postings_by_file) == {"1001_full", "1002_bullets", "1003_gone", "1004_no_id"}


def test_marks_in_the_markup(spark):
    pages = spark.createDataFrame([(1, "<div class='gone'><h1>T</h1><b>i</b>")], "page_id int, html string")
    config = PatternConfig({"basic_info": {"job_id": "b", "title": "h1"}})
    status = lambda **marks: postings.extract_postings(pages, config, "page_id", **marks).first().status
    assert status(error_marks=["gone"]) == "ok"
    assert status(source_marks=["gone"]) == "error_page"


def test_null_page_and_bad_selector_do_not_stop_the_run(spark):
    pages = spark.createDataFrame([(1, None), (2, "<h1>T</h1><b>i</b>")], "page_id int, html string")
    config = PatternConfig({"basic_info": {"job_id": "b", "title": "h1", "company": "h1 > p"}})
    with pytest.warns(UserWarning, match="company"):
        extracted = postings.extract_postings(pages, config, "page_id")
    rows = {r.page_id: r for r in extracted.collect()}
    assert rows[1].status == "failed" and rows[2].status == "ok"
    assert rows[2].company == ""
    summary = postings.extraction_summary(extracted).first()
    assert (summary.successful, summary.failed, summary.total) == (1, 1, 2)


LISTING = """
<div><a class="job-link" href="details/7/a?team=X"> <span class="job-title"> Engineer </span>
  <i class="job-location">Paris<b>!</b></i><u class="dept">ops</u><time data-date="2024-01-02">x</time></a>
 <a href="/en/details/8/b">plain</a><a class="job-link" href="/en/details/9.pdf">pdf</a>
 <a class="job-link" href="https://else.example.org/about">no posting</a><a class="job-link">no link</a></div>
<div class="pager">Page 2 of 17 <button data-pager="next" {attr}>next</button></div>
"""


def test_links_of_a_listing(spark, config):
    pages = spark.createDataFrame(
        [(1, "https://careers.example.com/en/list?page=2", LISTING), (2, "u", "<p>none"), (3, "u", None)],
        "page_id int, page_url string, html string",
    )
    found = links.extract_links(
        pages, config, "https://careers.example.com/en/list", keep=["page_id", "page_url"]
    )
    rows = links.listing_rows(found, config.company_name, "page_url", "page_id", "pos").orderBy("pos").collect()
    assert [(r.page_id, r.url) for r in rows] == [
        (1, "https://careers.example.com/en/details/7/a?team=X"),
        (1, "https://careers.example.com/en/details/8/b"),
    ]
    first, second = rows
    assert (first.title, first.location, first.department, first.posted_date) == (
        "Engineer", "Paris", "OPS", "2024-01-02",
    )
    assert first.job_type == "" and "unusable" not in first.metadata and "job_type" not in first.metadata
    assert second.title == "" and second.metadata == {}
    assert first.company == "Example Works" and first.source_url.endswith("page=2")


def test_next_page_and_page_count(spark, config):
    button = lambda attr: LISTING.replace("{attr}", attr)
    cases = {
        1: (button(""), True, 17),
        2: (button("disabled"), False, 17),
        3: (button('aria-disabled="true"'), False, 17),
        4: (button('aria-disabled="false"'), True, 17),
        5: ("<p>no pager", False, 1),
        6: ("<a href='?page=3'>3</a><a href='?page=12'>12</a><a href='?page=x'>x</a>", False, 12),
        7: ("<a href='?page=0'>Last</a>", False, 0),
        8: ("<div class=pager><i class=next></i></div><p>1-20 of 3380 results", False, 169),
        9: ("<div class=pager><i class=next></i></div><p>1-10 of 33800 results", False, 3380),
        10: ("<p>1-20 of 3380 results", False, 1),
    }
    pages = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "page_id int, html string")
    has_next = {r.page_id: r.has_next for r in links.has_next_page(pages, config, "page_id").collect()}
    counts = {r.page_id: r.page_count for r in links.detect_page_count(pages, config, "page_id").collect()}
    assert has_next == {k: v[1] for k, v in cases.items()}
    assert counts == {k: v[2] for k, v in cases.items()}
    cut = links.detect_page_count(pages, config, "page_id", cap=200).where("capped").collect()
    assert [(r.page_id, r.page_count) for r in cut] == [(9, 200)]
    manual = PatternConfig({"pagination": {"max_pages": 9, "page_detection": {"method": "manual"}}})
    assert {r.page_count for r in links.detect_page_count(pages, manual, "page_id").collect()} == {9}


def test_pages_of_a_large_batch_are_handed_on_in_pieces():
    pages = ["<p>a</p>", None, "x" * 700_000, "y" * 700_000, "", *(f"<p>{i}</p>" for i in range(1000))]
    held = []

    def read(html):
        held.append(html)
        return html

    got = []
    for piece in in_pieces(iter([pa.array(pages), pa.array([], pa.string()), pa.array(["last"])]), read, pa.string()):
        assert piece.to_pylist() == held and len(held) <= 256 and sum(len(h or "") for h in held[:-1]) < 1 << 20
        got += piece.to_pylist()
        held.clear()
    assert got == [*pages, "last"]
