"""Column functions against Python's own on awkward input."""

import random
import re
from urllib.parse import parse_qs, urlencode, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from jobquarry.functions import enrich, text, urls
from jobquarry.functions.regex import translate, translate_replacement
from jobquarry.plans.process_urls import validate_urls
from jobquarry import PatternConfig


def values(spark, inputs, *columns):
    """Column results over string inputs, in input order."""
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, s string")
    rows = df.select("i", *(c.alias(f"c{n}") for n, c in enumerate(columns))).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in rows]


def random_texts(alphabet, n=400, longest=14, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_title_case_like_python(spark):
    inputs = random_texts("aBcß 3'-é_Ω中ñ\n") + ["o'neil", "3d c++/go", "ßa", "ǆ x".replace("ǆ", "d")]
    assert values(spark, inputs, text.title_case(F.col("s"))) == [s.title() for s in inputs]
    assert values(spark, ["senior-data-%20x"], urls.prettify_title(F.col("s"))) == ["Senior Data %20X"]


def test_strip_and_spaces_like_python(spark):
    inputs = random_texts("a \t\n\xa0 \x1c　b")
    assert values(spark, inputs, text.strip(F.col("s"))) == [s.strip() for s in inputs]
    assert values(spark, inputs, text.normalize_space(F.col("s"))) == [" ".join(s.split()) for s in inputs]


def test_split_bullets(spark):
    expected = {
        "": [], " \n ": [], "• ": ["•"], "-": ["-"], "short\nother": ["short\nother"],
        "- one\n* two\n▪three": ["one", "two", "three"],
        "• - * both\n\n  ‣ indented  \n▸": ["both", "indented"],
        "a line of eleven\nten chars.\n- x": ["a line of eleven", "x"],
        "no mark but long enough": ["no mark but long enough"], "  a b  ": ["a b"],
        "x - y\n•a": ["a"], "elevenchars\ntencharsss": ["elevenchars"],
    }
    assert values(spark, list(expected), text.split_bullets(F.col("s"))) == list(expected.values())


def test_float_text_like_python(spark):
    numbers = [0.0, 1.0, 45.5, 0.1, 1e7, 12345678.25, 1e15, 1e16, 1.5e16, 1e22, 1e100, 1e-3, 2.5e-4, 1e-4,
               1e-5, 1.25e-7, 123456.789, 9999999.0, 10000000.5, -3.25e8, 0.30000000000000004]
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(text.float_text(F.col("x"))).collect()]
    assert got == [str(x) for x in numbers]


def test_numbers(spark):
    inputs = ["1", "1.5", ".5", "5.", "", "1.2.3", "1d", "nan", "-2", "1e3", " 7 "]
    assert values(spark, inputs, text.number_or_null(F.col("s"))) == [
        1.0, 1.5, 0.5, 5.0, None, None, None, None, -2.0, 1000.0, 7.0,
    ]


PATTERNS = [
    (r"^(?P<job_id>\d+)-(?P<x_y>[^/?]+)", ["12-ab/c", "x", "١٢-q"]),
    (r"(?P<a>x)(?P=a)", ["xx", "x"]),
    (r"[[a]&&b]+", ["[a&b]]", "&&b]", "q"]),
    (r"[]a]+z", ["]az", "z"]),
    (r"[^]a]z", ["bz", "]z"]),
    (r"a{,2}b{1}{", ["aab{", "ab"]),
    (r"a.b$", ["a\rb", "a\nb", "a\x85b\n", "axb\n"]),
    (r"\bcafé\b\s\w+\Z", ["café\xa0ünï", "xcafé a"]),
    (r"(?#note)a(?:b|c)?", ["ab", "a", "c"]),
    (r"(a)?b", ["b", "ab", "c"]),
    (r"x{", ["x{", "x"]),
]


@pytest.mark.parametrize("pattern, inputs", PATTERNS)
def test_patterns_mean_the_same(spark, pattern, inputs):
    java = translate(pattern)
    found = values(spark, inputs, F.col("s").rlike(java.search), F.regexp_extract("s", java.search, 0))
    for value, (matched, whole) in zip(inputs, found):
        python = re.search(pattern, value)
        assert matched == bool(python), (pattern, value)
        assert whole == (python[0] if python else "")


@pytest.mark.parametrize("pattern", [r"(a)?(?(1)b|c)", r"(?a)\w", r"(?x) a b", r"\N{BULLET}"])
def test_patterns_without_java_form_are_refused(pattern):
    with pytest.raises(ValueError):
        translate(pattern)


@pytest.mark.parametrize(
    "pattern, replacement, value",
    [
        (r"(\d)(\d)", r"\2$\g<1>", "12 34"),
        (r"(?P<first>a)b", r"[\g<first>]\\", "abab"),
        (r"(a)", r"\g<1>0", "aa"),
        (r"x", r"$1{y}", "x"),
        (r"\s+", " ", "a \n b"),
    ],
)
def test_replacements_mean_the_same(spark, pattern, replacement, value):
    replaced = F.regexp_replace(
        "s", F.lit(translate(pattern).search), F.lit(translate_replacement(replacement, pattern))
    )
    assert values(spark, [value], replaced) == [re.sub(pattern, replacement, value)]


BASES = ["http://h.example/a/b/c?q=1#f", "https://h.example", "https://h.example/x/", "http://h.example//d//e/f"]
LINKS = ["", "g", "./g", "g/", "/g", "//o.example/x", "?y", "g?y#s", "#s", ";x", "..", "../g", "../../../g",
         ".", "./", "g/../h", "/./g", "/../g", "http://z.example/p?", "HTTP://Z.example/p", "mailto:x@y", "ftp://q/r",
         "g//h", "http:g", " /lead", "a\tb", "g#", "?", "javascript:void(0)", "g.html?a=1&b=/../x"]


def test_resolve_like_python(spark):
    # A query or fragment sign with nothing behind it is kept by newer Python only.
    pairs = [(b, link) for b in BASES for link in LINKS]
    df = spark.createDataFrame([(i, b, link) for i, (b, link) in enumerate(pairs)], "i int, b string, l string")
    got = [r.url for r in urls.resolve_url(df, F.col("b"), "l").orderBy("i").collect()]
    want = [urljoin(b, link) for b, link in pairs]
    assert [(p, g) for p, g, w in zip(pairs, got, want) if g != w] == []


def test_page_url(spark):
    expected = {
        "http://h/l": ["http://h/l", "http://h/l?page=2", "http://h/l?page=17"],
        "http://h/l?page=3": ["http://h/l?page=1", "http://h/l?page=2", "http://h/l?page=17"],
        "http://h/l?a=1&page=2&b=x%20y&a=2#top": [f"http://h/l?a=1&a=2&page={n}&b=x+y#top" for n in (1, 2, 17)],
        "http://h/?e=&f&page=": ["http://h/?e=&f&page=", "http://h/?page=2", "http://h/?page=17"],
        "http://h/l?q=a+b*~%C3%A9%zz&=1": [
            "http://h/l?q=a+b*~%C3%A9%zz&=1", *(f"http://h/l?q=a+b%2A~%C3%A9%25zz&=1&page={n}" for n in (2, 17))
        ],
        "http://h/l?page=1&page=4&z=/?": [f"http://h/l?page={n}&z=%2F%3F" for n in (1, 2, 17)],
    }
    for k, number in enumerate((1, 2, 17)):
        got = values(spark, list(expected), urls.page_url(F.col("s"), F.lit(number)))
        assert got == [urls_[k] for urls_ in expected.values()]


def test_url_param_like_python(spark):
    inputs = ["http://h/?team=A%20B+c&team=d", "http://h/?x=1", "http://h", "http://h/?team=", "http://h/?team=%zz#team=q", ""]
    want = [parse_qs(urlparse(u).query).get("team", [None])[0] for u in inputs]
    assert values(spark, inputs, urls.url_param(F.col("s"), "team")) == want


def test_page_file_name(spark):
    expected = {
        "http://h/en/details/1/a-b?x=1": ("en_details_1_a-b.html", "7_x__en_details_1_a-b.html"),
        "http://h/a.html": ("a.html", "7_x__a.html"),
        "http://h/": (".html", "7_x.html"),
        "http://h": (".html", "7_x.html"),
        "http://h/a:b|c*/_d_": ("a_b_c___d.html", "7_x__a_b_c___d.html"),
        "http://h/a;p=1": ("a.html", "7_x__a.html"),
    }
    got = values(spark, list(expected), urls.page_file_name(F.col("s")), urls.page_file_name(F.col("s"), F.lit("7|x")))
    assert got == list(expected.values())


def test_job_url(spark):
    good = ["https://h/jobs/1", "https://h/EN/Details/2", "https://h/apply", "https://h/apply?x"]
    bad = ["https://h/jobs/1.pdf", "https://h/jobs/locationpicker", "https://h/apply/1", "https://h/jobs#x", "https://h/about",
           "mailto:a@/jobs/", "https://h/jobs/search"]
    assert values(spark, good + bad, urls.is_job_url(F.col("s"))) == [True] * len(good) + [False] * len(bad)


def test_validate_url(spark, config):
    base = "https://careers.example.com/en/details/"
    inputs = [base + "1/data-eng?team=A", base + "1/o'neil-3d", base + "x/y", base + "1/a.pdf", base + "2/locationPicker", "", None,
              "see " + base + "1/a"]
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, url string")
    rows = validate_urls(df, config).orderBy("i").collect()
    assert [r.valid for r in rows] == [True, True, False, False, False, False, False, False]
    assert rows[0].extracted_fields == {"job_id": "1", "job_title": "Data Eng", "team": "A", "region": ""}
    # The optional group took no part: null, not ''.
    assert rows[1].extracted_fields == {"job_id": "1", "job_title": "O'Neil 3D", "team": None, "region": ""}
    assert rows[2].extracted_fields is None
    # A group that matched nothing is '', one left out is null.
    rule = PatternConfig({"url_validation": {"valid_pattern": r"a(?P<e>x*)b?(?P<o>y)?"}})
    row = validate_urls(spark.createDataFrame([("abz",)], "url string"), rule).first()
    assert row.extracted_fields == {"e": "", "o": None}


def test_salary(spark):
    patterns = {"salary_range_pattern": r"\$([0-9,]+).*?\$([0-9,]+)", "hourly_rate_pattern": r"\$([0-9.]+).*?hour"}
    inputs = ["$1,000 to $2,500", "$120,000 an hour", "from $, to $5", "$1.2.3 hour", "none", "$10 - $20 per hour", "$7\nhour"]
    columns = enrich.extract_salary(F.col("s"), patterns)
    got = values(spark, inputs, columns["salary_min"], columns["salary_max"], columns["hourly_rate_min"])
    assert got == [(1000.0, 2500.0, None), (None, None, 120.0), (None, None, None), (None, None, None),
                   (None, None, None), (10.0, 20.0, 10.0), (None, None, None)]


def test_skills_and_levels(spark):
    skills = enrich.extract_skills(F.col("s"), [r"\b(go|rust)\b", r"(a)(b)?"], [r"\bteam work\b"])
    assert values(spark, ["Go RUST go ago", "Team  work team work", "", "équigo"], skills) == [
        ["", "Go", "RUST", "a", "go"], ["", "a", "team work"], [], [],
    ]
    levels = {"no_such": ["x"], "senior_level": ["VP", r"7\+ years"], "entry_level": ["x"]}
    level = enrich.classify(F.col("s"), levels, ["senior_level", "entry_level"])
    assert values(spark, ["a vp", "7+ YEARS x", "x", "none"], level) == ["senior_level", "senior_level", "entry_level", None]


def test_location(spark):
    parts = enrich.parse_location(F.col("s"))
    got = values(spark, ["A, B ,C,D", "A,", "Remote", "", None], *(parts[n] for n in ("location", "city", "state", "country")))
    assert got == [("A, B ,C,D", "A", "B", "C"), ("A,", "A", "", ""), ("Remote", "", "", ""), ("", "", "", ""), ("", "", "", "")]


def test_salary_text(spark):
    rows = [(1000.5, 2500.5, None, None), (1234567.0, 0.0, None, None), (None, 9.0, 1.0, None), (0.0, None, 10.0, 12.5),
            (None, None, 45.0, 0.0), (None, None, None, 1e7), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double, d double")
    columns = [F.col(n) for n in "abcd"]
    out = enrich.salary_range_text(*columns, F.lit("USD"))
    given = enrich.has_salary_info(*columns, F.lit(" \n"))
    got = df.orderBy("i").select(out.alias("t"), given.alias("g")).collect()
    assert [r.t for r in got] == ["USD 1,000 - 2,500", "USD 1,234,567+", "Up to USD 9", "USD 10.0/hr - 12.5/hr", "USD 45.0/hr+",
                                  "Up to USD 10000000.0/hr", None]
    assert [r.g for r in got] == [True] * 6 + [False]


def test_absolute_url(spark):
    inputs = ["/a", "//h2/x", "rel", "http://x/y", "/a/../b"]
    assert values(spark, inputs, enrich.absolute_url(F.col("s"), "https://h/x/y?z")) == [
        urljoin("https://h/x/y?z", u) if u.startswith("/") else u for u in inputs
    ]
