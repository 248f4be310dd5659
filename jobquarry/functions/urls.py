"""URL functions as column expressions, after RFC 3986 with Python's conventions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.functions.regex import group_value, matches_any, quoted_any, translate
from jobquarry.functions.text import title_case

_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*:"
_PREFIX = rf"^(?:{_SCHEME})?(?://[^/?#]*)?"

# A link holding one of these is no posting (compared in lower case).
EXCLUDED_URL_PARTS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", "locationPicker", "/apply/", "/profile/",
    "/search", "/filter", "javascript:", "mailto:", "tel:", "#",
]
# A link needs one of these to be a posting.
INCLUDED_URL_PARTS = [
    "/job/", "/jobs/", "/career/", "/careers/", "/position/", "/positions/", "/opening/",
    "/openings/", "/details/", "/listing/", "/apply",
]
# Characters not allowed in a page's file name.
FORBIDDEN_IN_FILE_NAME = '<>:"|?*'


def url_prefix(url: Column) -> Column:
    """Scheme and host with their marks."""
    return F.regexp_extract(url, _PREFIX, 0)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PREFIX + "([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#([\s\S]*)$", 1)


def _marked(mark: str, part: Column) -> Column:
    """A query or fragment with its mark; an empty one leaves no mark behind."""
    return F.when(part != "", F.concat(F.lit(mark), part)).otherwise("")


def _without_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments, keeping a trailing slash for a trailing one."""
    closed = F.regexp_replace(path, r"(?<=/)(\.\.?)$", "$1/")
    kept = F.aggregate(
        F.split(closed, "/"),
        F.array().cast("array<string>"),
        lambda seen, segment: F.when(
            segment == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))
        )
        .when(segment == ".", seen)
        .otherwise(F.concat(seen, F.array(segment))),
    )
    return F.regexp_replace(F.array_join(kept, "/"), "^(?!/)", "/")


def resolve_url(df: DataFrame, base: Column | str, link: str, into: str = "url") -> DataFrame:
    """Adds the absolute form of the column ``link`` seen from ``base``.

    The parts are columns of their own on the way, each computed once per row; written
    as one expression they would be repeated in every branch.
    """
    base = F.lit(base) if isinstance(base, str) else base
    home_scheme = F.lower(F.regexp_extract(base, "^" + _SCHEME, 0))
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    scheme, rest, path = F.col("_scheme"), F.col("_rest"), F.col("_path")
    tail, full = F.col("_tail"), F.col("_full")
    # Browsers and Python drop control characters before looking at a link.
    control = F.lit("".join(map(chr, range(33))))
    steps = [
        {"_clean": F.regexp_replace(F.ltrim(F.col(link), control), "[\t\r\n]", "")},
        {"_scheme": F.lower(F.regexp_extract("_clean", "^" + _SCHEME, 0))},
        # A link that repeats the base's scheme counts as written without it.
        {"_rest": F.substr("_clean", F.length(scheme) + 1)},
        {"_path": F.regexp_extract(rest, "^[^?#]*", 0)},
        {
            "_tail": F.regexp_replace(F.substr(rest, F.length(path) + 1), r"\?(?=#|$)|#$", ""),
            # Repeated slashes in a merged path count once; a rooted path stays as written.
            "_full": F.when(path.startswith("/"), path).otherwise(
                F.regexp_replace(F.concat(F.lit("/"), folder, path), "/{2,}", "/")
            ),
        },
        {"_full": F.when(full.rlike(r"/\.\.?(/|$)"), _without_dots(full)).otherwise(full)},
    ]
    same_page = F.concat(
        url_path(base), F.when(tail.startswith("?"), "").otherwise(_marked("?", url_query(base)))
    )
    resolved = (
        F.when(F.col("_clean") == "", base)
        .when((scheme != "") & (scheme != home_scheme), F.col(link))
        .when(rest.startswith("//"), F.concat(home_scheme, path, tail))
        .otherwise(F.concat(url_prefix(base), F.when(path == "", same_page).otherwise(full), tail))
    )
    out = df
    for step in steps:
        out = out.withColumns(step)
    return out.withColumn(into, resolved).drop("_clean", "_scheme", "_rest", "_path", "_tail", "_full")


def rooted_url(base: Column | str, path: Column) -> Column:
    """A link that starts with a slash, seen from ``base``."""
    base = F.lit(base) if isinstance(base, str) else base
    plain = F.when(path.rlike(r"/\.\.?(/|$)"), _without_dots(path)).otherwise(path)
    scheme = F.regexp_extract(base, "^" + _SCHEME, 0)
    return F.when(path.startswith("//"), F.concat(scheme, path)).otherwise(
        F.concat(url_prefix(base), plain)
    )


def is_job_url(
    url: Column,
    include: list[str] = INCLUDED_URL_PARTS,
    exclude: list[str] = EXCLUDED_URL_PARTS,
) -> Column:
    lowered = F.lower(url)
    wanted = lowered.rlike(quoted_any([part.lower() for part in include]))
    unwanted = lowered.rlike(quoted_any([part.lower() for part in exclude]))
    return wanted & ~unwanted


def _decode(value: Column) -> Column:
    """Percent and plus decoding; a stray ``%`` stands for itself."""
    return F.try_url_decode(F.regexp_replace(value, "%(?![0-9a-fA-F]{2})", "%25"))


def _encode(value: Column) -> Column:
    """Form encoding that spares ``~`` and not ``*``, as Python's does."""
    return F.replace(
        F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
    )


def query_pairs(query: Column) -> Column:
    """``a=1&b=2`` as decoded (name, value) structs; blank values are left out."""
    return F.transform(
        F.filter(F.split(query, "&"), lambda pair: pair.rlike("^[^=]*=[\\s\\S]")),
        lambda pair: F.struct(
            _decode(F.substring_index(pair, "=", 1)).alias("name"),
            _decode(F.substr(pair, F.instr(pair, "=") + 1)).alias("value"),
        ),
    )


def url_param(url: Column, name: str) -> Column:
    """First non-blank value of a query parameter, decoded; null without one."""
    values = F.filter(query_pairs(url_query(url)), lambda pair: pair["name"] == name)
    return F.try_element_at(values, F.lit(1))["value"]


def page_url(home_url: Column | str, page_number: Column, page_param: str = "page") -> Column:
    """The home URL with the page parameter set.

    Page 1 of a home URL without that parameter is the home URL itself. Repeated
    parameters are gathered at the first one's place.
    """
    home_url = F.lit(home_url) if isinstance(home_url, str) else home_url
    pairs = query_pairs(url_query(home_url))
    has_param = F.exists(pairs, lambda pair: pair["name"] == page_param)
    number = page_number.cast("string")
    page_pair = F.struct(F.lit(page_param).alias("name"), number.alias("value"))
    names = F.array_distinct(F.transform(pairs, lambda pair: pair["name"]))
    grouped = F.flatten(
        F.transform(
            names,
            lambda name: F.when(name == page_param, F.array(page_pair)).otherwise(
                F.filter(pairs, lambda pair: pair["name"] == name)
            ),
        )
    )
    all_pairs = F.when(has_param, grouped).otherwise(F.concat(grouped, F.array(page_pair)))
    query = F.array_join(
        F.transform(
            all_pairs, lambda pair: F.concat(_encode(pair["name"]), F.lit("="), _encode(pair["value"]))
        ),
        "&",
    )
    rebuilt = F.concat(
        url_prefix(home_url),
        url_path(home_url),
        F.lit("?"),
        query,
        _marked("#", url_fragment(home_url)),
    )
    return F.when((page_number == 1) & ~has_param, home_url).otherwise(rebuilt)


def page_file_name(url: Column, job_id: Column | None = None) -> Column:
    """The file a page is stored under: job id and path, the query left out."""
    path = F.regexp_replace(url_path(url), ";[^/]*$", "")  # path parameters
    name = F.translate(path, "/" + FORBIDDEN_IN_FILE_NAME, "_" * (1 + len(FORBIDDEN_IN_FILE_NAME)))
    if job_id is not None:
        marked = F.translate(job_id, FORBIDDEN_IN_FILE_NAME, "_" * len(FORBIDDEN_IN_FILE_NAME))
        name = F.when(
            F.coalesce(job_id, F.lit("")) != "", F.concat(marked, F.lit("_"), name)
        ).otherwise(name)
    name = F.btrim(name, F.lit("_"))
    return F.when(name.endswith(".html"), name).otherwise(F.concat(name, F.lit(".html")))


@dataclass(frozen=True)
class UrlRule:
    """A pattern file's URL section as expressions: ``valid`` and the named fields.

    A named group that took no part in the match is null, a configured field without a
    group is ''.
    """

    valid: Column
    fields: dict[str, Column]

    @classmethod
    def of(cls, url: Column, rule: dict) -> "UrlRule":
        text = F.coalesce(url, F.lit(""))
        pattern = rule.get("valid_pattern") or ""
        if not pattern:
            return cls(F.lit(False), {})
        java = translate(pattern)
        valid = (text != "") & text.rlike(java.match)
        if rule.get("invalid_patterns"):
            valid = valid & ~matches_any(text, rule["invalid_patterns"])
        fields = {name: group_value(text, java, index) for name, index in java.groups.items()}
        if "job_title" in fields:
            fields["job_title"] = prettify_title(fields["job_title"])
        for name in rule.get("extracted_fields") or []:
            fields.setdefault(name, F.lit(""))
        return cls(valid, fields)


def prettify_title(slug: Column) -> Column:
    """A URL slug as a title; percent codes stay as they are."""
    return title_case(F.replace(slug, F.lit("-"), F.lit(" ")))


__all__ = [
    "EXCLUDED_URL_PARTS", "FORBIDDEN_IN_FILE_NAME", "INCLUDED_URL_PARTS", "UrlRule", "is_job_url",
    "page_file_name", "page_url", "prettify_title", "query_pairs", "resolve_url", "rooted_url", "url_param",
]
