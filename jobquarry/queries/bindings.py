"""A pattern file for the sample tables: their pages stand in for career pages.

The tables hold no job words, so keyword patterns are words of their text.
"""

from __future__ import annotations

from jobquarry.config import PatternConfig

HOME_URL = "https://careers.example.com/jobs/list?page=1"

SAMPLE = PatternConfig(
    {
        "company_name": "Sample Pages",
        "job_url_selectors": [
            {
                "selector": "nav a[href]",
                "attribute": "href",
                "metadata": {
                    "title": {"selector": "a", "attribute": "text", "transform": "strip"},
                    "location": "a::text",
                    "department": {"selector": "a", "attribute": "href", "transform": "upper"},
                    "absent": ".nowhere",
                },
            }
        ],
        "url_validation": {
            "valid_pattern": r"^https?://[^/]+/(?P<lang>[a-z]{2})/(?P<job_id>\d+)(?:\?page=(?P<team>\d+))?",
            "invalid_patterns": ["utm_source=", r"\.html$"],
            "extracted_fields": ["job_id", "team", "job_title"],
        },
        "pagination": {
            "enabled": True,
            "page_param": "page",
            "next_button_selector": "nav a[href*='th']",
            "next_button_disabled_attribute": "title",
            "page_detection": {"selector": "script", "text_pattern": r"track\((\d+)\)"},
        },
        "html_extraction": {
            "basic_info": {
                "job_id": {"selector": "h1", "attribute": "text", "required": True},
                "title": {"selector": "title", "transform": "first_words"},
                "source_platform": {"default": "sample.example.com"},
            },
            "time_info": {"publish_date": {"selector": "meta", "attribute": "charset"}},
            "location": {
                "location": {
                    "selector": "#location",
                    "fallback_selectors": [".location", "article b"],
                    "transform": "one_blank",
                }
            },
            "content": {
                "summary": {"selector": ".ad", "transform": "clean"},
                "description": {"selector": "article", "transform": "clean"},
                "required_qualifications": {"selector": "nav", "transform": "bullets"},
                "preferred_qualifications": {"selector": "article", "transform": "bullets"},
                "pay_benefit": {"selector": "script"},
            },
            "team_info": {"team": {"selector": None, "url_param": "page"}},
            "application": {
                "application_url": {
                    "selector": "nav a", "attribute": "href", "transform": "absolute",
                }
            },
            "skills_extraction": {
                "technical_skills_patterns": [r"\b(the|der|le)\b", r"\b(and|und|et)\b"],
                "soft_skills_patterns": [r"\bof the\b", r"\bworthless\b"],
            },
            "salary_patterns": {
                "salary_range_pattern": r"track\(([0-9]+)\).*?([0-9]*)",
                "hourly_rate_pattern": r"track\(([0-9.]+)\)",
            },
            "experience_patterns": {
                "unknown_level": ["a"],
                "senior_level": ["tion ist", "edthe"],
                "entry_level": ["tion", r"\bder\b"],
            },
            "job_type_patterns": {"part_time": ["pfkeit"], "contract": [r"elle.?le"]},
            "work_arrangement_patterns": {"remote": ["nicht"], "hybrid": ["which", "dans"]},
            "transformations": {
                "first_words": {"type": "regex_replace", "pattern": r" er.*?$", "replacement": ""},
                "one_blank": {"type": "regex_replace", "pattern": r"\s+", "replacement": " "},
                "clean": {"type": "whitespace_normalize"},
                "bullets": {"type": "bullet_points_to_list"},
                "absolute": {"type": "absolute_url", "base_url": "https://careers.example.com/x"},
            },
            "validation": {
                "job_id": [{"type": "not_empty"}, {"type": "numeric"}],
                "title": [{"type": "not_empty"}, {"type": "min_length", "value": 5}],
                "publish_date": [{"type": "valid_date"}],
                "salary_range": [{"type": "logical_range"}],
            },
        },
    }
)

# SQL of the links of every page: (page_id, page_url, pos, href).
LINKS_SQL = """
links AS (
  SELECT page_id, page_url, unnest(hrefs) AS href,
         CAST(generate_subscripts(hrefs, 1) - 1 AS BIGINT) AS pos
  FROM (SELECT page_id, url AS page_url, html,
               regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)
)"""

def decoded_sql(text: str) -> str:
    """SQL that decodes the entities of the sample pages; some lack their semicolon."""
    for entity, character in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        text = f"replace({text}, '{entity}', '{character}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def stripped_sql(part: str) -> str:
    """SQL for the text of a page part: pieces stripped, then joined without a blank."""
    pieces = f"trim(regexp_replace({part}, '\\s*<[^>]*>\\s*', '', 'g'), chr(32)||chr(10))"
    return decoded_sql(pieces)


def part_sql(tag: str) -> str:
    """SQL for the stripped text of a tag's first element in ``html``."""
    return stripped_sql(f"regexp_extract(html, '<{tag}[^>]*>(.*?)</{tag}>', 1, 's')")
