"""String functions with Python's meaning, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python strips as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Marks that open a bulleted line.
BULLETS = "•-*▪‣▸"
LONG_LINE = 10

_CASED_RUN = r"([\p{IsUppercase}\p{IsLowercase}\p{Lt}]+|[^\p{IsUppercase}\p{IsLowercase}\p{Lt}]+)"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def empty_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def normalize_space(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, f"[{WHITESPACE}]+", " "), F.lit(" "))


def title_case(value: Column) -> Column:
    """Every run of cased letters gets one capital; ``initcap`` only knows blanks."""

    def capital(run: Column) -> Column:
        first = F.upper(F.left(run, F.lit(1)))  # may be longer: the sharp s gives two letters
        rest = F.concat(F.substr(first, F.lit(2)), F.substr(run, F.lit(2)))
        return F.concat(F.left(first, F.lit(1)), F.lower(rest))

    runs = F.regexp_extract_all(value, F.lit(_CASED_RUN), F.lit(1))
    return F.array_join(F.transform(runs, capital), "")


def split_bullets(value: Column) -> Column:
    """A text block as list items.

    Bulleted lines lose their mark, other lines count when they are long enough, and a
    block without any such line is one item.
    """
    lines = F.transform(F.split(value, "\n"), strip)
    items = F.transform(
        lines,
        lambda line: F.when(
            line.rlike("^[•\\-*▪‣▸]"),
            strip(F.ltrim(line, F.lit(BULLETS + " "))),
        ).when(F.length(line) > LONG_LINE, line),
    )
    whole = F.filter(F.array(strip(value)), lambda text: text != "")
    # The first of both that holds something, so that neither is computed twice.
    choices = F.array(F.filter(items, lambda item: item != ""), whole)
    chosen = F.get(F.filter(choices, lambda choice: F.size(choice) > 0), 0)
    return F.coalesce(chosen, F.when(value.isNotNull(), F.array().cast("array<string>")))


def number_or_null(text: Column) -> Column:
    """Text to double; anything that is not a plain number gives null."""
    plain = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(plain, text.try_cast("double"))


def float_text(value: Column) -> Column:
    """A double as Python prints it: no exponent between 1e-4 and 1e16.

    Java has none between 1e-3 and 1e7; only the rest is rewritten.
    """
    plain = F.regexp_replace(
        value.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1"
    )
    scientific = value.cast("string")
    for pattern, replacement in (
        (r"\.0E", "E"), ("E-", "e-"), (r"E(\d)", "e+$1"), (r"e([+-])(\d)$", "e$10$2"),
    ):
        scientific = F.regexp_replace(scientific, pattern, replacement)
    size = F.abs(value)
    return (
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), value.cast("string"))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
