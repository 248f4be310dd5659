"""The type a search index would give a JSON value."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# In a mix of types the later one wins.
TYPE_ORDER = ["text", "boolean", "long", "float", "object"]


_WIDE_INTEGER = r"DECIMAL\((19|[23]\d),0\)"


def _kind_rank(kind: Column) -> Column:
    """1-based place of a variant type name in ``TYPE_ORDER``; null for null and arrays.

    A variant stores 1.0 as a decimal without a fraction, while whole numbers are
    BIGINT unless they need 19 digits or more.
    """
    return (
        F.when(kind == "STRING", 1)
        .when(kind == "BOOLEAN", 2)
        .when((kind == "BIGINT") | kind.rlike(f"^{_WIDE_INTEGER}$"), 3)
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), 4)
        .when(kind.startswith("OBJECT"), 5)
    )


def value_rank(value: Column, list_levels: int) -> Column:
    """Rank of a value, looking into lists up to ``list_levels`` deep.

    A column of values is looked into one level (its values may be lists). A single
    document's list counts as a column itself, so its own lists are looked into too.
    """
    kind = F.schema_of_variant(value)
    if list_levels == 0:
        return _kind_rank(kind)
    # A list of one plain type says so as a whole; only mixed or nested ones are opened.
    plain = kind.rlike(r"^ARRAY<(STRING|BOOLEAN|BIGINT|DOUBLE|DECIMAL\((\d|1[0-8]),\d+\))>$")
    inner = F.array_max(
        F.transform(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda item: value_rank(item, list_levels - 1),
        )
    )
    return (
        F.when(~kind.startswith("ARRAY"), _kind_rank(kind))
        .when(plain, _kind_rank(F.regexp_extract(kind, "^ARRAY<(.*)>$", 1)))
        .otherwise(inner)
    )


def rank_type(rank: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, TYPE_ORDER)), rank.cast("int"))


# As a JSON library reads: NaN and infinities are numbers, quotes are double.
JSON_OPTIONS = {"allowNonNumericNumbers": "true", "allowSingleQuotes": "false"}


def one_value(document: Column, kind: str) -> Column:
    """The text as one JSON value of a type; null unless it is one value and nothing after it.

    It is read as the one element of an array, which no other text gives. A repeated key
    counts with its last value, and there is no limit of size but that of a string.
    """
    items = F.from_json(F.concat(F.lit("["), document, F.lit("]")), f"array<{kind}>", JSON_OPTIONS)
    # One lambda variable: the text is parsed once, not once per use.
    single = F.transform(F.array(items), lambda found: F.when(F.size(found) == 1, F.get(found, 0)))
    return F.get(single, 0)


def is_json(document: Column) -> Column:
    """Whether a text is one JSON value and nothing after it."""
    items = F.from_json(F.concat(F.lit("["), document, F.lit("]")), "array<string>", JSON_OPTIONS)
    return F.coalesce(F.size(items) == 1, F.lit(False))


def document_fields(document: Column) -> Column:
    """A JSON object as map of field to variant; null when it is not one object.

    Null as well when an object inside it repeats a key, which a variant cannot hold.
    """

    def last_of_each(fields: Column) -> Column:
        keys = F.map_keys(fields)
        later = lambda i: F.slice(keys, i + 2, F.size(keys))
        last = F.filter(F.map_entries(fields), lambda entry, i: ~F.array_contains(later(i), entry["key"]))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), fields).otherwise(F.map_from_entries(last))

    return F.get(F.transform(F.array(one_value(document, "map<string,variant>")), last_of_each), 0)


def document_keys(document: Column) -> Column:
    """The keys of a JSON object; null when the text is not one."""
    return F.map_keys(one_value(document, "map<string,string>"))


def with_field_ranks(documents: DataFrame, document: str, list_levels: int, *keep: str, names: list[str] | None = None) -> DataFrame:
    """``keep``, the ``_keys`` of a JSON object and the ``_ranks`` of its values' types.

    Both are null for a text that is not one object. ``names`` leaves other fields out of
    the ranks. Fields are typed as variants; where an object has no variant form (an inner
    object repeats a key, or it is too large), its text is read by the JSON library instead,
    which gives the same ranks.
    """
    known = F.array(*map(F.lit, names or [])).cast("array<string>")

    def typed(fields: Column) -> Column:
        kept = fields if names is None else F.map_filter(fields, lambda k, _: F.array_contains(known, k))
        return F.transform_values(kept, lambda _, v: value_rank(v, list_levels))

    text = F.col(document)
    # Outer generators of one row each, so that nothing is parsed once per use.
    by_variant = F.get(F.transform(F.array(document_fields(text)), typed), 0)
    read = documents.select(*keep, text.alias("_text"), F.explode_outer(F.array(F.struct(by_variant.alias("ranks"), document_keys(text).alias("keys")))).alias("_read"))
    others = _ranks_of_text(list_levels, names)(F.when(F.col("_read.ranks").isNull(), F.col("_text")))
    both = read.select(*keep, "_read", F.explode_outer(others).alias("_other"))
    return both.select(*keep, F.col("_read.keys").alias("_keys"), F.coalesce("_read.ranks", "_other").alias("_ranks"))


def _ranks_of_text(list_levels: int, names: list[str] | None):
    def rank(value, levels: int) -> int | None:
        if isinstance(value, bool):
            return 2
        if isinstance(value, int):
            return 3 if abs(value) < 10**38 else 4
        if isinstance(value, (str, float, dict)):
            return {str: 1, float: 4, dict: 5}[type(value)]
        if isinstance(value, list) and levels:
            return max((r for r in (rank(v, levels - 1) for v in value) if r), default=None)
        return None

    @F.arrow_udf("array<map<string,int>>")
    def ranks(batch: pa.Array) -> pa.Array:
        def one(text: str | None):
            try:
                found = json.loads(text) if text is not None else None
            except (ValueError, RecursionError):
                return None
            if not isinstance(found, dict):
                return None
            return [[(k, rank(v, list_levels)) for k, v in found.items() if names is None or k in names]]

        return pa.array((one(t.as_py()) for t in batch), pa.list_(pa.map_(pa.string(), pa.int32())))

    return ranks
