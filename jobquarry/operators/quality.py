"""Field types, mapping checks and the rules of a pattern file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.config import PatternConfig
from jobquarry.functions.json_types import document_keys, is_json, rank_type, with_field_ranks
from jobquarry.functions.text import strip
from jobquarry.operators.unnest import unnest


def infer_field_types(documents: DataFrame, document: str) -> DataFrame:
    """One row per field over all documents: the type that holds all its values.

    The maximum of the type ranks decides, so each task sends one row per field. Texts
    that are no JSON object have no fields; ``unreadable_documents`` counts them.
    """
    entries = unnest(with_field_ranks(documents, document, 1), F.map_entries("_ranks"), item="entry")
    return (
        entries.groupBy(F.col("entry.key").alias("field"))
        .agg(F.max("entry.value").alias("rank"))
        .select("field", rank_type(F.col("rank")).alias("field_type"))
    )


NOT_AN_OBJECT = "not an object"


def unreadable_documents(documents: DataFrame, document: str) -> DataFrame:
    """How many documents ``infer_field_types`` could not look into, by ``reason``."""
    text = F.col(document)
    reason = F.when(~is_json(text), F.lit(NOT_JSON)).when(document_keys(text).isNull(), F.lit(NOT_AN_OBJECT))
    return documents.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(
        F.count(F.lit(1)).alias("documents")
    )


def expected_types(mapping: dict, index: str | None = None) -> dict[str, str]:
    """Field types of an index mapping, as a search cluster exports it.

    Takes the export of one index (or the ``index`` entry of several), or its bare
    ``properties``.
    """
    if index is not None:
        mapping = mapping[index]
    mapping = mapping.get("mappings", mapping)
    mapping = mapping.get("properties", mapping)
    # A field with fields of its own carries no type and counts as an object.
    return {name: rule.get("type", "object") for name, rule in mapping.items()}


MISSING_KEY, TYPE_MISMATCH, NOT_JSON = "missing_key", "type_mismatch", "not_json"


def check_mapping(
    documents: DataFrame, document: str, expected: dict[str, str], *keep: str
) -> DataFrame:
    """All differences between documents and an expected field mapping.

    Rows are (``keep``, field, issue, got, expected). Each document is compared with the
    mapping in place, so nothing is shuffled. ``mapping_passed`` says who fails.
    """
    names = F.array(*(F.lit(name) for name in expected)).cast("array<string>")
    types = F.create_map(*(F.lit(x) for pair in expected.items() for x in pair)) if expected else None
    ranks, keys = F.col("_ranks"), F.col("_keys")
    issue = lambda name, kind, got, want: F.struct(
        name.alias("field"), F.lit(kind).alias("issue"), got.alias("got"), want.alias("expected")
    )
    nothing = F.lit(None).cast("string")
    want = lambda name: F.try_element_at(types, name)
    missing = F.transform(F.array_except(names, keys), lambda n: issue(n, MISSING_KEY, nothing, want(n)))
    compared = F.transform(F.map_entries(ranks), lambda e: issue(e["key"], TYPE_MISMATCH, rank_type(e["value"]), want(e["key"])))
    wrong = F.filter(compared, lambda i: ~i["got"].eqNullSafe(i["expected"]))
    unreadable = F.array(issue(nothing, NOT_JSON, nothing, nothing))
    # Only expected fields are typed; the keys are listed once.
    typed = with_field_ranks(documents, document, 2, *keep, names=list(expected))
    issues = F.when(ranks.isNull(), unreadable).otherwise(F.concat(missing, wrong))
    return unnest(typed, issues, *keep, item="_issue").select(*keep, "_issue.*")


def mapping_passed(documents: DataFrame, document: str, expected: dict[str, str], *keep: str) -> DataFrame:
    """A document passes when it is JSON and has every expected key, mismatches or not."""
    names = F.array(*(F.lit(name) for name in expected)).cast("array<string>")
    missing = F.array_except(names, document_keys(F.col(document)))
    return documents.select(*keep, F.coalesce(F.size(missing) == 0, F.lit(False)).alias("passed"))


# -- rules of the pattern file --------------------------------------------------------


def not_empty(value: Column) -> Column:
    return F.coalesce(F.length(strip(value)) > 0, F.lit(False))


def numeric(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9]+\z"), F.lit(False))


def min_length(value: Column, least: int) -> Column:
    return F.coalesce(F.length(value) >= least, F.lit(False))


def valid_date(value: Column) -> Column:
    return F.try_to_timestamp(value).isNotNull()


def logical_range(low: Column, high: Column) -> Column:
    return F.coalesce(low <= high, F.lit(True))


def rule_check(name: str, rule: dict) -> Column:
    """One entry of the ``validation`` section as a predicate."""
    kind = rule["type"]
    if kind == "not_empty":
        return not_empty(F.col(name))
    if kind == "numeric":
        return numeric(F.col(name))
    if kind == "min_length":
        return min_length(F.col(name), int(rule["value"]))
    if kind == "valid_date":
        return F.col(name).isNull() | valid_date(F.col(name))
    if kind == "logical_range":
        stem = name.removesuffix("_range")
        return logical_range(F.col(f"{stem}_min"), F.col(f"{stem}_max"))
    raise ValueError(f"unknown validation rule {kind!r} on {name}")


def violations(df: DataFrame, config: PatternConfig) -> DataFrame:
    """Adds ``violations``: the broken rules of each row as ``field:rule``."""
    broken = [
        F.when(~rule_check(name, rule), F.lit(f"{name}:{rule['type']}"))
        for name, rules in config.section("validation").items()
        for rule in rules
    ]
    if not broken:
        return df.withColumn("violations", F.array().cast("array<string>"))
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


SKIP_RECORD, USE_DEFAULT, RAISE_ERROR = "skip_record", "use_default", "raise_error"


def on_violation(
    df: DataFrame, action: str, ok: dict[str, Column], defaults: dict[str, Column] | None = None
) -> DataFrame:
    """The configured reaction to broken fields; ``ok`` maps a field to its predicate.

    ``skip_record`` adds ``set_aside``, so that kept and skipped rows come from one
    pass; ``use_default`` puts in the field's default; ``raise_error`` fails the job.
    """
    if action == USE_DEFAULT:
        return df.withColumns(
            {name: F.when(test, F.col(name)).otherwise(defaults[name]) for name, test in ok.items()}
        )
    good = F.lit(True)
    for test in ok.values():
        good = good & F.coalesce(test, F.lit(False))
    if action == SKIP_RECORD:
        return df.withColumn("set_aside", ~good)
    if action == RAISE_ERROR:
        name = next(iter(ok))
        stop = F.raise_error(F.concat(F.lit("rule broken: "), F.to_json(F.struct(*ok))))
        checked = F.when(good, F.col(name)).otherwise(stop.cast(df.schema[name].dataType))
        return df.withColumn(name, checked)
    raise ValueError(f"unknown reaction {action!r}")


def missing_required(
    df: DataFrame, config: PatternConfig, *names: str, defaults: dict[str, Column] | None = None
) -> DataFrame:
    """The reaction the pattern file sets for rows without a key field (default: skip)."""
    action = config.section("error_handling").get("missing_required_fields") or SKIP_RECORD
    return on_violation(df, action, {name: not_empty(F.col(name)) for name in names}, defaults)
