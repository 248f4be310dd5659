"""Which of very many words and phrases occur in texts: a join of tokens, not a regex each.

``extract_skills`` looks for every pattern in every text, which is right for the patterns
of a pattern file. A dictionary of thousands of skills is a table here: a text is cut into
its runs of one to as many words as the longest phrase has, once, and the distinct runs
are joined with the dictionary. The work per text is its length, whatever the dictionary's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.session import stored

#: A word, as ``\b`` bounds it in a pattern of a pattern file: letters, digits and underscores.
TOKEN = r"[\p{L}\p{M}\p{N}_]+"


def tokens(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def first_words(text: Column) -> Column:
    """The first two words of a text, of a blank between; null where it has fewer. No more of the text is read."""
    other = TOKEN.replace("[", "[^", 1)
    pattern = rf"\A{other[:-1]}*({TOKEN}){other}({TOKEN})"
    pair = F.concat_ws(" ", *(F.regexp_extract(F.lower(text), pattern, i) for i in (1, 2)))
    return F.when(text.isNotNull() & (pair != " "), pair)


def phrases(words: Column, longest: int) -> Column:
    """The distinct runs of 1 to ``longest`` words, words joined by a blank."""

    def of_length(w: Column, n: int) -> Column:
        if n == 1:
            return w
        # A run is put together from its words; no array is made for it.
        begins = F.slice(w, F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(0)))
        return F.transform(begins, lambda first, i: F.concat_ws(" ", first, *(F.get(w, i + k) for k in range(1, n))))

    def of(w: Column) -> Column:
        return F.array_distinct(F.concat(*(of_length(w, n) for n in range(1, longest + 1))))

    # One lambda variable, so that the words are cut out once and not once per use.
    return F.flatten(F.transform(F.array(words), of))


def match_keywords(texts: DataFrame, text: str, keywords: DataFrame, keyword: str, *keep: str) -> DataFrame:
    """``keep`` and ``keywords``: the distinct entries of the dictionary found in each text.

    ``keep`` must tell the texts apart. An entry matches where its words stand next to each
    other in the text, in any case and with anything but words between them. Entries
    without a word match nothing; entries that differ only in case or signs are all given.
    Texts without a match, null ones too, have an empty list.
    """
    listed = stored(
        keywords.select(F.col(keyword).alias("_name"), tokens(F.col(keyword)).alias("_words"))
        .where(F.size("_words") > 0).select("_name", F.array_join("_words", " ").alias("_run"), F.size("_words").alias("_n")).distinct(),
        "keywords",
    )
    longest = listed.agg(F.max("_n")).first()[0]
    none = F.array().cast("array<string>")
    if longest is None:
        return texts.select(*keep, none.alias("keywords"))
    # The outer form: from a plain explode Spark derives a filter that finds all runs a second time.
    runs = texts.select(*keep, F.explode_outer(phrases(tokens(F.col(text)), longest)).alias("_run"))
    # The dictionary is a stored table, so Spark knows its size and broadcasts a small one.
    hits = runs.join(listed.select("_run", "_name"), "_run").groupBy(*keep).agg(F.array_sort(F.collect_set("_name")).alias("_found"))
    found = hits.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keep)), "_found")
    same = F.lit(True)
    for i, k in enumerate(keep):
        same = same & texts[k].eqNullSafe(found[f"_{i}"])
    return texts.join(found, same, "left").select(*(texts[k] for k in keep), F.coalesce("_found", none).alias("keywords"))
