"""URL filtering: host rules first, then trust propagated over the links between hosts.

A host no rule decides is judged by two walks over the host graph, one row per pair of
hosts with links between them:

* trust: personalised PageRank from the hosts of allowed pages, along the links;
* distrust: personalised PageRank from the hosts of blocked pages, against the links, so
  that hosts linking to bad ones, or to hosts that do, share their distrust.

A host is blocked when its distrust is above ``ratio`` times its trust, and allowed
otherwise, so hosts the walks do not reach are allowed. Subdomains belong together: a host
is also linked with its parent domain, crawled or not, at the weight of one link each way.
Rank that leaves a host without links returns to the seeds, so both walks keep a sum of one
and can be compared.

Every step is a DataFrame operation; each round joins the ranks with the edges on the
linking host, sums partially before the shuffle, and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.llm.frames import ascii_lower, stored

#: (host, path prefix, verdict): fixed by the list that the query applies.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DAMPING, ROUNDS, RATIO = 0.85, 8, 1.0
#: Absolute or protocol-relative link targets in tags.
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct ``rule, verdict`` of the longest rule that fits, or null.

    A rule list is a parameter of the job, not a table: it becomes one expression, longest
    rule first (host and prefix together, then the later in the alphabet).
    """
    fits = None
    for domain, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        hit = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        found = F.struct(F.lit(f"{domain}{prefix}").alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(hit, found) if fits is None else fits.when(hit, found)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: links between different hosts, counted per pair."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    links = links.select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("link", r"(?i)^https?:", ""))).alias("dst"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    parents = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1).alias("dst"))
    known = parents.where("dst <> ''")
    both = known.union(known.select("dst", "src"))
    counted = links.where("src <> '' AND dst <> '' AND src <> dst").union(both)
    return counted.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def page_rank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``host, rank`` after ``rounds`` rounds from ``seeds`` (``host, seed``, summing to one).

    What does not move along an edge, the share ``1 - damping`` and the rank of hosts without
    links, returns to the seeds, so the ranks sum to one in every round.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = stored(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    ranks = seeds.select("host", F.col("seed").alias("rank"))
    for _ in range(rounds):
        moved = shares.join(ranks, shares["src"] == ranks["host"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share") * damping).alias("part"))
        moved = stored(moved, "moved")
        back = 1 - (moved.agg(F.sum("part")).first()[0] or 0.0)
        parts = moved.union(seeds.select("host", (F.col("seed") * back).alias("part")))
        ranks = stored(parts.groupBy("host").agg(F.sum("part").alias("rank")), "ranks")
    return ranks


def judged(pages: DataFrame, rules=RULES, ratio: float = RATIO, rounds: int = ROUNDS) -> DataFrame:
    """``row`` and ``host, path, rule, verdict, trust, distrust`` for every page.

    Seeds are hosts with pages a rule allows or blocks, weighed by the number of such
    pages. A null url or one without ``://`` has no host, fits no rule and is allowed.
    Null html has no links. An empty table gives an empty one.
    """
    url = F.col("url")
    ruled = pages.select(
        F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    counts = stored(
        ruled.where("found IS NOT NULL AND host <> ''").groupBy("host").agg(
            F.count_if(F.col("found.verdict") == "allow").alias("allow"), F.count_if(F.col("found.verdict") == "block").alias("block")
        ),
        "seeds",
    )
    total = counts.agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block")).first()
    seed = lambda c, n: counts.where(F.col(c) > 0).select("host", (F.col(c) / F.lit(float(n or 1))).alias("seed"))
    edges = stored(host_edges(pages), "edges")
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = page_rank(edges, seed("allow", total["all_allow"]), rounds).withColumnRenamed("rank", "trust")
    distrust = page_rank(reverse, seed("block", total["all_block"]), rounds).withColumnRenamed("rank", "distrust")
    hosts = stored(
        trust.join(distrust, "host", "full").select(
            "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
        ),
        "hosts",
    )
    # Sums of doubles depend on their order in the last digits; these are not for deciding.
    blocked = F.round(F.col("distrust") - F.lit(ratio) * F.col("trust"), 9) > 0
    joined = ruled.join(hosts, "host", "left")
    by_method = F.when(F.coalesce(blocked, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "row", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
