"""URL filters: rules for hosts and paths, and link-graph propagation for pages without a rule.

Hosts are the nodes, links between different hosts the edges. Every host starts with the share of
all pages that it has under an allowing rule (trust) and a blocking rule (distrust). Trust follows
the links (personalised PageRank); distrust goes against them, to the hosts that link to bad ones.
Both are divided by what the same walk gives when it starts from all pages, so they are shares of
a host's own importance and do not depend on its size. A host whose distrust is over its trust
by more than ``THRESHOLD`` is blocked.

All steps are joins and sums in Spark. Links are summed to one row per pair of hosts before the
walk, pages meet hosts only in sums and in the last join, where Spark splits a host of very many
pages.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.texts import staged

#: Verdict, host and path of each rule; a rule holds for its host and all subdomains.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DAMPING = 0.85
#: Rounds of the SQL twin; the walk itself goes on until it has settled.
ROUNDS = 20
THRESHOLD = 0.5
#: The walk has settled when no value moves by more than this share of its host's weight or gravity.
SETTLED = 1e-12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark or hash; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def link_hosts(html: Column, own: Column) -> Column:
    """The other hosts that a page links to, one entry per link; relative links stay on the host."""
    named = F.transform(
        F.regexp_extract_all(html, F.lit(LINK), F.lit(1)),
        lambda link: F.translate(F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), UPPER, LOWER),
    )
    return F.coalesce(F.filter(named, lambda host: (host != "") & (host != own)), F.array().cast("array<string>"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def walk(hosts: DataFrame, links: DataFrame, damping: float, rounds: int | None = None, settled: float = SETTLED) -> DataFrame:
    """``host, trust, distrust`` as shares of importance, from ``host, pages, good, bad`` and ``source, target, n``.

    A host without links in a direction keeps its value in that direction. Without ``rounds`` the
    walk goes on until it has settled, and raises if it has not when the damping says that it must.
    """
    out = links.groupBy("source").agg(F.sum("n").alias("out"))
    into = links.groupBy("target").agg(F.sum("n").alias("into"))
    ahead = links.join(out, "source").select(F.col("source").alias("host"), F.col("target").alias("to"), (F.col("n") / F.col("out")).alias("w"), F.lit(True).alias("ahead"))
    back = links.join(into, "target").select(F.col("target").alias("host"), F.col("source").alias("to"), (F.col("n") / F.col("into")).alias("w"), F.lit(False).alias("ahead"))
    ends = hosts.select("host").join(out, hosts["host"] == out["source"], "left_anti").select("host", F.col("host").alias("to"), F.lit(1.0).alias("w"), F.lit(True).alias("ahead"))
    starts = hosts.select("host").join(into, hosts["host"] == into["target"], "left_anti").select("host", F.col("host").alias("to"), F.lit(1.0).alias("w"), F.lit(False).alias("ahead"))
    edges = staged(ahead.union(back).union(ends).union(starts), "host-edges")
    kept = 1 - damping
    values = ["trust", "weight", "distrust", "gravity"]
    now = staged(
        hosts.select("host", F.col("good").alias("trust"), F.col("pages").alias("weight"), F.col("bad").alias("distrust"), F.col("pages").alias("gravity")),
        "host-values",
    )
    first = now
    done, most = 0, rounds
    while most is None or done < most:
        moved = edges.join(now, "host")
        sums = moved.groupBy(F.col("to").alias("host")).agg(
            *[F.sum(F.when(F.col("ahead") if v in ("trust", "weight") else ~F.col("ahead"), F.col("w") * F.col(v)).otherwise(0.0)).alias(f"_{v}") for v in values]
        )
        new = first.join(sums, "host").join(now.select("host", *[F.col(v).alias(f"{v}_") for v in values]), "host")
        new = new.select(
            "host",
            *[(kept * F.col(v) + damping * F.col(f"_{v}")).alias(v) for v in values],
            *[F.abs(kept * F.col(v) + damping * F.col(f"_{v}") - F.col(f"{v}_")).alias(f"{v}_") for v in values],
        )
        new = staged(new, "host-values")
        parts = [F.when(F.col(f"{v}_") > 0, F.col(f"{v}_") / F.col(of)).otherwise(0.0) for v, of in zip(values, ["weight", "weight", "gravity", "gravity"])]
        change = new.agg(F.max(reduce(F.greatest, parts))).first()[0]
        now = new.select("host", *values)
        done += 1
        if change is None or change <= settled:
            break
        if most is None:
            most = most_rounds(first, now, damping, settled)
    else:
        if rounds is None:
            raise RuntimeError(f"The walk has not settled after {done} rounds: {change} is over {settled}")
    return now.select(
        "host",
        F.when(F.col("weight") > 0, F.col("trust") / F.col("weight")).otherwise(0.0).alias("trust"),
        F.when(F.col("gravity") > 0, F.col("distrust") / F.col("gravity")).otherwise(0.0).alias("distrust"),
    )


def most_rounds(first: DataFrame, second: DataFrame, damping: float, settled: float) -> int:
    """Rounds after which no value can move by more than ``settled`` of its host's weight or gravity.

    Round k moves no more than ``damping ** k`` of all there is at first, and no host's weight or
    gravity gets under ``1 - damping`` of what it has after the first round (``second``).
    """
    values = ["trust", "weight", "distrust", "gravity"]
    largest = max(first.agg(*[F.sum(v) for v in values]).first())
    least = min(x for x in second.agg(*[F.min(F.when(F.col(v) > 0, F.col(v))) for v in ("weight", "gravity")]).first() if x is not None)
    return math.ceil(math.log(settled * (1 - damping) * least / largest) / math.log(damping)) + 1


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    damping: float = DAMPING,
    rounds: int | None = None,
    threshold: float = THRESHOLD,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row.

    A rule decides where one fits; else the host's trust and distrust do. Null urls and urls without
    ``://`` have empty host and path and are allowed, as nothing is known of them. Null html has no
    links. Repeated rows are judged each and count as often for their host; other columns are not
    read; an empty table gives an empty result.
    """
    read = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    parts = read.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, kind = rule_of(F.col("host"), F.col("path"), rules)
    parsed = staged(
        parts.select("page_id", "host", "path", name.alias("rule"), kind.alias("kind"), link_hosts(F.col("html"), F.col("host")).alias("targets")),
        "pages",
    )
    named = parsed.where("host <> ''")
    links = named.select(F.col("host").alias("source"), F.explode("targets").alias("target")).groupBy("source", "target").agg(F.count("*").alias("n"))
    links = staged(links, "links")
    total = max(1, named.count())
    counted = named.groupBy("host").agg(
        (F.count("*") / total).alias("pages"),
        (F.count_if(F.col("kind") == "allow") / total).alias("good"),
        (F.count_if(F.col("kind") == "block") / total).alias("bad"),
    )
    zero = F.lit(0.0)
    only_linked = links.select(F.col("target").alias("host")).distinct().join(counted, "host", "left_anti").select("host", zero.alias("pages"), zero.alias("good"), zero.alias("bad"))
    hosts = staged(counted.union(only_linked), "hosts")
    shares = walk(hosts, links, damping, rounds)
    bad = shares.where(F.col("distrust") - F.col("trust") > threshold).select("host", F.lit(True).alias("bad"))
    judged = parsed.join(bad, "host", "left")
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("kind", method).alias("verdict"))
