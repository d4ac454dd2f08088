"""Allow-lists of any length as a table: the most specific rule of an address decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lekhya.functions.text import strip
from lekhya.operators.ingest import url_host, url_path, url_scheme
from lekhya.operators.scale import join_small
from lekhya.session import stage


def _suffixes(host: Column) -> Column:
    """A host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))


def clean_rules(rules: DataFrame) -> DataFrame:
    """Rules as they are applied: host in lower case without a leading dot, blank ones left out;
    of rules with the same host and prefix a refusal wins, and a missing ``allow`` refuses."""
    host = F.regexp_replace(F.lower(strip(F.col("host"))), r"^\.+", "")
    kept = rules.select(host.alias("host"), strip(F.col("prefix")).alias("prefix"),
                        F.coalesce("allow", F.lit(False)).alias("allow"))
    return (kept.filter("host <> '' AND prefix <> ''").groupBy("host", "prefix")
            .agg(F.bool_and("allow").alias("allow")))


def decide(items: DataFrame, rules: DataFrame, url: str = "url", allowed: str = "allowed",
           rule: str = "rule") -> DataFrame:
    """Add whether a rule (host, prefix, allow) permits each address, and the rule that says so.

    A rule covers its host and the subdomains of it, below a path that begins with its prefix;
    the longest host decides, then the longest prefix.  An address without a rule, a null
    address and any scheme but http and https are refused with a null ``rule``.

    Each distinct host and path is looked up once, under its host suffixes and under prefixes of
    the lengths that rules of that host have, so the work grows with the addresses and not with
    the rules.  Rules are broadcast up to a checked number, and joined by salted shuffles beyond.
    """
    web = url_scheme(F.col(url)).isin("http", "https")
    place = F.when(web, F.struct(url_host(F.col(url)).alias("host"),
                                 url_path(F.col(url)).alias("path")))
    table = stage(clean_rules(rules))
    lengths = table.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    places = stage(items.select(place.alias("place")).filter("place IS NOT NULL").distinct())
    named = places.select("place", F.col("place.path").alias("path"),
                          F.explode(_suffixes(F.col("place.host"))).alias("host"))
    known = join_small(named, lengths, ["host"], "place", "inner")
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    cut = known.select("place", "path", "host", F.explode(fitting).alias("n"))
    cut = cut.select("place", "host", F.expr("substring(path, 1, n)").alias("prefix"))
    hits = join_small(cut, table, ["host", "prefix"], "place", "inner")
    best = hits.groupBy("place").agg(F.max_by(
        F.struct("host", "prefix", "allow"),
        F.struct(F.length("host"), F.length("prefix"))).alias("_rule"))
    key = "_place" + "_" * max(len(c) for c in items.columns)    # a name no column has
    marked = items.withColumn(key, place)
    joined = marked.join(best, marked[key] == best["place"], "left")
    said = best["_rule"]
    return joined.select(
        *[marked[f"`{c}`"] for c in items.columns],
        F.coalesce(said["allow"], F.lit(False)).alias(allowed),
        F.when(said.isNotNull(), F.struct(said["host"].alias("host"),
                                          said["prefix"].alias("prefix"))).alias(rule))
