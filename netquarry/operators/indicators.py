"""Indicators of a report met with what a capture shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def domain_name(text: Column) -> Column:
    """Lower case, without the root's dot and blanks."""
    return F.lower(F.rtrim(F.trim(text), F.lit(".")))


def suffixes(name: Column) -> Column:
    """A name and the names above it: a.b.c, b.c, c."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def domains_in_capture(packets: DataFrame, listed: DataFrame) -> DataFrame:
    """(indicator, domain, packets) of queried names that a listed domain (column ``domain``) covers: itself or one below it.

    Distinct names are cut into their suffixes, a handful each, and these meet the list by equality: no name is compared with every domain.
    """
    known = listed.select(domain_name(F.col("domain")).alias("indicator")).where("indicator <> ''").distinct()
    seen = packets.select(domain_name(F.col("dns_query")).alias("domain")).where("domain <> ''").groupBy("domain").agg(F.count(F.lit(1)).alias("packets"))
    cut = seen.withColumn("indicator", F.explode(suffixes(F.col("domain"))))
    return cut.join(known, "indicator").select("indicator", "domain", "packets")


def addresses_in_capture(packets: DataFrame, listed: DataFrame) -> DataFrame:
    """(indicator, packets) of listed addresses (column ``ip``) that the capture's packets go to."""
    seen = packets.where("dst_ip <> ''").groupBy(F.col("dst_ip").alias("indicator")).agg(F.count(F.lit(1)).alias("packets"))
    return seen.join(listed.select(F.trim("ip").alias("indicator")).distinct(), "indicator").select("indicator", "packets")


def cross_check(packets: DataFrame, domains: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row: listed domains and addresses, names and addresses seen, and those met."""
    hit_domains, hit_ips = domains_in_capture(packets, domains), addresses_in_capture(packets, addresses)
    one = packets.agg(F.count_distinct(F.when(F.col("dns_query") != "", domain_name(F.col("dns_query")))).alias("seen_domains"), F.count_distinct(F.when(F.col("dst_ip") != "", F.col("dst_ip"))).alias("seen_ips"))
    for part in (
        domains.agg(F.count_distinct(domain_name(F.col("domain"))).alias("listed_domains")), addresses.agg(F.count_distinct(F.trim("ip")).alias("listed_ips")),
        hit_domains.agg(F.count_distinct("indicator").alias("hit_domains")), hit_ips.agg(F.count(F.lit(1)).alias("hit_ips")),
    ):
        one = one.crossJoin(F.broadcast(part))  # one row each
    return one
