"""All queries of the library but those of the training-data subpackage."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .operators.rules import all_alerts
from .plans import assess, checks, context, exchange, knowledge, live, models, records, reports, traffic
from .sources.packets import packets_from_events, table

_PLANS = (traffic, records, knowledge, checks, live, models, context, assess, exchange, reports)


def queries() -> dict:
    return {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of every rule, with thresholds for the smallest tables."""
    small = replace(traffic.SCALED, syn_flood_min=8, port_scan_min=5, dns_tunnel_min=4, rst_storm_min=6, udp_flood_min=5, dns_amp_responses=3)
    return all_alerts(packets_from_events(table(spark, sf_dir, "events")), small)
