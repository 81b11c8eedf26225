"""Flow exports, log files, knowledge folders and threat bundles by Spark's readers; synthetic traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: IP protocol numbers of flow exports.
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP", 2: "IGMP", 47: "GRE", 50: "ESP", 53: "OTHER"}


def flow_export(spark: SparkSession, path: str) -> DataFrame:
    """CSV flow records with stripped header names; rows without time, addresses or ports that parse are dropped."""
    rows = spark.read.csv(path, header=True, mode="PERMISSIVE", inferSchema=False)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    number = lambda c: F.expr(f"try_cast(try_cast(`{c}` as double) as bigint)") if c in rows.columns else F.lit(0).cast("long")
    protocol = F.lit("OTHER")
    for n, name in PROTOCOLS.items():
        protocol = F.when(number("Protocol") == n, name).otherwise(protocol)
    flags = F.concat_ws(",", *[F.when(number(f"{f} Flag Count") > 0, F.lit(f)) for f in ("SYN", "ACK", "RST")])
    found = rows.select(
        F.try_to_timestamp(F.col("Timestamp"), F.lit("d/M/yyyy H:m[:s][.SSSSSS]")).alias("ts"), protocol.alias("protocol"), F.col("Source IP").alias("src_ip"), number("Source Port").cast("int").alias("src_port"),
        F.col("Destination IP").alias("dst_ip"), number("Destination Port").cast("int").alias("dst_port"), flags.alias("flags"),
        (number("Total Length of Fwd Packets") + number("Total Length of Bwd Packets")).alias("length"), (number("Total Fwd Packets") + number("Total Backward Packets")).alias("packets"), F.trim(F.col("Label")).alias("label"),
    )
    return found.where("ts is not null and src_ip is not null and dst_ip is not null and src_port is not null and dst_port is not null")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, numbered within each file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("block", "n")).cast("long")).select("file", "line", "value")


def knowledge_files(spark: SparkSession, path: str, shortest: int = 200) -> DataFrame:
    """Markdown, text and JSON files as items; shorter ones are left out, the title is the name without its end."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    name = F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B")))  # file names come as they stand in a URL
    return rows.where(F.length(F.trim("value")) >= shortest).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), F.col("value").alias("content"))


def attack_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Techniques of a STIX bundle that are not revoked, with their identifier and phases."""
    schema = "objects array<struct<type:string,name:string,revoked:boolean,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<phase_name:string>>>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("objects").alias("o")).where("o.type = 'attack-pattern' and not coalesce(o.revoked, false)")
    ids = F.filter(F.col("o.external_references"), lambda r: (r["source_name"] == "mitre-attack") & F.startswith(r["external_id"], F.lit("T")))
    return each.where(F.size(ids) > 0).select(F.get(ids, F.lit(0))["external_id"].alias("technique"), F.col("o.name").alias("name"), F.array_join(F.transform("o.kill_chain_phases", lambda p: p["phase_name"]), ",").alias("phases"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    digest = F.sha2("content", 256)
    return spark.read.format("binaryFile").load(path).select("path", digest.alias("sha256"), F.concat(F.lit("PCAP-"), F.substring(digest, 1, 16)).alias("case_id"))
