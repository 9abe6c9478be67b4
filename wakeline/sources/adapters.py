"""The test tables as telemetry: normalised events, source coverage, ground truth, entity aliases.

All rules are integer arithmetic on the events table, so that SQL can state them too (see wakeline.plans.ctes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z in microseconds; event times are drawn together towards it by this factor.
EPOCH_US, SQUEEZE = 1_704_067_200_000_000, 200
SECOND = 1_000_000
COVERAGE_S = 600
TRUTH_S = 1800
#: Sources that every run expects, with a number that their health rules use.
INSTANCES = [("EDR", "edr-target-01", 0), ("EDR", "edr-target-02", 1), ("NDR", "ndr-gateway-01", 2)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(prefix: str, number: Column, width: int = 9) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def run_id() -> Column:
    return id_text("run:", F.floor(F.col("user_id") / 10).cast("long"))


def norm_events(events: DataFrame) -> DataFrame:
    """One normalised event per row of the events table; a run_id that it has been given (dealt by) is kept as it is."""
    u, kind = F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    event_us = F.lit(EPOCH_US) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / SQUEEZE).cast("long")
    lag = F.when(k >= 98, 1500).when(k >= 95, 400).otherwise(k % 7)
    edr = kind.isin("signup", "error")
    run = F.floor(u / 10).cast("long")
    family = F.when(kind == "signup", "remote_session").when(kind == "error", "file_change")
    protocol = F.when(kind == "purchase", "ssh").when(kind == "click", "http")
    ip = F.concat(F.lit("ip:10."), F.floor(u / 65536).cast("string"), F.lit("."), (F.floor(u / 256) % 256).cast("string"), F.lit("."), (u % 256).cast("string"))
    thing = F.when(k % 25 == 0, F.concat(F.lit("obj:shared:"), run.cast("string"))).when(kind == "purchase", F.concat(F.lit("ip:192.168.0."), (k % 20).cast("string"))).when(kind == "click", F.concat(F.lit("ip:93.184.216."), (k % 20).cast("string"))).otherwise(F.concat(F.lit("obj:"), u.cast("string"), F.lit(":"), (k % 20).cast("string")))
    return events.select(
        (F.col("run_id") if "run_id" in events.columns else run_id()).alias("run_id"),
        id_text("ev:", F.col("event_id"), 12).alias("event_id"),
        event_us.alias("event_us"),
        (event_us + lag * SECOND).alias("ingest_us"),
        F.when(edr, "EDR").otherwise("NDR").alias("source_family"),
        F.when(edr, F.concat(F.lit("edr-target-0"), (u % 2 + 1).cast("string"))).otherwise("ndr-gateway-01").alias("source_instance"),
        F.when(edr, id_text("user:", u)).otherwise(ip).alias("subject"),
        thing.alias("object"),
        F.when(edr, F.concat(F.lit("process.start."), family)).otherwise("network.flow").alias("action"),
        F.concat(F.lit("g:"), u.cast("string"), F.lit(":"), F.floor(k / 10).cast("string")).alias("dependency_group"),
        family.alias("command_family"),
        protocol.alias("protocol"),
        F.when(~edr, F.when(kind == "purchase", "alert").when(kind == "click", "http").otherwise("flow")).alias("eve_event_type"),
        F.when(~edr, F.least(F.col("value") / 500, F.lit(1.0))).alias("severity"),
        id_text("user:", u).alias("endpoint_key"),
        F.when(k % 50 != 49, F.when(k % 40 == 39, "host-x").otherwise(F.concat(F.lit("host-"), (u % 5).cast("string")))).alias("endpoint_host"),
        F.when(edr & (k % 33 != 0), F.when(k % 20 == 19, "p2").otherwise("p1")).alias("parent_pid"),
        k.alias("k"),
    )


def aliases(events: DataFrame) -> DataFrame:
    """alias -> entity: the address of a user's machine stands for the user."""
    u = F.col("user_id")
    ip = F.concat(F.lit("ip:10."), F.floor(u / 65536).cast("string"), F.lit("."), (F.floor(u / 256) % 256).cast("string"), F.lit("."), (u % 256).cast("string"))
    return events.select("user_id").distinct().select(ip.alias("alias"), id_text("user:", u).alias("entity"))


def coverage(norm: DataFrame) -> DataFrame:
    """Health of each expected source of a run, in half-open intervals of ten minutes; some intervals were never reported."""
    width = COVERAGE_S * SECOND
    spans = norm.groupBy("run_id").agg(F.floor(F.min("event_us") / width).alias("first_no"), F.floor(F.max("event_us") / width).alias("last_no"))
    sources = F.array(*[F.struct(F.lit(f).alias("source_family"), F.lit(i).alias("source_instance"), F.lit(n).alias("no")) for f, i, n in INSTANCES])
    rows = spans.select("run_id", F.explode(F.sequence("first_no", "last_no")).alias("interval_no")).select("run_id", "interval_no", F.explode(sources).alias("s")).select("run_id", "interval_no", "s.*")
    i, n = F.col("interval_no"), F.col("no")
    sick = (i * 7 + n) % 11
    rows = rows.filter((i * 3 + n) % 19 != 0)
    return rows.select(
        "run_id", "source_family", "source_instance", i.alias("interval_no"), (i * width).alias("start_us"), ((i + 1) * width).alias("end_us"),
        F.when(sick == 0, "down").when(sick == 1, "degraded").when(sick == 2, "unknown").otherwise("healthy").alias("health"),
        ((i * 5 + n) % 13 != 0).alias("parser_valid"), ((i * 3 + n) % 17 != 0).alias("transport_live"), (i % 7).cast("double").alias("lag_s"),
    )


def truth_groups(norm: DataFrame) -> DataFrame:
    """Ground truth, kept apart from the online frames: a user's half hour with endpoint activity of at least two events."""
    bucket = F.floor(F.col("event_us") / (TRUTH_S * SECOND))
    groups = norm.groupBy("run_id", "endpoint_key", bucket.alias("bucket")).agg(
        F.min("event_us").alias("start_us"), F.max("event_us").alias("end_us"), F.array_sort(F.collect_set(F.when(F.col("source_family") == "EDR", F.col("action")))).alias("required_tokens"), F.count(F.lit(1)).alias("n"),
    )
    groups = groups.filter((F.size("required_tokens") > 0) & (F.col("n") >= 2))
    return groups.select("run_id", F.concat("endpoint_key", F.lit("@"), F.col("bucket").cast("string")).alias("group_id"), "start_us", "end_us", F.col("endpoint_key").alias("entity"), "required_tokens", F.array("endpoint_key").alias("entities"))
