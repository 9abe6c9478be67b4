"""Detector values of events, their deduplication, normalisation against a cohort, and feature vectors."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Detector scores by command family, by flow type and by transfer protocol.
PROCESS = {"process_execution": 0.20, "discovery": 0.35, "http_client": 0.40, "network_scan": 0.45, "archive": 0.55, "file_change": 0.60, "service_admin": 0.65, "file_transfer": 0.75, "remote_session": 0.80, "package_manager": 0.20}
REMOTE = {"remote_session": 0.90, "file_transfer": 0.70}
PERSISTENCE = {"file_change": 0.55, "service_admin": 0.65, "package_manager": 0.25}
FLOW = {"alert": 0.60, "http": 0.25, "dns": 0.20, "tls": 0.20, "flow": 0.15}
TRANSFER = {"ssh": 0.65, "smb": 0.85, "nfs": 0.85, "ftp": 0.80, "http": 0.45}
LATERAL = 0.90
#: Private, loopback and link-local IPv4 ranges, which is all that the tables' addresses need: for the SQL alone.
PRIVATE = r"^[^:]*:(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|127\.|169\.254\.)"


# IPv4 blocks that are not public (first address, number of leading bits), and patterns of IPv6 addresses that are not.
BLOCKS = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4)]
IPV6 = r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:0?db8:|2001:0?1[0-9a-f]{2}:|2001:[0-9a-f]?[0-9a-f]?:|100::)"


def private_address(address: Column) -> Column:
    """Is an IPv4 or IPv6 address private, local or reserved; null for what is no address."""
    octets = F.transform(F.split(address, r"\."), lambda o: o.cast("long"))
    valid = address.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$") & (F.array_max(octets) <= 255)
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    ranges = [(low := sum(int(o) << 8 * (3 - i) for i, o in enumerate(first.split("."))), low + (1 << 32 - bits) - 1) for first, bits in BLOCKS]
    # The address is bound to a name, else it is taken apart again for each end of each block.
    inside = F.exists(F.array(number), lambda n: reduce(or_, [n.between(low, high) for low, high in ranges]))
    return F.when(valid, inside).when(address.contains(":") & address.rlike("^[0-9A-Fa-f:]+$"), F.lower(address).rlike(IPV6))


def lookup(values: dict[str, float], key: Column, default: float | None = None) -> Column:
    out = F.lit(default).cast("double")
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def is_private(entity: Column) -> Column:
    """Does an entity (kind:value) name an address that is private, local or reserved?"""
    return F.coalesce(private_address(F.regexp_replace(entity, "^[^:]*:", "")), F.lit(False))


#: The columns of an event that detector_values and what follows it read.
READS = ["source_family", "command_family", "protocol", "subject", "object", "eve_event_type", "severity", "dependency_group"]


def detector_values(events: DataFrame) -> DataFrame:
    """One row for each value that a detector gives for an event: all columns of events, detector_id, value."""
    return events.select("*", F.inline(event_values()))


def event_values() -> Column:
    """What detectors give for an event: structs of detector_id and value."""
    edr, family, protocol = F.col("source_family") == "EDR", F.coalesce("command_family", F.lit("process_execution")), F.lower("protocol")
    lateral = F.coalesce(protocol == "ssh", F.lit(False)) & is_private(F.col("subject")) & is_private(F.col("object"))
    each = [
        ("edr.process_anomaly.v1", F.when(edr, lookup(PROCESS, family, 0.20))),
        ("edr.remote_execution.v1", F.when(edr, lookup(REMOTE, family))),
        ("edr.persistence_change.v1", F.when(edr, lookup(PERSISTENCE, family))),
        ("ndr.flow_anomaly.v1", F.when(~edr, F.greatest(lookup(FLOW, F.coalesce("eve_event_type", F.lit("flow")), 0.15), F.coalesce("severity", F.lit(0.0))))),
        ("ndr.lateral_session.v1", F.when(~edr & lateral, F.lit(LATERAL))),
        ("ndr.transfer_anomaly.v1", F.when(~edr, lookup(TRANSFER, protocol))),
    ]
    return F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(name).alias("detector_id"), v.alias("value"))) for name, v in each]))


def deduplicate(values: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope, family, detector and dependency group: the largest value, ties to the smallest digest of the event id."""
    key = [*scope, "source_family", "detector_id", "dependency_group"]
    best = F.min(F.struct((-F.col("value")).alias("v"), F.sha2(F.col("event_id").cast("binary"), 256).alias("digest"), F.col("event_id").alias("event_id")))
    return values.groupBy(*key).agg(best.alias("b")).select(*key, (-F.col("b.v")).alias("value"), F.col("b.event_id").alias("event_id"))


def ecdf(values: DataFrame, cohort: DataFrame, uncovered: str = "raise") -> DataFrame:
    """Adds normalized = (cohort values below + half of those equal) / cohort size, by detector.

    No value is dropped: one of a detector that the cohort does not hold fails the job, or with uncovered="null" gets null.
    Both sides are first counted by distinct value, so the running sum of a detector goes over distinct values only.
    """
    return values.join(ecdf_table(values, cohort, uncovered), ["detector_id", "value"])


def ecdf_table(values: DataFrame, cohort: DataFrame, uncovered: str = "raise") -> DataFrame:
    """detector_id, value, normalized: a row for each distinct value. See ecdf."""
    asked = values.select("detector_id", "value", F.lit(0).alias("n")).distinct()
    known = cohort.groupBy("detector_id", "value").agg(F.count(F.lit(1)).alias("n"))
    both = asked.unionByName(known).groupBy("detector_id", "value").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("detector_id").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = both.withColumn("through", F.sum("n").over(upto))
    size = cohort.groupBy("detector_id").agg(F.count(F.lit(1)).alias("size"))
    share = (F.col("through") - F.col("n") + F.col("n") * 0.5) / F.col("size")
    if uncovered == "raise":
        share = F.when(F.col("size").isNull(), F.raise_error(F.concat(F.lit("the cohort does not cover "), "detector_id")).cast("double")).otherwise(share)
    return ranked.join(size, "detector_id", "left").select("detector_id", "value", share.alias("normalized"))


def feature_vectors(normalized: DataFrame, scope: list[str], top: int = 3) -> DataFrame:
    """Per scope: d (mean of the three largest normalized values, added in descending order), c, counts and what was detected."""
    order = Window.partitionBy(*scope).orderBy(F.desc("normalized"), "detector_id", "dependency_group")
    ranked = normalized.withColumn("at", F.row_number().over(order))
    firsts = [F.max(F.when(F.col("at") == i, F.col("normalized"))) for i in range(1, top + 1)]
    total = firsts[0]
    for f in firsts[1:]:
        total = total + F.coalesce(f, F.lit(0.0))
    n = F.count(F.lit(1))
    edr, ndr = (F.max((F.col("source_family") == f).cast("int")) for f in ("EDR", "NDR"))
    return ranked.groupBy(*scope).agg((total / F.least(n, F.lit(top))).alias("d"), (edr * ndr).alias("c"), n.alias("eligible_count"), edr.alias("edr_detected"), ndr.alias("ndr_detected"))


def growing_vectors(moments: DataFrame, values: DataFrame, scope: list[str], moment: str, keep: list[str], top: int = 3) -> DataFrame:
    """feature_vectors at each moment of scopes that only grow, also where no value is eligible (d and the counts are 0).

    moments: scope, moment and the columns to keep. values: scope, source_family, detector_id, dependency_group, normalized, and since, the moment from
        a value counts. A value's share never falls with the value, so the largest share of a group is that of its largest value. Both sides should
    be partitioned by scope: a moment meets its scope's steps as one list, so nothing is sorted or grouped in the size of moments times steps.
    """
    group = Window.partitionBy(*scope, "source_family", "detector_id", "dependency_group").orderBy("since", F.desc("normalized"))
    # A group's share only rises: each larger one holds until the next, so that a moment meets one row a group.
    before = F.max("normalized").over(group.rowsBetween(Window.unboundedPreceding, -1))
    steps = values.withColumn("_before", before).filter("_before IS NULL OR normalized > _before").withColumn("until", F.lead("since").over(group))
    step = F.struct("since", "until", "normalized", *[(F.col("source_family") == f).alias(f.lower()) for f in ("EDR", "NDR")])
    lines = steps.groupBy(*scope).agg(F.collect_list(step).alias("_line"))
    m = F.col(moment)
    held = F.filter("_line", lambda s: (s["since"] <= m) & (s["until"].isNull() | (m < s["until"])))
    each = moments.select(*scope, moment, *keep).join(lines, scope, "left").withColumn("_held", held).drop("_line")
    each = each.withColumn("_shares", F.coalesce(F.array_compact(F.transform("_held", lambda s: s["normalized"])), F.array().cast("array<double>"))).withColumn("_top", F.slice(F.sort_array("_shares", asc=False), 1, top))
    detected = [F.coalesce(F.array_contains(F.col(f"_held.{f}"), True), F.lit(False)).cast("int").alias(f"{f}_detected") for f in ("edr", "ndr")]
    sums = each.select(*scope, moment, *keep, "_top", F.size("_shares").cast("long").alias("eligible_count"), *detected)
    d = F.aggregate("_top", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("_top"), F.lit(1))
    return sums.select(*scope, moment, *keep, d.alias("d"), (F.col("edr_detected") * F.col("ndr_detected")).alias("c"), "eligible_count", "edr_detected", "ndr_detected")


def logit(d: Column, c: Column, intercept: float = -2.0, weight_d: float = 3.0, weight_c: float = 1.0) -> Column:
    return F.lit(intercept) + F.lit(weight_d) * d + F.lit(weight_c) * c


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
