"""What to look at next: commands that follow from a command's rows, and walks through steps with decisions (QRY-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import cut

# Command, the command that follows, kind, field of its rows and the place it fills.
RELATIONS = (
    ("display bgp peer", "display bgp peer {ip} verbose", "context", "Peer", "{ip}"),
    ("display bgp peer", "display interface {interface}", "reference", "Interface", "{interface}"),
    ("display ip routing-table", "display arp", "reference", "NextHop", "{ip}"),
    ("display ip routing-table", "display interface {interface}", "reference", "Interface", "{interface}"),
    ("display ip vpn-instance", "display ip routing-table vpn-instance {name}", "context", "VPN-Instance", "{name}"),
    ("display ip vpn-instance", "display bgp vpnv4 vpn-instance {name} peer", "context", "VPN-Instance", "{name}"),
    ("display mpls ldp session", "display mpls ldp session {ip} verbose", "context", "PeerLDPID", "{ip}"),
    ("display mpls forwarding-table", "display ip routing-table", "reference", "FEC", "{prefix}"),
    ("display interface brief", "display interface {interface}", "context", "Interface", "{interface}"),
)


def relations(spark: SparkSession) -> DataFrame:
    """source, target, kind, field, slot."""
    return spark.createDataFrame(list(RELATIONS), "source string, target string, kind string, field string, slot string")


def follow_ups(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, command: what follows from rows (keys, command, fields: a map), each once.

    A target's place is filled with the row's field; a row without it, or with an empty one, leads nowhere.
    """
    hit = rows.join(F.broadcast(known), rows.command == known.source)  # some relations
    value = F.element_at("fields", F.col("field"))
    return hit.where(value.isNotNull() & (value != "")).select(*keys, "kind", F.replace("target", F.col("slot"), value).alias("command")).distinct()


def walked(subjects: DataFrame, facts: DataFrame, steps: DataFrame) -> DataFrame:
    """id, scenario, visited, conclusion: the way of each subject (id, scenario) through the steps of its scenario.

    steps: scenario, step, place, field, pattern, next, conclusion. At a step the first decision, by place, counts whose pattern
    is found in what is known of its field (facts: id, field, value; none is empty); next 0 ends with the conclusion. Without any, or where a step
    would be visited again, a walk ends without one. Each round is a join for all subjects, and there are no more rounds than steps.
    """
    known = facts.select(F.col("id").alias("_id"), F.col("field").alias("_field"), "value")
    left = cut(subjects.select("id", "scenario", F.lit(1).alias("step"), F.array(F.lit(1)).alias("visited")).distinct())
    done = left.select("id", "scenario", "visited", F.lit(None).cast("string").alias("conclusion")).limit(0)
    while not left.isEmpty():
        met = left.join(F.broadcast(steps), ["scenario", "step"], "left").join(known, (F.col("id") == F.col("_id")) & (F.col("field") == F.col("_field")), "left")
        fits = F.col("field").isNotNull() & F.expr("coalesce(value, '') rlike pattern")
        first = F.min(F.when(fits, F.struct("place", "next", "conclusion")))
        moved = cut(met.groupBy("id", "scenario", "step", "visited").agg(first.alias("d")))
        on = F.col("d").isNotNull() & (F.col("d.next") > 0) & ~F.array_contains("visited", F.col("d.next"))
        over = moved.where(~F.coalesce(on, F.lit(False))).select("id", "scenario", "visited", F.when(F.col("d.next") == 0, F.col("d.conclusion")).alias("conclusion"))
        done = cut(done.union(over))
        left = moved.where(on).select("id", "scenario", F.col("d.next").alias("step"), F.concat("visited", F.array("d.next")).alias("visited"))
    return done
