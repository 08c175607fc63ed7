"""Devices from logs: models, versions, clean configurations, snapshots, and a log's whole way to stored facts (SPL-18..21, SRC-01, 14, CLS-09, UPS-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import outputs, sessions
from ridgeline.operators.merge import first_by
from ridgeline.session import written

# How each vendor's models are written in host names, in order.
MODELS = {
    "huawei": (r"\b(NE\d{2,5}[A-Z]*)\b", r"\b(CE\d{3,5}[A-Z]*)\b", r"[-_](HW\d{3,5}[A-Z]*)\b", r"\b(S\d{3,5}[A-Z]*)\b", r"\b(AR\d{3,5}[A-Z]*)\b", r"\b(ATN\d{3,5}[A-Z]*)\b", r"\b(CX\d{3,5}[A-Z]*)\b", r"\b(USG\d{3,5}[A-Z]*)\b", r"\b(NETENGINE\d+[A-Z]*)\b"),
    "h3c": (r"\b(H\d{4,5}[A-Z0-9]*)\b", r"\b(SR\d{3,5}[A-Z]*)\b", r"\b(CR\d{3,5}[A-Z]*)\b", r"\b(S\d{3,5}[A-Z]*)\b", r"\b(MSR\d{3,5}[A-Z]*)\b", r"\b(SECPATH\s*\w+)\b"),
    "cisco": (r"\b(ASR\d{3,5}[A-Z]*)\b", r"\b(NCS\d{3,5}[A-Z]*)\b", r"\b(C\d{3,5}[A-Z]*)\b", r"\b(ISR\d{3,5}[A-Z]*)\b", r"\b(N9K[A-Z0-9-]*)\b", r"\b(N7K[A-Z0-9-]*)\b", r"\b(XRV\d*)\b"),
    "juniper": (r"\b(MX\d{2,5}[A-Z]*)\b", r"\b(QFX\d{3,5}[A-Z]*)\b", r"\b(EX\d{3,5}[A-Z]*)\b", r"\b(SRX\d{3,5}[A-Z]*)\b", r"\b(PTX\d{3,5}[A-Z]*)\b", r"\b(ACX\d{3,5}[A-Z]*)\b", r"\b(VMX|VSRX|VQFX)\b"),
}
# How configurations state the version of the system, and what it is called.
VERSIONS = {
    "huawei": (("VRP ", r"!Software Version (V\S+)"),),
    "cisco": (("IOS-XR ", r"(?m)^!! IOS XR Configuration (\S+)"), ("IOS-XR ", r"(?i)IOS XR.*?(?:Version|Release)\s+(\S+)")),
    "h3c": (("Comware ", r"(?m)^\s*version\s+(7\.[0-9A-Za-z.]+)"),),
    "juniper": (("JUNOS ", r"(?m)^\s*version\s+(\d+\.\d+\S*);\s*$"),),
}
# What comes before a configuration, and prompts that come after it.
PREAMBLE = r"(?m)^(?:.*Building configuration\.\.\.\s*\n|\s*\w+ \w+ \d+ \d+:\d+:\d+\.\d+ \w+\s*\n)"
PROMPT = r"^(?:<[A-Za-z][^>]+>|\[[A-Za-z][^\]]+\]|RP/\d+/[A-Z0-9]+/CPU\d+:[^\s#]+#|[a-zA-Z][a-zA-Z0-9._-]*@[A-Za-z][A-Za-z0-9._-]*[>#]|\{(?:master|backup)[^}]*\}|\{(?:primary|secondary|linecard):[^}]*\})$"


def model(hostname: Column, vendor: Column) -> Column:
    """The model that a host name contains, by the patterns of its vendor, then of the others in turn; or the empty string (SPL-18)."""
    name = F.upper(hostname)
    first = lambda patterns: F.coalesce(*(F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in patterns))
    own = F.coalesce(*(F.when(vendor == v, first(patterns)) for v, patterns in MODELS.items()))
    return F.coalesce(own, *(first(patterns) for patterns in MODELS.values()), F.lit(""))


def os_version(config: Column, vendor: Column) -> Column:
    """The version that a configuration states, or the empty string (SPL-19)."""
    found = [F.when(vendor == v, F.concat(F.lit(name), F.nullif(F.regexp_extract(config, p, 1), F.lit("")))) for v, patterns in VERSIONS.items() for name, p in patterns]
    return F.coalesce(*found, F.lit(""))


def clean_config(text: Column) -> Column:
    """A configuration without what devices print before and after it (SPL-20)."""
    ls = F.split(F.regexp_replace(text, PREAMBLE, ""), "\n", -1)
    keep = F.transform(ls, lambda x: ~F.regexp_replace(x, r"^\s+|\s+$", "").rlike(PROMPT + "|^$"))
    last = F.size(ls) - F.coalesce(F.nullif(F.array_position(F.reverse(keep), True), F.lit(0)) - 1, F.size(ls))
    return F.regexp_replace(F.array_join(F.slice(ls, F.lit(1), last.cast("int")), "\n"), r"^\s+|\s+$", "")


def snapshots(blocks: DataFrame) -> DataFrame:
    """device_id, hostname, vendor, commands, captured_at: what was asked of each device, in order, and when first (SPL-21). blocks: as of split_log, with file."""
    asked = F.array_sort(F.collect_list(F.struct("file", "block_no", "command")))
    out = blocks.groupBy(F.lower("hostname").alias("device_id")).agg(F.min_by(F.struct("hostname", "vendor"), F.struct("file", "block_no")).alias("d"), asked.alias("c"), F.min("captured_at").alias("captured_at"))
    return out.select("device_id", "d.hostname", "d.vendor", F.transform("c", lambda x: x["command"]).alias("commands"), "captured_at")


def bulk_category(kind: Column) -> Column:
    """Where the bulk of a table goes; null for what is stored in typed rows alone (CLS-09)."""
    return F.when(kind == "rib", "route").when(kind == "fib", "fib").when(kind == "lfib", "label").when(kind == "unknown", "raw")


def ingest(files: DataFrame) -> dict[str, DataFrame]:
    """From file, content to tables of facts, for any number of logs (SRC-01, SRC-14).

    Logs are cut into blocks once, which are written to the shared folder; every table is taken from there.
    blocks (classified), devices (with model and version), configs (cleaned), interfaces, neighbors,
    routes, labels, pad (outputs that go aside by category). A file without prompts is a raw
    configuration, if it names its host, or else gives nothing. Routes of no VRF are of `default` (UPS-05).
    """
    logs = files.select("file", "content", sessions.log_blocks(F.col("content")).alias("b")).select("file", "b", F.when(F.size("b") == 0, F.col("content")).alias("content"))
    found = written(logs.select("file", "content", F.posexplode_outer("b").alias("block_no", "b")).select("file", "block_no", "b.*", F.when(F.col("block_no").isNull(), sessions.raw_config(F.col("content"))).alias("r")))
    split = found.where("block_no is not null").drop("r")
    blocks = sessions.classified(sessions.reclassified(split)).withColumn("device_id", F.lower("hostname"))
    lone = found.where("r is not null").select("file", "r").join(split.select("file").distinct(), "file", "left_anti")
    shown = blocks.where("cmd_type = 'config'").select("device_id", "vendor", "file", "block_no", clean_config(F.col("output")).alias("config_text"))
    raw = lone.select(F.lower("r.hostname").alias("device_id"), "r.vendor", "file", F.lit(0).alias("block_no"), clean_config(F.col("r.config")).alias("config_text"))
    configs = shown.unionByName(raw).where("config_text <> ''")
    seen = snapshots(split).select("device_id", "hostname", "vendor", "commands", "captured_at")
    alone = lone.groupBy(F.lower("r.hostname").alias("device_id")).agg(F.min("r.hostname").alias("hostname"), F.min("r.vendor").alias("vendor"), F.array().cast("array<string>").alias("commands"), F.lit(None).cast("timestamp").alias("captured_at"))
    vendors = blocks.groupBy("device_id").agg(F.min_by("vendor", F.struct("file", "block_no")).alias("_v"))  # after hosts were told apart
    devices = seen.join(vendors, "device_id", "left").withColumn("vendor", F.coalesce("_v", "vendor")).drop("_v")
    devices = devices.unionByName(alone.join(devices.select("device_id"), "device_id", "left_anti"))
    versions = configs.withColumn("os_version", os_version(F.col("config_text"), F.col("vendor"))).where("os_version <> ''")
    versions = first_by(versions.select("device_id", "os_version", "file", "block_no"), ["device_id"], F.struct("file", "block_no")).select("device_id", "os_version")
    devices = devices.join(versions, "device_id", "left").withColumns({"os_version": F.coalesce("os_version", F.lit("")), "model": model(F.col("hostname"), F.col("vendor"))})
    keys = ["device_id", "file", "block_no"]
    tables = {"blocks": blocks, "devices": devices, "configs": configs}
    for name, kind in (("interfaces", "interface"), ("neighbors", "neighbor"), ("routes", "rib"), ("labels", "lfib")):
        found = None
        for vendor, k in outputs.PARSERS:
            if k == kind or kind == "neighbor" and k in ("ospf", "ldp", "peers"):
                rows = outputs.parsed(blocks, vendor, k, keys)
                found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        tables[name] = found
    tables["routes"] = tables["routes"].withColumn("vrf", F.coalesce(F.nullif("vrf", F.lit("")), F.lit("default")))
    aside = bulk_category(F.col("cmd_type"))
    tables["pad"] = blocks.select(*keys, aside.alias("category"), "command", "output").where("category is not null")
    return tables
