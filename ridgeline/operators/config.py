"""Relations in configuration texts: interfaces, protocols, peers, static routes, expected commands (CFG).

A configuration is cut into its blocks by array functions in its own row; inheritance between
groups and peers is a join of the extracted rows. Brace-nested text is folded line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.classify import command_type
from ridgeline.functions.network import dotted_mask
from ridgeline.plans.program import let

# How names of interfaces tell their kind.
KINDS = (("loopback", "loopback"), ("eth-trunk", "lag"), ("bridge-aggregation", "lag"), ("port-channel", "lag"), ("bundle-ether", "lag"), ("ae", "lag"), ("vlanif", "vlanif"), ("vlan-interface", "vlanif"), ("irb", "vlanif"), ("tunnel", "tunnel"), ("null", "null"), ("nve", "nve"))


def interface_kind(name: Column) -> Column:
    """PAR-19: by the name's beginning; a name with a dot is a subinterface, others are physical."""
    low, out = F.lower(name), F.when(name.contains("."), "subinterface")
    for prefix, kind in KINDS:
        out = out.when(low.startswith(prefix), kind)
    return out.otherwise("physical")


def lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))


def blocks(text: Column, mark: str) -> Column:
    """Arrays of lines between lines that are the mark alone (CFG-01: #, CFG-02: !)."""

    def cut(ls: Column) -> Column:
        heads = F.concat(F.array(F.lit(-1)), F.filter(F.transform(ls, lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull()))
        return let(heads, lambda h: F.transform(h, lambda a, k: F.slice(ls, a + 2, F.greatest(F.coalesce(F.get(h, k + 1), F.size(ls)) - a - 1, F.lit(0)))))

    return F.filter(let(lines(text), cut), lambda b: F.size(b) > 0)


def first_match(ls: Column, pattern: str, group: int = 1) -> Column:
    """The group in the first line that matches, or the empty string."""
    hit = F.get(F.filter(ls, lambda x: x.rlike(pattern)), F.lit(0))
    return F.coalesce(F.regexp_extract(hit, pattern, group), F.lit(""))


def interfaces(df: DataFrame, text: str, vendor: str, keys: list[str]) -> DataFrame:
    """keys, name, type, ip_address, mask, description, status of the interfaces that a configuration sets up (CFG-01, CFG-02)."""
    mark = F.when(F.col(vendor) == "cisco", "!").otherwise("#")
    parts = F.when(mark == "!", blocks(F.col(text), "!")).otherwise(blocks(F.col(text), "#"))
    rows = df.select(*keys, F.explode(parts).alias("b"))
    # A block may hold several interfaces: each begins with its own line.
    heads = F.filter(F.transform("b", lambda x, i: F.when(x.rlike(r"^interface\s+\S"), i)), lambda i: i.isNotNull())
    own = let(heads, lambda h: F.transform(h, lambda a, k: F.slice(F.col("b"), a + 1, F.coalesce(F.get(h, k + 1), F.size("b")) - a)))
    rows = rows.select(*keys, F.explode(own).alias("b"))
    name = first_match(F.col("b"), r"^interface\s+(\S+)")
    address = r"^\s+(?:ip|ipv4) address (\d+\.\d+\.\d+\.\d+)[ /](\S+)"
    return rows.select(*keys, name.alias("name"), interface_kind(name).alias("type"), first_match(F.col("b"), address, 1).alias("ip_address"), first_match(F.col("b"), address, 2).alias("mask"), first_match(F.col("b"), r"^\s+description (.+)$").alias("description"), F.when(F.exists("b", lambda x: x.rlike(r"^\s+shutdown$")), "down").otherwise("up").alias("status"))


#: A statement of brace-nested text and what ends it, and what in it is a comment; quoted parts are kept whole.
STATEMENT = r'(?s)(?:"[^"]*+"|/\*.*?\*/|#[^\n]*+|[^{};"#/]++|/)*+[{};]'
COMMENT = r'(?s)("[^"]*+")|/\*.*?\*/|#[^\n]*+'


def nested(text: Column) -> Column:
    """path and statement of every leaf of brace-nested text, in order: a fold with the stack of open names (CFG-03)."""
    kind = "struct<stack:array<string>,rows:array<struct<path:string,statement:string>>>"

    def step(acc: Column, part: Column) -> Column:
        said = F.regexp_replace(F.regexp_replace(F.regexp_replace(part, COMMENT, "$1"), r"\s+", " "), r"^ | ?[{};]$", "")
        end, stack = F.right(part, F.lit(1)), acc["stack"]
        after = F.when(end == "{", F.concat(stack, F.array(said))).when(end == "}", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        row = F.struct(F.array_join(stack, " / ").alias("path"), said.alias("statement"))
        return F.struct(after.alias("stack"), F.when((end == ";") & (said != ""), F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"]).alias("rows")).cast(kind)

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<path:string,statement:string>>").alias("rows")).cast(kind)
    return F.aggregate(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(STATEMENT), F.lit(0)), start, step, lambda acc: acc["rows"])


def nested_interfaces(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Interfaces and units of brace-nested configurations; a disabled interface disables its units (CFG-03)."""
    rows = df.select(*keys, F.explode(nested(F.col(text))).alias("r")).select(*keys, "r.*").where("path like 'interfaces / %'")
    parts = F.split("path", " / ")
    unit = F.regexp_extract("path", r" / unit (\S+)", 1)
    device = F.element_at(parts, 2)
    rows = rows.select(*keys, device.alias("device"), F.when(unit != "", F.concat(device, F.lit("."), unit)).otherwise(device).alias("name"), "statement")
    found = rows.groupBy(*keys, "device", "name").agg(
        F.max(F.regexp_extract("statement", r"^address (\d+\.\d+\.\d+\.\d+)/\d+", 1)).alias("ip_address"), F.max(F.regexp_extract("statement", r"^address \S+/(\d+)", 1)).alias("mask"),
        F.max(F.regexp_extract("statement", r'^description "?([^"]*)"?', 1)).alias("description"), F.bool_or(F.col("statement") == "disable").alias("off"),
    )
    off = found.where("device = name and off").select(*keys, "device", F.lit(True).alias("all_off"))
    return found.join(off, [*keys, "device"], "left").select(*keys, "name", interface_kind(F.col("name")).alias("type"), "ip_address", "mask", "description", F.when(F.col("off") | F.coalesce("all_off", F.lit(False)), "down").otherwise("up").alias("status"))


def static_routes(text: Column) -> Column:
    """vrf, destination, mask, next_hop of `ip route-static` lines (CFG-10)."""
    p = r"^ip route-static (?:vpn-instance (\S+) )?(\d+\.\d+\.\d+\.\d+) (\S+) (\S+)(?: (\d+\.\d+\.\d+\.\d+))?"
    g = lambda x, i: F.regexp_extract(x, p, i)
    mask = lambda m: F.when(m.rlike(r"^\d{1,2}$"), dotted_mask(m.try_cast("int"))).otherwise(m)
    return F.transform(F.filter(lines(text), lambda x: x.rlike(p)), lambda x: F.struct(g(x, 1).alias("vrf"), g(x, 2).alias("destination"), mask(g(x, 3)).alias("mask"), F.when(g(x, 5) != "", g(x, 5)).otherwise(g(x, 4)).alias("next_hop")))


def igp_members(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, protocol, process, interfaces (joined): interfaces on which a process is switched on (CFG-09)."""
    rows = df.select(*keys, F.explode(blocks(F.col(text), "#")).alias("b"))
    found = F.filter(F.transform("b", lambda x: F.struct(F.regexp_extract(x, r"^\s+(ospf|isis) enable ?(\d*)", 1).alias("protocol"), F.regexp_extract(x, r"^\s+(ospf|isis) enable ?(\d*)", 2).alias("process"))), lambda s: s["protocol"] != "")
    rows = rows.select(*keys, first_match(F.col("b"), r"^interface\s+(\S+)").alias("name"), F.explode(found).alias("p")).where("name <> ''")
    return rows.groupBy(*keys, "p.protocol", "p.process").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("interfaces"))


def bgp_peers(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, local_as, address_family, vrf, peer_ip, and what it has or takes from its group (CFG-04).

    Peer lines become rows; a peer's own setting counts before its group's, by a left join.
    """
    rows = df.select(*keys, F.explode(blocks(F.col(text), "#")).alias("b"))
    rows = rows.where(F.get("b", F.lit(0)).rlike(r"^bgp \d+")).withColumn("local_as", F.regexp_extract(F.get("b", F.lit(0)), r"^bgp (\d+)", 1).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        family = F.regexp_extract(x, r"^\s*(?:address-family )?(ipv4-family|ipv6-family|ipv4|ipv6|vpnv4|vpnv6)\b ?(.*)$", 1)
        what = F.regexp_extract(x, r"^\s*(?:address-family )?(ipv4-family|ipv6-family|ipv4|ipv6|vpnv4|vpnv6)\b ?(.*)$", 2)
        now = F.when(family == "", acc["af"]).when(what.startswith("vpn-instance "), F.concat(F.lit("vrf:"), F.substring_index(what, " ", -1))).when(what.isin("", "unicast"), F.concat(F.substring(family, 1, 4), F.lit("-unicast"))).otherwise(F.lower(F.replace(what, F.lit(" "), F.lit("-"))))
        peer = F.regexp_extract(x, r"^\s*peer (\S+) (.+)$", 1)
        row = F.struct(now.alias("af"), peer.alias("peer"), F.regexp_extract(x, r"^\s*peer (\S+) (.+)$", 2).alias("rest"))
        return F.struct(now.alias("af"), F.when(peer != "", F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"]).alias("rows"))

    start = F.struct(F.lit("").alias("af"), F.array().cast("array<struct<af:string,peer:string,rest:string>>").alias("rows"))
    said = rows.select(*keys, "local_as", F.explode(F.aggregate("b", start, step, lambda acc: acc["rows"])).alias("r")).select(*keys, "local_as", "r.*")
    take = lambda name, p: F.max(F.nullif(F.regexp_extract("rest", p, 1), F.lit(""))).alias(name)
    facts = [take("remote_as", r"^as-number (\d+)"), take("peer_group", r"^group (\S+)"), take("description", r"^description (.+)$"), take("update_source", r"^connect-interface (\S+)"), take("import_policy", r"^route-policy (\S+) import"), take("export_policy", r"^route-policy (\S+) export"), F.max(F.col("rest").rlike("^bfd enable").cast("int")).alias("bfd_enabled")]
    whole = said.groupBy(*keys, "local_as", "peer").agg(*facts)
    enabled = said.where("af <> '' and rest = 'enable'").select(*keys, "peer", "af").distinct()
    inherited = ("remote_as", "description", "update_source", "import_policy", "export_policy", "bfd_enabled")
    groups = whole.select(*keys, F.col("peer").alias("peer_group"), *(F.col(c).alias(f"_{c}") for c in inherited))
    out = whole.where(F.col("peer").rlike(r"^\d+\.\d+\.\d+\.\d+$")).join(groups, [*keys, "peer_group"], "left").join(enabled, [*keys, "peer"])
    value = lambda c: F.coalesce(F.col(c), F.col(f"_{c}")) if c != "bfd_enabled" else F.greatest(F.col(c), F.coalesce(F.col(f"_{c}"), F.lit(0)))
    return out.select(*keys, "local_as", F.when(F.col("af").startswith("vrf:"), "ipv4-unicast").otherwise(F.col("af")).alias("address_family"), F.when(F.col("af").startswith("vrf:"), F.substring(F.col("af"), 5, 1 << 30)).otherwise("").alias("vrf"), F.col("peer").alias("peer_ip"), F.coalesce("peer_group", F.lit("")).alias("peer_group"), *(value(c).alias(c) for c in inherited))


# What a configuration that says so is expected to be asked for: pattern, command, category, priority (CFG-12).
EXPECTED = (("", "display version", "system", 1), ("", "display interface brief", "interface", 1), ("", "display ip routing-table", "routing", 2), (r"(?m)^ospf \d+", "display ospf peer", "ospf", 2), (r"(?m)^bgp \d+", "display bgp peer", "bgp", 2), (r"(?m)^isis\b", "display isis peer", "isis", 2), (r"(?m)^\s*mpls ldp", "display mpls ldp session", "mpls", 3), (r"(?m)^acl ", "display acl all", "acl", 3))


def expected_commands(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, command, category, priority: rules whose pattern the text meets, and a routing table for each VPN it names (CFG-12)."""
    rows = F.array(*(F.struct(F.lit(c).alias("command"), F.lit(k).alias("category"), F.lit(p).alias("priority"), (F.col(text).rlike(r) if r else F.lit(True)).alias("hit")) for r, c, k, p in EXPECTED))
    vpns = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^ip vpn-instance (\S+)"), F.lit(1)))
    extra = F.transform(vpns, lambda v: F.struct(F.concat(F.lit("display ip routing-table vpn-instance "), v).alias("command"), F.lit("routing").alias("category"), F.lit(3).alias("priority"), F.lit(True).alias("hit")))
    return df.select(*keys, F.explode(F.filter(F.concat(rows, extra), lambda r: r["hit"])).alias("r")).select(*keys, "r.command", "r.category", "r.priority")


def coverage(df: DataFrame, text: str, vendor: str, keys: list[str]) -> DataFrame:
    """keys, vendor, command, category, priority, cmd_type, covered: whether what a configuration is expected to be asked for is understood (QRY-08, JOIN-12)."""
    found = expected_commands(df, text, [*keys, vendor])
    kind = command_type(F.col(vendor), F.col("command"))
    return found.select("*", kind.alias("cmd_type")).withColumn("covered", F.col("cmd_type") != "unknown")


def coverage_share(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, covered, percent (AGG-09)."""
    return items.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("covered").alias("covered")).withColumn("percent", 100.0 * F.col("covered") / F.col("total"))
