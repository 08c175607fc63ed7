"""Columns that normalise commands of network devices and judge their outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.plans.program import fields, is_blank, let

# Abbreviations, control commands, words that take an argument, words that are none,
# marks of help texts, and the words by which a command's category is told, in order.
ABBREVIATIONS = {
    "int": "interface", "inter": "interface", "lo": "loopback", "loop": "loopback", "vlan": "vlanif", "gi": "gigabitethernet", "ge": "gigabitethernet", "xe": "ten-gigabitethernet",
    "agg": "aggregation", "link-agg": "link-aggregation", "ver": "verbose", "bri": "brief", "det": "detail", "sum": "summary", "summ": "summary", "ro": "routing-table", "rout": "routing-table",
    "cur": "current-configuration", "curr": "current-configuration", "sa": "saved-configuration", "run": "running-config", "nei": "neighbor", "neigh": "neighbor", "for": "forwarding-table", "forw": "forwarding-table",
    "tun": "tunnel", "stat": "statistics", "desc": "descriptions",
}
CONTROL = (
    "quit", "return", "exit", "system-view", "sys", "end", "configure terminal", "conf t", "save", "commit", "undo", "rollback", "screen-length", "screen-width", "terminal length", "terminal width", "terminal monitor",
    "user-interface", "set cli screen-length", "set cli screen-width", "more", "display clock", "display version", "display device", "display logbuffer", "display trapbuffer", "show clock", "show version",
    "show tech-support", "show inventory", "show environment", "request", "restart", "set cli",
)
QUALIFIERS = (
    "vpn-instance", "vrf", "instance", "peer", "neighbor", "neighbors", "interface", "bridge-aggregation", "route-aggregation", "eth-trunk", "port-channel", "area", "table", "group", "acl", "access-list", "route-policy", "route-map",
    "vlan", "vlan-interface", "tunnel", "service-instance", "destination", "source", "community", "prefix-list", "label", "locator", "name", "filter", "last", "location", "bundle-ether", "prefix-set", "community-set", "as-path-set",
    "extcommunity-set", "prefix", "rd", "routing-instance", "logical-system", "policy-statement", "ip-prefix", "community-filter", "as-path-filter", "configuration", "slot", "tunnel-policy",
)
MODIFIERS = (
    "brief", "verbose", "detail", "detailed", "summary", "statistics", "terse", "extensive", "descriptions", "accounting", "status", "ingress", "transit", "egress", "level-1", "level-2", "level-1-2", "unicast", "multicast",
    "advertised-routes", "received-routes", "longer-prefixes", "ipv4", "ipv6", "vpnv4", "vpnv6", "all", "active", "inactive", "exact", "no-resolve", "inbound", "outbound", "router", "network", "nssa", "opaque", "comprehensive", "external",
)
HELP_MARKS = (
    "<cr>", ">  Redirect it to a file", "|  Matching output", "|  Begin with", "|  Exclude", "|  Include", "|  Redirect to", "Incomplete command", "Possible completions:", "|  Output modifiers", "% Ambiguous command",
    "% Invalid input detected", "% Incomplete command", "Error: Unrecognized command", "Error: Wrong parameter found", "Unknown command",
)
CATEGORIES = (
    ("bgp", ("bgp",)), ("ospf", ("ospf",)), ("isis", ("isis",)), ("mpls", ("mpls", "ldp", "rsvp")), ("acl", ("acl", "access-list")), ("interface", ("interface", "eth-trunk", "link-aggregation", "bridge-aggregation")), ("vlan", ("vlan",)),
    ("vpn", ("vpn-instance", "vrf")), ("routing", ("routing-table", "route")), ("sr", ("segment-routing", "srv6")), ("config", ("configuration", "running-config")), ("tunnel", ("tunnel",)), ("neighbor", ("neighbor", "lldp")),
    ("fib", ("fib", "forwarding")), ("policy", ("policy", "route-policy", "route-map", "prefix-list")),
)
INTERFACE = r"(?i)^(gigabitethernet|ten-gigabitethernet|twentyfivegige|fortygige|hundredgige|bridge-aggregation|bagg|eth-trunk|port-channel|vlanif|vlan-interface|loopback|null|tunnel|nve|mgmteth|management|serial|pos|ge-|xe-|et-|ae|irb|em|fxp)\d"
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(/\d{1,2})?$"
DATA = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|\d+:\d+|/\d{1,3}\b|[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}|[0-9a-fA-F]{2}:[0-9a-fA-F]{2}:[0-9a-fA-F]{2}:[0-9a-fA-F]{2}"
HELP_LINE, HELP_TEXT = r"^[\t\n\f\r ]*[^\t\n\f\r ]+[\t\n\f\r ]{2,}[^\t\n\f\r ]", r"^[\t\n\f\r ]*[a-zA-Z<|>][\w<>-]*[\t\n\f\r ]{2,}[A-Z]"


def trim(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def expanded(vendor: Column, command: Column) -> Column:
    """Lower case, trimmed, with the verb in full."""
    low = F.lower(trim(command))
    full = F.when(vendor.isin("huawei", "h3c") & low.startswith("dis "), F.concat(F.lit("display "), F.substring(low, 5, 1 << 30)))
    return full.when((vendor == "cisco") & low.startswith("sh "), F.concat(F.lit("show "), F.substring(low, 4, 1 << 30))).otherwise(low)


def normalise(vendor: Column, command: Column) -> Column:
    """The command with its verb and the words after it in full, one blank between words (SPL-10)."""
    names = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.array_join(F.transform(fields(expanded(vendor, command)), lambda w, i: F.when(i > 0, F.coalesce(F.element_at(names, w), w)).otherwise(w)), " ")


def _placeholder(w: Column, other: Column | str) -> Column:
    other = F.lit(other) if isinstance(other, str) else other
    return F.when(w.rlike(IPV4), "{ip}").when(w.rlike(INTERFACE), "{interface}").when(w.rlike(r"^\d+$"), "{id}").otherwise(other)


def strip_args(norm: Column) -> Column:
    """A normalised command with placeholders for its arguments (SPL-11): one fold over the words.

    A word that takes an argument turns the next into a placeholder, unless that is a modifier or
    takes one itself. The verb stays.
    """

    def step(acc: Column, w: Column) -> Column:
        takes, plain = w.isin(*QUALIFIERS), w.isin(*MODIFIERS)
        argument = acc["wanted"] & ~takes & ~plain
        out = F.when(F.size(acc["out"]) == 0, w).when(argument, _placeholder(w, "{name}")).when(takes | plain, w).otherwise(_placeholder(w, w))
        return F.struct(F.concat(acc["out"], F.array(out)).alias("out"), (takes & (F.size(acc["out"]) > 0) & ~argument).alias("wanted"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("wanted"))
    words = fields(norm)
    return F.when(F.size(words) <= 1, norm).otherwise(F.array_join(F.aggregate(words, start, step, lambda acc: acc["out"]), " "))


def is_control(vendor: Column, command: Column) -> Column:
    """A command that steers the device and shows no data (SPL-14)."""
    c = F.array_join(fields(expanded(vendor, command)), " ")
    return F.exists(F.array(*map(F.lit, CONTROL)), lambda p: (c == p) | c.startswith(F.concat(p, F.lit(" "))))


def is_help(output: Column) -> Column:
    """An output that is the device's help text (SPL-12)."""
    marks = F.exists(F.array(*map(F.lit, HELP_MARKS)), lambda m: output.contains(m))

    def judge(lines: Column) -> Column:
        n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
        total, told = F.size(lines), n(HELP_TEXT)
        return (n(DATA) == 0) & (total >= 3) & (n(HELP_LINE) >= 0.8 * total) & ((told >= 2) | (told >= 0.4 * total))

    return marks | let(F.filter(F.split(output, "\n", -1), lambda x: ~is_blank(x)), judge)


def is_error(output: Column) -> Column:
    """An output with an error pointer or message (SPL-13)."""
    return F.exists(F.transform(F.split(output, "\n", -1), trim), lambda x: (x == "^") | x.startswith("% ") | x.startswith("Error:"))


def category(norm: Column) -> Column:
    """The first category that one of its words names, or other (SPL-15)."""
    low, out = F.lower(norm), None
    for name, words in CATEGORIES:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def content_hash(c: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 (SPL-17)."""
    return F.substring(F.sha2(c, 256), 1, 16)


def shortened(c: Column, n: int) -> Column:
    """At most n characters, the last of them … if some are left out (SPL-16)."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)
