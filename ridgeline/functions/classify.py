"""Classification of commands, questions and outputs by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.commands import expanded
from ridgeline.functions.mentions import mentions

# For each vendor the prefixes of commands and what they show, in order.
PREFIXES = {
    "huawei": (("display ip rout", "rib"), ("display fib", "fib"), ("display mpls lsp", "lfib"), ("display mpls forwarding", "lfib"), ("display int", "interface"), ("display ospf peer", "neighbor"), ("display bgp peer", "neighbor"), ("display isis peer", "neighbor"), ("display mpls ldp session", "neighbor"), ("display mpls ldp peer", "neighbor"), ("display rsvp session", "neighbor"), ("display lldp neighbor", "neighbor"), ("display mpls te tunnel", "tunnel"), ("display segment-routing", "sr_mapping"), ("display isis segment-routing", "sr_mapping"), ("display cur", "config"), ("display sa", "config")),
    "cisco": (("show ip route", "rib"), ("show route", "rib"), ("show ip cef", "fib"), ("show mpls forwarding", "lfib"), ("show interface", "interface"), ("show ip interface", "interface"), ("show ip ospf neighbor", "neighbor"), ("show ip bgp summary", "neighbor"), ("show bgp summary", "neighbor"), ("show isis neighbor", "neighbor"), ("show mpls ldp neighbor", "neighbor"), ("show lldp neighbor", "neighbor"), ("show mpls traffic-eng tunnel", "tunnel"), ("show running-config", "config"), ("show startup-config", "config")),
    "h3c": (("display ip routing-table", "rib"), ("display fib", "fib"), ("display mpls lsp", "lfib"), ("display mpls forwarding", "lfib"), ("display ip inter", "interface"), ("display int", "interface"), ("display ospf peer", "neighbor"), ("display bgp peer", "neighbor"), ("display isis peer", "neighbor"), ("display mpls ldp session", "neighbor"), ("display cur", "config")),
    "juniper": (("show route", "rib"), ("show interface", "interface"), ("show ospf neighbor", "neighbor"), ("show bgp summary", "neighbor"), ("show isis adjacency", "neighbor"), ("show ldp session", "neighbor"), ("show ldp neighbor", "neighbor"), ("show rsvp session", "tunnel"), ("show route table mpls", "lfib"), ("show configuration", "config")),
}


def by_prefix(value: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The class of the first rule whose prefix the value has (CLS-01..05)."""
    out = None
    for prefix, kind in rules:
        test = value.startswith(prefix)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return F.lit(default) if out is None else out.otherwise(default)


def command_type(vendor: Column, command: Column, compat: bool = False) -> Column:
    """What a command shows. Longer prefixes come first, unless compat asks for the plain order."""
    c, out = expanded(vendor, command), None
    for name, rules in PREFIXES.items():
        own = list(rules) if compat else sorted(rules, key=lambda r: -len(r[0]))
        kind = by_prefix(c, own)
        if name == "juniper":
            kind = F.when(c.contains("| display set") & ~c.startswith("show route"), "config_set").otherwise(kind)
        out = F.when(vendor == name, kind) if out is None else out.when(vendor == name, kind)
    return out.otherwise("unknown")


def longest_prefix(values: DataFrame, value: str, rules: DataFrame, keys: list[str], default: str = "unknown") -> DataFrame:
    """values with `kind`: that of the rule (prefix, kind, priority) of highest priority, then longest prefix, that a value has (CLS-06).

    The beginnings of the distinct values, of the lengths that prefixes have, are joined to the rules
    on equality; values of no rule get the default.
    """
    text = F.lower(F.col(value))
    lengths = sorted(r[0] for r in rules.select(F.length("prefix")).distinct().collect())  # as many as prefixes have lengths
    own = values.select(value).distinct().withColumn("_start", F.explode(F.array_distinct(F.array(*(F.left(text, F.lit(n)) for n in lengths))))) if lengths else values.select(value, F.lit("").alias("_start")).limit(0)
    hit = own.join(rules, F.col("_start") == F.lower("prefix"))
    best = hit.groupBy(value).agg(F.max_by("kind", F.struct("priority", F.length("prefix"), "prefix")).alias("kind"))
    return values.join(best, value, "left").withColumn("kind", F.coalesce("kind", F.lit(default))).select(*keys, value, "kind")


def longest_hint(values: DataFrame, value: str, hints: DataFrame) -> DataFrame:
    """value, keyword, result: the longest keyword that a value contains, whatever the case; of equal ones the first by name (SPL-04)."""
    own = values.select(value).distinct()
    hit = mentions(own, [value], F.col(value), hints, "keyword").join(hints, F.col("mention") == F.lower("keyword")).drop("mention")
    order = Window.partitionBy(value).orderBy(F.desc(F.length("keyword")), "keyword")
    return hit.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_rule(rows: DataFrame, keys: list[str], rules: list[dict], vendor: str, model: str, os: str, content: str) -> DataFrame:
    """keys, rule: the most specific of the rules that a row meets (CLS-08).

    A rule is a dict of id, vendor, content (patterns, any of which must match), model and os
    (patterns, or empty). A model pattern counts 2, an os pattern 1; of equal ones the least id.
    Rules are a short list, so they become one expression and nothing is joined.
    """
    from ridgeline.functions.regex import translate

    found = []
    for r in rules:
        test = F.col(vendor) == r["vendor"]
        hit = F.lit(False)
        for p in r["content"]:
            hit = hit | F.col(content).rlike(translate(p).java)
        test = test & hit
        for name, column in (("model", model), ("os", os)):
            if r.get(name):
                test = test & F.col(column).rlike(translate(r[name]).java)
        score = 2 * bool(r.get("model")) + bool(r.get("os"))
        found.append(F.when(test, F.struct(F.lit(score).alias("score"), F.lit(-r["id"]).alias("id"))))
    best = F.array_max(F.array(*found))
    return rows.select(*keys, F.when(best.isNotNull(), -best["id"]).cast("int").alias("rule"), best["score"].alias("score"))


def tool_allowed(name: Column, rule: Column) -> Column:
    """Whether a rule allows a name: `*` any, `p*` those that start with p, else the name itself (FN-23)."""
    start = F.left(rule, F.greatest(F.length(rule) - 1, F.lit(0)))
    return (rule == "*") | (rule.endswith("*") & name.startswith(start)) | (rule == name)


def user_groups(users: DataFrame, groups: DataFrame) -> DataFrame:
    """user, grp: the first group that names a user, else the last group of all, `*` (FN-23). users: user; groups: place, grp, users (an array)."""
    named = groups.select("place", "grp", F.explode("users").alias("user"))
    own = named.where("user <> '*'").groupBy("user").agg(F.min_by("grp", "place").alias("own"))
    rest = named.where("user = '*'").agg(F.max_by("grp", "place").alias("rest"))  # a row
    return users.select("user").distinct().join(own, "user", "left").join(F.broadcast(rest)).select("user", F.coalesce("own", "rest").alias("grp"))


# The rules that an empty table of rules is filled with: vendor, what is shown, priority, prefix (CLS-07).
SEEDS = (
    ("huawei", "rib", 10, "display ip routing-table"),
    ("huawei", "rib", 5, "display ip rout"),
    ("huawei", "fib", 10, "display fib"),
    ("huawei", "lfib", 10, "display mpls lsp"),
    ("huawei", "lfib", 10, "display mpls forwarding"),
    ("huawei", "interface", 10, "display interface"),
    ("huawei", "interface", 5, "display int"),
    ("huawei", "neighbor", 10, "display ospf peer"),
    ("huawei", "neighbor", 10, "display bgp peer"),
    ("huawei", "neighbor", 10, "display isis peer"),
    ("huawei", "neighbor", 10, "display mpls ldp session"),
    ("huawei", "neighbor", 10, "display mpls ldp peer"),
    ("huawei", "neighbor", 10, "display rsvp session"),
    ("huawei", "neighbor", 10, "display lldp neighbor"),
    ("huawei", "tunnel", 10, "display mpls te tunnel"),
    ("huawei", "sr_mapping", 10, "display segment-routing"),
    ("huawei", "sr_mapping", 10, "display isis segment-routing"),
    ("huawei", "config", 10, "display current-configuration"),
    ("huawei", "config", 10, "display saved-configuration"),
    ("huawei", "config", 5, "display cur"),
    ("huawei", "config", 5, "display sa"),
    ("cisco", "rib", 10, "show ip route"),
    ("cisco", "rib", 5, "show route"),
    ("cisco", "fib", 10, "show ip cef"),
    ("cisco", "lfib", 10, "show mpls forwarding"),
    ("cisco", "interface", 10, "show interface"),
    ("cisco", "interface", 10, "show ip interface"),
    ("cisco", "neighbor", 10, "show ip ospf neighbor"),
    ("cisco", "neighbor", 10, "show ip bgp summary"),
    ("cisco", "neighbor", 10, "show bgp summary"),
    ("cisco", "neighbor", 10, "show isis neighbor"),
    ("cisco", "neighbor", 10, "show mpls ldp neighbor"),
    ("cisco", "neighbor", 10, "show lldp neighbor"),
    ("cisco", "tunnel", 10, "show mpls traffic-eng tunnel"),
    ("cisco", "config", 10, "show running-config"),
    ("cisco", "config", 10, "show startup-config"),
    ("h3c", "rib", 10, "display ip routing-table"),
    ("h3c", "fib", 10, "display fib"),
    ("h3c", "lfib", 10, "display mpls lsp"),
    ("h3c", "lfib", 10, "display mpls forwarding"),
    ("h3c", "interface", 10, "display ip interface"),
    ("h3c", "interface", 5, "display interface"),
    ("h3c", "neighbor", 10, "display ospf peer"),
    ("h3c", "neighbor", 10, "display bgp peer"),
    ("h3c", "neighbor", 10, "display isis peer"),
    ("h3c", "neighbor", 10, "display mpls ldp session"),
    ("h3c", "config", 10, "display current-configuration"),
    ("juniper", "rib", 10, "show route"),
    ("juniper", "interface", 10, "show interface"),
    ("juniper", "neighbor", 10, "show ospf neighbor"),
    ("juniper", "neighbor", 10, "show bgp summary"),
    ("juniper", "neighbor", 10, "show isis adjacency"),
    ("juniper", "neighbor", 10, "show ldp session"),
    ("juniper", "tunnel", 10, "show rsvp session"),
    ("juniper", "lfib", 10, "show route table mpls"),
    ("juniper", "config", 10, "show configuration"),
    ("juniper", "config_set", 10, "| display set"),
)


def seeded(rules: DataFrame) -> DataFrame:
    """rules (vendor, prefix, kind, priority), or the seeds where there are none (CLS-07)."""
    if not rules.isEmpty():
        return rules
    return rules.sparkSession.createDataFrame([(v, p, k, n) for v, k, n, p in SEEDS], "vendor string, prefix string, kind string, priority int")
