"""Routing relations of configurations: peers, VRFs and policies of indented and brace-nested texts (CFG-05..08).

A configuration becomes rows of a path of open blocks and a statement, by one fold over its lines in
its own row. What a peer, a VRF or a policy says is then grouped from those rows; inheritance from
groups is a left join. Where a setting is said twice, the later one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.config import blocks, nested

# Statements that open a block where nothing is indented, and names of families.
OPENERS = r"(?i)^(router bgp|neighbor-group|neighbor|vrf|address-family|import\s+route-target|export\s+route-target|bmp\s+server)(\s|$)"
FAMILIES = {"inet": "ipv4-unicast", "inet-vpn": "vpnv4", "inet6-vpn": "vpnv6", "inet6": "ipv6-unicast"}


def outline(text: Column) -> Column:
    """path (open blocks) and statement of every line of an indented text, in order.

    A line belongs to the last lines with less indentation. Where nothing is indented, statements
    that open blocks count as deeper and ! closes the innermost.
    """
    kind = "struct<stack:array<struct<depth:int,text:string>>,rows:array<struct<path:array<string>,statement:string>>>"
    flat = ~F.coalesce(text, F.lit("")).rlike(r"(?m)^[ \t]+[^\s!]")

    def step(acc: Column, line: Column) -> Column:
        x = F.regexp_replace(line, r"^\s+|\s+$", "")
        depth = F.length(F.regexp_extract(line, "^( *)", 1))
        size = F.size(acc["stack"])
        open_ = F.when(flat & (x == "!"), F.slice(acc["stack"], F.lit(1), F.greatest(size - 1, F.lit(0)))).when(flat, acc["stack"]).otherwise(F.filter(acc["stack"], lambda s: s["depth"] < depth))
        own = F.array(F.struct(F.when(flat, size).otherwise(depth).alias("depth"), x.alias("text")))
        stack = F.when(x == "", acc["stack"]).when((x == "!") | (flat & ~x.rlike(OPENERS)), open_).otherwise(F.concat(open_, own))
        row = F.array(F.struct(F.transform(open_, lambda s: s["text"]).alias("path"), x.alias("statement")))
        return F.struct(stack.alias("stack"), F.when(x.isin("", "!"), acc["rows"]).otherwise(F.concat(acc["rows"], row)).alias("rows")).cast(kind)

    start = F.struct(F.array().cast("array<struct<depth:int,text:string>>").alias("stack"), F.array().cast("array<struct<path:array<string>,statement:string>>").alias("rows")).cast(kind)
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n", -1), start, step, lambda acc: acc["rows"])


def _last(pattern: str, name: str, source: str = "statement") -> Column:
    """What the last line that matches says."""
    got = F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))
    return F.max_by(got, F.when(got.isNotNull(), F.col("pos"))).alias(name)


def indented_peers(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, local_as, vrf, peer_ip, peer_group, address_family and the settings of peers (CFG-05).

    A peer's own settings count before its group's, field by field; switches are only turned on. A
    peer without families has one row with an empty one.
    """
    rows = df.select(*keys, F.posexplode(outline(F.col(text))).alias("pos", "r")).select(*keys, "pos", F.concat("r.path", F.array("r.statement")).alias("p"), "r.statement")
    rows = rows.where(F.get("p", F.lit(0)).rlike(r"^router bgp \d+")).withColumn("local_as", F.regexp_extract(F.get("p", F.lit(0)), r"^router bgp (\d+)", 1).cast("long"))
    vrf = F.regexp_extract(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"^vrf\s+(\S+)", 1)
    head = F.coalesce(F.get("p", F.when(vrf != "", 2).otherwise(1)), F.lit(""))
    form = r"^(neighbor-group|neighbor)\s+(\S+)"
    family = F.get(F.filter("p", lambda x: x.rlike(r"(?i)^address-family\s")), F.lit(-1) + F.size(F.filter("p", lambda x: x.rlike(r"(?i)^address-family\s"))))
    rows = rows.withColumns({"vrf": vrf, "kind": F.regexp_extract(head, form, 1), "name": F.regexp_extract(head, form, 2), "family": F.regexp_extract(F.coalesce(family, F.lit("")), r"(?i)^address-family\s+(.+)$", 1)}).where("kind <> ''")
    on = lambda p, name: F.max(F.col("statement").rlike(p).cast("int")).alias(name)
    own = [*keys, "local_as", "vrf", "kind", "name"]
    facts = rows.groupBy(*own).agg(
        _last(r"(?i)^remote-as\s+(\d+)", "remote_as"), _last(r"(?i)^update-source\s+(\S+)", "update_source"), _last(r"(?i)^ebgp-multihop\s+(\d+)", "ebgp_multihop"), on(r"(?i)^bfd\s+minimum-interval", "bfd_enabled"),
        _last(r"(?i)^use\s+neighbor-group\s+(\S+)", "peer_group"), _last(r"(?i)^description\s+(.+)$", "description"), on(r"(?i)^shutdown", "shutdown"),
    )
    said = rows.where("family <> ''").groupBy(*own, "family").agg(_last(r"(?i)^route-policy\s+(\S+)\s+in", "import_policy"), _last(r"(?i)^route-policy\s+(\S+)\s+out", "export_policy"), on(r"(?i)^soft-reconfiguration\s+inbound", "soft_reconfig"), on(r"(?i)^next-hop-self", "next_hop_self"))
    shared = ("remote_as", "update_source", "ebgp_multihop", "bfd_enabled")
    groups = facts.where("kind = 'neighbor-group' and vrf = ''").select(*keys, F.col("name").alias("peer_group"), *(F.col(c).alias(f"_{c}") for c in shared))
    peers = facts.where("kind = 'neighbor'").join(groups, [*keys, "peer_group"], "left")
    peers = peers.withColumns({c: F.coalesce(c, f"_{c}") for c in shared[:3]} | {"bfd_enabled": F.greatest("bfd_enabled", F.coalesce("_bfd_enabled", F.lit(0)))})
    of_group = said.where("kind = 'neighbor-group' and vrf = ''").drop("vrf", "kind", "local_as").withColumnRenamed("name", "peer_group")
    values = ["import_policy", "export_policy", "soft_reconfig", "next_hop_self"]
    ranked = said.where("kind = 'neighbor'").select(*keys, "vrf", "name", "family", *values, F.lit(0).alias("place"))
    ranked = ranked.unionByName(peers.select(*keys, "vrf", "name", "peer_group").join(of_group, [*keys, "peer_group"]).select(*keys, "vrf", "name", "family", *values, F.lit(1).alias("place")))
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    families = ranked.groupBy(*keys, "vrf", "name", "family").agg(pick("import_policy"), pick("export_policy"), F.max("soft_reconfig").alias("soft_reconfig"), F.max("next_hop_self").alias("next_hop_self"))
    out = peers.join(families, [*keys, "vrf", "name"], "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long")).alias(c)
    return out.select(*keys, "local_as", "vrf", F.col("name").alias("peer_ip"), number("remote_as"), blank("peer_group"), blank("description"), blank("update_source"), number("ebgp_multihop"), F.coalesce("family", F.lit("")).alias("address_family"), blank("import_policy"), blank("export_policy"), number("soft_reconfig"), number("next_hop_self"), "bfd_enabled", "shutdown", (1 - F.col("shutdown")).alias("enabled"))


def _nested_rows(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(nested(F.col(text))).alias("pos", "r")).select(*keys, "pos", "r.path", "r.statement")


def nested_peers(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, local_as, peer_ip, peer_group, address_family and the settings of peers of brace-nested texts (CFG-06).

    A row for each peer and family of its group (ipv4-unicast without any); an internal group's
    peers have the local number unless they name one; a peer's policies count before its group's.
    Peers without any statement of their own are not seen.
    """
    rows = _nested_rows(df, text, keys)
    local = rows.where("path rlike '(^|/ )routing-options( /|$)' and statement rlike '^autonomous-system [0-9]+'").groupBy(*keys).agg(F.min_by(F.regexp_extract("statement", r"^autonomous-system (\d+)", 1), "pos").cast("long").alias("local_as"))
    rows = rows.where("path like 'protocols / bgp / group %'").withColumns({"peer_group": F.regexp_extract("path", r"^protocols / bgp / group (\S+)", 1), "peer_ip": F.regexp_extract("path", r"^protocols / bgp / group \S+ / neighbor (\S+)", 1), "below": F.size(F.split("path", " / "))})
    top = lambda p, name, depth: F.min_by(F.regexp_extract("statement", p, 1), F.when(F.col("statement").rlike(p) & (F.col("below") == depth), F.col("pos"))).alias(name)
    groups = rows.groupBy(*keys, "peer_group").agg(
        top(r"^type (\S+)", "type", 3), top(r"^local-address (\S+)", "update_source", 3), top(r"^peer-as (\d+)", "_as", 3), top(r"^import (.+)", "_import", 3), top(r"^export (.+)", "_export", 3),
        F.array_sort(F.collect_set(F.nullif(F.regexp_extract("path", r"^protocols / bgp / group \S+ / (?:neighbor \S+ / )?family (\S+)", 1), F.lit("")))).alias("families"),
    )
    peers = rows.where("peer_ip <> ''").groupBy(*keys, "peer_group", "peer_ip").agg(top(r'^description "?([^"]*)"?', "description", 4), top(r"^peer-as (\d+)", "own", 4), top(r"^import (.+)", "import_policy", 4), top(r"^export (.+)", "export_policy", 4))
    names = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    known = F.filter(F.transform("families", lambda f: F.element_at(names, f)), lambda f: f.isNotNull())
    out = peers.join(groups, [*keys, "peer_group"]).join(local, keys, "left").withColumn("address_family", F.explode(F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("ipv4-unicast")))))
    remote = F.coalesce(F.col("own").cast("long"), F.col("_as").cast("long"), F.when(F.lower("type") == "internal", F.col("local_as")), F.lit(0))
    blank = lambda name, *cs: F.coalesce(*cs, F.lit("")).alias(name)
    return out.select(*keys, F.coalesce("local_as", F.lit(0)).alias("local_as"), "peer_ip", remote.alias("remote_as"), "peer_group", blank("description", "description"), blank("update_source", "update_source"), "address_family", blank("import_policy", "import_policy", "_import"), blank("export_policy", "export_policy", "_export"))


def vrfs(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, vrf_name, rd, import_rt, export_rt (joined by blanks), tunnel_policy, label_mode of `ip vpn-instance` blocks (CFG-07).

    Blocks of one name are merged: the first that says a thing counts, lists are taken whole.
    """
    rows = df.select(*keys, F.posexplode(blocks(F.col(text), "#")).alias("at", "b"))
    name = F.regexp_extract(F.get("b", F.lit(0)), r"(?i)^ip\s+vpn-instance\s+(\S+)", 1)
    last = lambda p: F.nullif(F.regexp_extract(F.element_at(F.concat(F.array(F.lit("")), F.filter("b", lambda x: x.rlike(p))), -1), p, 1), F.lit(""))
    targets = lambda way: F.nullif(F.array_join(F.array_distinct(F.flatten(F.transform(F.filter("b", lambda x: x.rlike(rf"(?i)^\s*vpn-target\s+.*\s{way}-extcommunity\s*$")), lambda x: F.regexp_extract_all(x, F.lit(r"\s(\d\S*:\S+)"), F.lit(1))))), " "), F.lit(""))
    said = {"rd": last(r"(?i)^\s*route-distinguisher\s+(\S+)"), "import_rt": targets("import"), "export_rt": targets("export"), "tunnel_policy": last(r"(?i)^\s*tnl-policy\s+(\S+)"), "label_mode": last(r"(?i)^\s*label-mode\s+(\S+)")}
    rows = rows.select(*keys, "at", name.alias("vrf_name"), *(c.alias(n) for n, c in said.items())).where("vrf_name <> ''")
    return rows.groupBy(*keys, "vrf_name").agg(*(F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))), F.lit("")).alias(c) for c in said))


def indented_vrfs(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, vrf_name, rd, import_rt, export_rt (joined by blanks), import_policy, export_policy, address_family of `vrf` blocks (CFG-07).

    Blocks of one name, at the top or in `router bgp`, are merged: those at the top come first, then
    the first that says a thing counts; lists are taken whole from one block.
    """
    rows = df.select(*keys, F.posexplode(outline(F.col(text))).alias("pos", "r")).select(*keys, "pos", F.concat("r.path", F.array("r.statement")).alias("p"), "r.statement")
    deep = F.when(F.get("p", F.lit(0)).rlike(r"^router bgp \d+"), 1).otherwise(0)
    head = F.regexp_extract(F.coalesce(F.get("p", deep), F.lit("")), r"^vrf\s+(\S+)", 1)
    rows = rows.withColumns({"deep": deep, "vrf_name": head}).where("vrf_name <> ''")
    # A block begins where its own line stands; lines below it follow.
    begins = F.when(F.size("p") == F.col("deep") + 1, F.col("pos"))
    starts = rows.where(begins.isNotNull()).groupBy(*keys, "vrf_name").agg(F.array_sort(F.collect_list("pos")).alias("starts"))
    rows = rows.join(starts, [*keys, "vrf_name"]).withColumn("block", F.array_max(F.filter("starts", lambda x: x <= F.col("pos"))))
    under = lambda p: F.exists("p", lambda x: x.rlike(p))
    target = F.nullif(F.regexp_extract("statement", r"^(\d+:\d+)$", 1), F.lit(""))
    joined = lambda way: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(under(rf"(?i)^{way}\s+route-target") & target.isNotNull(), F.struct("pos", target.alias("t"))))), lambda x: x["t"]), " "), F.lit("")).alias(f"{way}_rt")
    said = rows.groupBy(*keys, "vrf_name", "deep", "block").agg(_last(r"(?i)^rd\s+(\S+)", "rd"), joined("import"), joined("export"), _last(r"(?i)^import\s+route-policy\s+(\S+)", "import_policy"), _last(r"(?i)^export\s+route-policy\s+(\S+)", "export_policy"), _last(r"(?i)^address-family\s+(.+)$", "address_family"))
    place = F.struct("deep", "block")
    return said.groupBy(*keys, "vrf_name").agg(*(F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), place)), F.lit("")).alias(c) for c in ("rd", "import_rt", "export_rt", "import_policy", "export_policy", "address_family")))


# Conditions of a policy, and the names of what they match.
CONDITIONS = (("community", r"(?i)community\s+(?:matches-any|matches-every)\s+(\([^)]+\)|\S+)"), ("extcommunity-soo", r"(?i)extcommunity\s+soo\s+(?:matches-any|matches-every)\s+(\([^)]+\)|\S+)"), ("destination-prefix-set", r"(?i)destination\s+in\s+(\([^)]+\)|\S+)"), ("next-hop", r"(?i)next-hop\s+in\s+(\S+)"))


def indented_policy_nodes(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, policy, sequence, action, match, apply of `route-policy NAME ... end-policy`: a node for each if, elseif and else (CFG-08).

    Nodes are numbered by tens, or one 0 where nothing is conditional. match and apply are arrays of (type, value).
    """
    pair = "array<struct<type:string,value:string>>"
    kind = f"struct<action:string,match:{pair},apply:{pair}>"
    node = lambda match: F.struct(F.lit("").alias("action"), match.alias("match"), F.array().cast(pair).alias("apply")).cast(kind)
    clause = lambda t, v: F.struct(t.alias("type"), F.trim(v).alias("value"))

    def of_kind(x: Column, name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda v: clause(F.lit(name), v))

    def conditions(x: Column) -> Column:
        return F.flatten(F.array(*(of_kind(x, name, p) for name, p in CONDITIONS))).cast(pair)

    def step(acc: Column, line: Column) -> Column:
        x = F.trim(line)
        test, other = F.regexp_extract(x, r"(?i)^(?:if|elseif)\s+(.+)\s+then$", 1), x.rlike("(?i)^else$")
        opens = (test != "") | other
        nodes = F.when(opens, F.concat(acc["nodes"], F.array(node(conditions(test))))).when(F.size(acc["nodes"]) == 0, F.array(node(F.array().cast(pair)))).otherwise(acc["nodes"])
        sets = r"(?i)^set\s+(\S+)\s+(.+)$"
        added = F.when(x.rlike(sets), clause(F.regexp_extract(x, sets, 1), F.regexp_extract(x, sets, 2))).when(x.rlike(r"(?i)^apply\s+\S"), clause(F.lit("apply"), F.regexp_extract(x, r"(?i)^apply\s+(\S+)", 1))).when(x.rlike(r"(?i)^prepend\s+\S"), clause(F.lit("prepend"), F.regexp_extract(x, r"(?i)^prepend\s+(.+)$", 1)))
        act = F.when(x.rlike("(?i)^pass$"), "permit").when(x.rlike("(?i)^drop$"), "deny")
        last = F.size(nodes) - 1
        filled = F.transform(nodes, lambda n, i: F.when(i == last, F.struct(F.coalesce(act, n["action"]).alias("action"), n["match"].alias("match"), F.when(added.isNotNull(), F.concat(n["apply"], F.array(added))).otherwise(n["apply"]).alias("apply")).cast(kind)).otherwise(n))
        blank = x.rlike(r"(?i)^(|endif|end-policy|!)$")
        return F.struct((acc["ifs"] | opens).alias("ifs"), F.when(blank, acc["nodes"]).when(opens, nodes).otherwise(filled).alias("nodes"))

    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?m)^route-policy[ \t]+\S[^\n]*(?:\n(?!end-policy)[^\n]*)*"), F.lit(0))
    rows = df.select(*keys, F.explode(found).alias("b")).select(*keys, F.regexp_extract("b", r"^route-policy\s+(\S+)", 1).alias("policy"), F.split("b", "\n", -1).alias("l"))
    start = F.struct(F.lit(False).alias("ifs"), F.array().cast(f"array<{kind}>").alias("nodes"))
    rows = rows.select(*keys, "policy", F.aggregate(F.slice("l", F.lit(2), F.size("l")), start, step).alias("n"))
    nodes = F.when(F.size("n.nodes") == 0, F.array(node(F.array().cast(pair)))).otherwise(F.col("n.nodes"))
    return rows.select(*keys, "policy", "n.ifs", F.posexplode(nodes).alias("i", "n")).select(*keys, "policy", F.when(F.col("ifs"), (F.col("i") + 1) * 10).otherwise(0).alias("sequence"), "n.action", "n.match", "n.apply")


def nested_vrfs(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, vrf_name, rd, import_policy, export_policy of routing instances of type vrf (CFG-07)."""
    rows = _nested_rows(df, text, keys).where("path like 'routing-instances / %'").withColumn("vrf_name", F.split("path", " / ")[1])
    first = lambda p, name: F.coalesce(F.min_by(F.regexp_extract("statement", p, 1), F.when(F.col("statement").rlike(p), F.col("pos"))), F.lit("")).alias(name)
    out = rows.groupBy(*keys, "vrf_name").agg(first(r"^instance-type (\S+)", "type"), first(r"^route-distinguisher (\S+)", "rd"), first(r"^vrf-import (.+)", "import_policy"), first(r"^vrf-export (.+)", "export_policy"))
    return out.where("lower(type) = 'vrf'").drop("type")


def policy_nodes(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, policy, sequence, action, match, apply of `route-policy NAME permit node N` blocks (CFG-08).

    match and apply are arrays of (type, value).
    """
    form = r"(?i)^route-policy\s+(\S+)\s+(permit|deny)\s+node\s+(\d+)"
    rows = df.select(*keys, F.explode(blocks(F.col(text), "#")).alias("b"))
    head = F.get("b", F.lit(0))
    clauses = lambda p: F.transform(F.filter("b", lambda x: x.rlike(p)), lambda x: F.struct(F.regexp_extract(x, p, 1).alias("type"), F.regexp_extract(x, p, 2).alias("value")))
    return rows.where(head.rlike(form)).select(*keys, F.regexp_extract(head, form, 1).alias("policy"), F.regexp_extract(head, form, 3).cast("int").alias("sequence"), F.lower(F.regexp_extract(head, form, 2)).alias("action"), clauses(r"(?i)^\s*if-match\s+(\S+)\s+(.+)").alias("match"), clauses(r"(?i)^\s*apply\s+(\S+)\s+(.+)").alias("apply"))


def nested_policy_nodes(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, policy, term, sequence, action, match, apply (arrays of statements) of policy statements (CFG-08).

    Terms come in order, numbered by tens; a `then` outside terms is the term _default at the end.
    """
    rows = _nested_rows(df, text, keys).where("path like 'policy-options / policy-statement %'")
    term = F.regexp_extract("path", r" / term (\S+)", 1)
    part = F.regexp_extract("path", r" / (from|then)$", 1)
    single = F.regexp_extract("statement", r"^(from|then) ", 1)
    rows = rows.withColumns({"policy": F.regexp_extract("path", r"policy-statement (\S+)", 1), "term": F.when(term == "", "_default").otherwise(term), "part": F.when(part != "", part).otherwise(single), "said": F.when(part != "", F.col("statement")).otherwise(F.regexp_replace("statement", "^(from|then) ", ""))}).where("part <> ''")
    ends = F.col("said").isin("accept", "reject")
    taken = lambda hit: F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("pos", "said")))), lambda x: x["said"])
    nodes = rows.groupBy(*keys, "policy", "term").agg(F.min("pos").alias("pos"), F.coalesce(F.max_by(F.when(ends, F.col("said")), F.when(ends & (F.col("part") == "then"), F.col("pos"))), F.lit("")).alias("action"), taken(F.col("part") == "from").alias("match"), taken((F.col("part") == "then") & ~ends).alias("apply"))
    # A policy's terms are few and meet in one array, so they are numbered without a window.
    order = F.array_sort(F.collect_list(F.struct((F.col("term") == "_default").alias("late"), "pos", "term", "action", "match", "apply")))
    whole = nodes.where("term <> '_default' or action <> ''").groupBy(*keys, "policy").agg(order.alias("n"))
    return whole.select(*keys, "policy", F.posexplode("n").alias("i", "n")).select(*keys, "policy", "n.term", ((F.col("i") + 1) * 10).alias("sequence"), "n.action", "n.match", "n.apply")
