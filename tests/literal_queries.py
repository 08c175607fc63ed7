"""Operators over texts and facts that stand here; the rows that come out stand in literal_rows.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from literal_rows import ROWS
from ridgeline.functions import classify, commands, naming, network, questions
from ridgeline.operators import config, devices, graph, merge, outputs, reports, routing, search, sessions, topology
from ridgeline.plans import program
from ridgeline.sources import sinks

FOUND: dict = {}


def query(f):
    FOUND[f.__name__] = f
    return f


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if kind == "VARCHAR":
        return "'" + str(value).replace("'", "''") + "'"
    return f"CAST('{value}' AS {kind})" if kind in ("TIMESTAMP", "DOUBLE") else f"CAST({value} AS {kind})"


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (columns, rows) in ROWS.items():
        if name in FOUND:
            names, kinds = zip(*(c.split(" ") for c in columns), strict=True)
            values = ", ".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
            out[name] = f"SELECT * FROM (VALUES {values}) AS t({', '.join(names)})"
    return out


def _rows(spark: SparkSession, schema: str, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _parsed(spark: SparkSession, vendor: str, kind: str, *texts: str) -> DataFrame:
    base = "neighbor" if kind in ("ospf", "ldp", "peers") else kind
    blocks = _rows(spark, "block int, vendor string, cmd_type string, output string", *((i, vendor, base, t) for i, t in enumerate(texts)))
    return outputs.parsed(blocks, vendor, kind, ["block"])


# Outputs (PAR).


@query
def huawei_interface_rows(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, "huawei", "interface", "PHY: Physical\n*down: administratively down\nInterface PHY Protocol InUti OutUti inErrors outErrors\nEth-Trunk1 up up 0.01% 0.02% 0 0\nGigabitEthernet0/0/1 *down down 0% 0% 0 0\nLoopBack0 up up(s) 0% 0% 0 0\n")


@query
def huawei_route_rows(spark: SparkSession, d: str) -> DataFrame:
    text = "Routing Tables: Public\n Destination/Mask Proto Pre Cost Flags NextHop Interface\n 10.0.0.0/8 Static 60 0 RD 10.1.1.1 GigabitEthernet0/0/1\n 10.2.0.0/16 OSPF 10 3 D 10.1.1.2 Eth-Trunk1\nRouting Table : VPN-A\n 172.16.0.0/12 IBGP 255 0 RD 1.1.1.1 Tunnel0\n"
    return _parsed(spark, "huawei", "rib", text)


@query
def huawei_label_rows(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, "huawei", "lfib", "FEC In/Out Label In/Out IF Vrf Name\n1.1.1.1/32 NULL/3 -/GE0/0/1\n2.2.2.2/32 1024/3 -/GE0/0/1\n3.3.3.3/32 1025/2048 -/GE0/0/2\n4.4.4.4/32 NULL/1030 -/GE0/0/3\n")


@query
def huawei_neighbor_rows(spark: SparkSession, d: str) -> DataFrame:
    ospf = _parsed(spark, "huawei", "ospf", "OSPF Process 1\n Area Id Interface Neighbor id State\n 0.0.0.0 GE0/0/1 2.2.2.2 Full\n 0.0.0.1 GE0/0/2 3.3.3.3 2-Way\n")
    ldp = _parsed(spark, "huawei", "ldp", "LDP Session(s)\nPeerID Status LAM SsnRole\n2.2.2.2:0 Operational DU Passive\nTOTAL: 1 session(s)\n")
    return ospf.unionByName(ldp, allowMissingColumns=True)


@query
def cisco_interface_rows(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, "cisco", "interface", "Interface              IP-Address      OK? Method Status                Protocol\nGi0/0 10.0.0.1 YES NVRAM up up\nGi0/1 unassigned YES unset administratively down down\n")


@query
def cisco_route_rows(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, "cisco", "rib", "Codes: C - connected, S - static\nGateway of last resort is 10.0.0.254\nS*   0.0.0.0/0 [1/0] via 10.0.0.254\nC    10.0.0.0/24 is directly connected, Gi0/0\nO    10.9.0.0/16 [110/20] via 10.0.0.2, 00:01:02, Gi0/1\n")


@query
def cisco_label_rows(spark: SparkSession, d: str) -> DataFrame:
    text = "Local  Outgoing    Prefix             Bytes Label   Outgoing   Next Hop\nLabel  Label or VC or Tunnel Id      Switched      interface\n16     Pop Label   10.0.0.2/32        0             Gi0/1      10.1.1.2\n17     24001       10.0.0.3/32        120           Gi0/2      10.1.2.2\n18     No Label    10.0.0.4/32        0             Gi0/3      10.1.3.2\nnone of these\n"
    return _parsed(spark, "cisco", "lfib", text)


@query
def cisco_neighbor_rows(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, "cisco", "ospf", "Neighbor ID     Pri   State           Dead Time   Address         Interface\n\n2.2.2.2           1   FULL/DR         00:00:35    10.0.0.2        Gi0/0\n3.3.3.3           1   2WAY/DROTHER    00:00:31    10.0.0.3        Gi0/0\n")


@query
def juniper_rows(spark: SparkSession, d: str) -> DataFrame:
    faces = _parsed(spark, "juniper", "interface", "Interface               Admin Link Proto    Local                 Remote\nge-0/0/0                up    up\nge-0/0/0.0              up    up   inet     10.0.0.1/30\nge-0/0/1                down  up\n").select(F.lit("interface").alias("kind"), "row_no", "name", "status", "ip_address", "mask")
    ospf = _parsed(spark, "juniper", "ospf", "Address          Interface              State     ID               Pri  Dead\n10.0.0.2         ge-0/0/0.0             Full      2.2.2.2          128    35\n").select(F.lit("neighbor"), "row_no", "remote_id", "state", "remote_address", "local_interface")
    return faces.union(ospf)


@query
def juniper_route_rows(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, "juniper", "rib", "inet.0: 2 destinations\n10.0.0.0/24        *[Direct/0] 1d 02:03:04\n                    > via ge-0/0/0.0\n10.5.0.0/16        *[OSPF/10] 00:10:00, metric 2\n                    > to 10.0.0.2 via ge-0/0/0.0\n")


@query
def h3c_interface_rows(spark: SparkSession, d: str) -> DataFrame:
    by_ip = "*down: administratively down\nInterface Physical Protocol IP Address Description\nFGE2/0/1 up up 10.48.58.244 to core one\nGE1/0/2 *down down unassigned\nLoop0 up up(s) 1.1.1.1 --\n"
    brief = "Brief information on interfaces in route mode:\nLink: ADM - administratively down\nInterface            Link Speed   Duplex Type  PVID Description\nFGE2/0/1             UP   40G(a)  Full   A     1\nGE1/0/3              ADM  auto    A      A     1    spare port\n"
    verbose = "GigabitEthernet1/0/1\n Current state: UP\n Description: to edge 7\n Internet Address is 10.0.0.1/30 Primary\n\nLoopBack0\n Current state: UP(spoofing)\n Internet Address is 2.2.2.2/32 Primary\nTunnel1\n Current state: Administratively DOWN\n"
    return _parsed(spark, "h3c", "interface", by_ip, brief, verbose)


@query
def h3c_neighbor_rows(spark: SparkSession, d: str) -> DataFrame:
    bgp = " BGP local router ID: 10.48.58.1\n Local AS number: 1001\n  Peer                    AS  MsgRcvd  MsgSent OutQ PrefRcv Up/Down  State\n  * - dynamic\n  10.48.58.245          1001  4769972  4769000    0     120 0900h12m Established\n  10.48.58.246          1002        0        3    0       0 00:00:09 Idle\n"
    ospf = " OSPF Process 1 with Router ID 1.1.1.1\n Area Id          Interface            Neighbor id      State\n 0.0.0.0          GE0/0                10.0.0.2         Full\n"
    return _parsed(spark, "h3c", "peers", bgp, ospf)


@query
def h3c_route_rows(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, "h3c", "rib", "Destinations : 4\nDestination/Mask   Proto  Pre Cost  NextHop   Interface\n10.0.0.0/8         O_INTRA 10 3     10.1.1.1  FGE2/0/1\n10.2.0.0/16        S      60  0     10.1.1.2  GE1/0/1\n10.3.0.0/16        Direct 0   0     10.3.0.1  Vlan3\n10.4.0.0/16        b      255 0     9.9.9.9   GE1/0/2\n")


# Programs (DSL).

ACL = "Advanced ACL  3000, 2 rules\nACL's step is 5\n rule 5 permit ip source 10.0.0.0 0.0.0.255 (3 matches)\n rule 10 deny tcp\n\nBasic ACL 2001, 1 rule\nACL's step is 5\n rule 0 permit source any\n"


@query
def dsl_access_lists(spark: SparkSession, d: str) -> DataFrame:
    """PAR-17, 18: rules, each with the number of its list."""
    text = "REPEAT_FOR ACL\\s+(?P<acl>\\d+),\nFILTER ^\\s*rule \\d+\nREGEX rule (?P<rule>\\d+) (?P<action>permit|deny)"
    return program.run(_rows(spark, "k int, t string", (1, ACL)), text, "t", ["k"])


@query
def dsl_route_policies(spark: SparkSession, d: str) -> DataFrame:
    """PAR-17, 18: nodes of policies below their policy, clauses below their node."""
    said = "Route-policy: OUT\n  permit : 10\n    Match clauses:\n      if-match ip-prefix P1\n    Apply clauses:\n      apply cost 20\n  deny : 20\nRoute-policy: IN\n  permit : 5\n    Match clauses:\n      if-match tag 7\n"
    text = "REPEAT_FOR ^Route-policy: (?P<policy>\\S+)\n  REPEAT_FOR ^\\s+(?P<action>permit|deny) : (?P<node>\\d+)\n    FILTER ^\\s+(if-match|apply)\n    REGEX ^\\s+(?P<what>if-match|apply) (?P<clause>.+)$"
    return program.run(_rows(spark, "k int, t string", (1, said)), text, "t", ["k"])


@query
def dsl_skips(spark: SparkSession, d: str) -> DataFrame:
    """DSL-03, 04, 06: what comes before a header, lines below it, and what comes behind an end are left out."""
    said = "noise\nName Value\n-----\na 1\n\nb 2\nTotal 2\nc 3\n"
    return program.run(_rows(spark, "k int, t string", (1, said)), "SKIP_UNTIL ^Name\nSKIP_LINES 1\nSTOP_AT ^Total\nSKIP_BLANK\nSPLIT $name $value", "t", ["k"])


# Logs and devices (SPL, SRC-01).

LOG = "noise\n2026-03-21-13-11-26: <core-S12700>display version\nVRP\n<core-S12700>display current-configuration\n!Software Version V800R021\nsysname core-S12700\n#\n<core-S12700>display ospf peer\n Area Id Interface Neighbor id State\n 0.0.0.0 GE0/0/1 2.2.2.2 Full\n<core-S12700>display ip rout ?\nhelp\nRP/0/RSP0/CPU0:edge-ASR9912#show mpls forwarding\nLocal  Outgoing    Prefix Bytes Label Outgoing Next Hop\n16     Pop Label   10.0.0.2/32        0             Gi0/1      10.1.1.2\nRP/0/RSP0/CPU0:edge-ASR9912#show clock detail\n12:00\n[agg-H9850C]dis cur\nversion 7.1.070\n#\n"
RAW = "#\nsysname lone-CE6800\n!Software Version V200R005\ninterface LoopBack0\n ip address 9.9.9.9 32\n#\n<lone-CE6800>\n"


def _files(spark: SparkSession) -> DataFrame:
    return _rows(spark, "file string, content string", ("a.log", LOG), ("b.cfg", RAW), ("c.txt", "nothing here\n"))


@query
def log_blocks(spark: SparkSession, d: str) -> DataFrame:
    return devices.ingest(_files(spark))["blocks"].select("file", "block_no", "hostname", "vendor", "command", "command_norm", "cmd_type", "category", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"))


@query
def log_devices(spark: SparkSession, d: str) -> DataFrame:
    return devices.ingest(_files(spark))["devices"].select("device_id", "hostname", "vendor", F.array_join("commands", "; ").alias("commands"), "os_version", "model")


@query
def log_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = devices.ingest(_files(spark))
    configs = facts["configs"].select(F.lit("config").alias("what"), "device_id", F.replace("config_text", F.lit("\n"), F.lit("|")).alias("said"))
    seen = facts["neighbors"].select(F.lit("neighbor"), "device_id", F.concat_ws(" ", "protocol", "remote_id", "state"))
    labels = facts["labels"].select(F.lit("label"), "device_id", F.concat_ws(" ", "in_label", "action", "fec"))
    return configs.union(seen).union(labels).union(facts["pad"].select(F.lit("pad"), "device_id", F.concat_ws(" ", "category", "command")))


@query
def device_models(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, "h string, v string", ("bj-NE40E-X8", "huawei"), ("x_HW12816", "huawei"), ("sh-H12516AF-1", "h3c"), ("ce-n9k-c9300", "cisco"), ("asr9912.lab", "huawei"), ("vmx-2", "juniper"), ("plain", "cisco"), ("S6800-a", "h3c"))
    return rows.select(F.col("h").alias("hostname"), devices.model(F.col("h"), F.col("v")).alias("model"))


@query
def os_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, "i int, v string, t string", (1, "huawei", "!Software Version V800R011C00\n#"), (2, "cisco", "!! IOS XR Configuration 7.3.2\n!"), (3, "cisco", "Cisco IOS XR Software, Version 6.5.1"), (4, "h3c", " version 7.1.070, Release 1\n"), (5, "juniper", "version 20.4R3;\nsystem {"), (6, "juniper", "no version"))
    return rows.select("i", devices.os_version(F.col("t"), F.col("v")).alias("os_version"))


@query
def clean_configs(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, "i int, t string", (1, "Mon Mar 21 13:11:26.123 UTC\nBuilding configuration...\n!! IOS\nhostname a\nend\n\nRP/0/RSP0/CPU0:a#\n"), (2, "\n#\nsysname b\n#\n<b-one>\n [b-one] \n"), (3, "{master:0}\nuser@jun>"), (4, "kept <x>y\n"))
    return rows.select("i", F.replace(devices.clean_config(F.col("t")), F.lit("\n"), F.lit("|")).alias("text"))


@query
def longest_outputs(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, "n int, vendor string, command_norm string, command string, output string", (1, "huawei", "display x {id}", "display x 1", "ab"), (2, "huawei", "display x {id}", "display x 2", "abcd"), (3, "huawei", "display x {id}", "display x 3", "efgh"), (4, "cisco", "show y", "show y", ""))
    return sessions.longest_outputs(rows, "n")


@query
def log_analysis(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(
        spark, "n int, vendor string, command string, output string", (1, "huawei", "display foo 1", "short"), (2, "huawei", "display foo 2", "Error: no such thing, and this is the longest"), (3, "huawei", "quit", ""), (4, "huawei", "display ospf peer", "rows"),
        (5, "cisco", "show clock detail", "12:00"), (6, "huawei", "display bar ?", "  all       Show all\n  brief     Show brief\n  detail    Show detail"),
    )
    return sessions.analysed(rows, "n").select("vendor", "command_norm", "command", "cmd_type", "has_output", "is_control", "is_help", "is_error", "selected", "place")


@query
def user_permissions(spark: SparkSession, d: str) -> DataFrame:
    groups = _rows(spark, "place int, grp string, users array<string>", (1, "admin", ["ann"]), (2, "guest", ["*"]), (3, "ops", ["bob", "ann"]), (4, "rest", ["cid", "*"]))
    return classify.user_groups(_rows(spark, "user string", ("ann",), ("bob",), ("cid",), ("dan",)), groups)


@query
def knowledge_files(spark: SparkSession, d: str) -> DataFrame:
    text = "intro\n## One\n" + "first part " * 8 + "\n## Two\n" + "second part " * 8
    files = _rows(spark, "file string, text string", ("a.md", text), ("b.md", "# B\n" + "only one " * 9))
    cached = _rows(spark, "file string, text string, chunk_no int, chunk string", ("b.md", "# B\n" + "only one " * 9, 0, "kept"), ("a.md", "old", 0, "gone")).select("file", F.sha2("text", 256).alias("content_hash"), "chunk_no", "chunk")
    known, fresh = search.knowledge(files, cached)
    part = lambda df, what: df.select(F.lit(what).alias("what"), "file", "chunk_no", F.left("chunk", F.lit(10)).alias("start"))
    return part(known, "known").union(part(fresh, "fresh"))


@query
def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, "i int, h string", (1, "0000803f000000c0"), (2, "00"), (3, ""))
    return rows.select("i", F.array_join(F.transform(search.float_vector(F.unhex("h")), lambda x: x.cast("string")), ",").alias("floats"))


@query
def rule_self_tests(spark: SparkSession, d: str) -> DataFrame:
    samples = _rows(spark, "k int, t string", (1, "Name Value\na 1\nb 2\n"), (2, "nothing"), (3, "Name Value\na\nb\nc 1\n"))
    good = reports.self_test(samples, "SKIP_UNTIL ^Name\nSKIP_BLANK\nSPLIT $name $value $more $rest", "k", "t")
    return good.withColumn("rate", F.round("rate", 6)).union(reports.self_test(samples.where("k = 1"), "NO_SUCH_VERB x", "k", "t"))


@query
def rule_too_few_rows(spark: SparkSession, d: str) -> DataFrame:
    policies = "".join(f"Route-policy: P{i}\n  permit : 10\n" for i in range(6))
    peers = "".join(f"Peer state of {i}\n" for i in range(5))
    rows = _rows(spark, "k int, t string, n int", (1, policies, 2), (2, policies, 3), (3, peers, 1), (4, "a\nb\n", 0))
    return reports.too_few_rows(rows, "k", "t", "n")


@query
def edit_scripts(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, "k int, old string, new string", (1, "a\nb\nc\na\nb\nb\na", "c\nb\na\nb\na\nc"), (2, "x", "x"), (3, None, "y"))
    out = reports.sequence_difference(rows, ["k"], "old", "new")
    return out.groupBy("k", "sign").agg(F.count("*").alias("lines"))


@query
def rule_seeds(spark: SparkSession, d: str) -> DataFrame:
    rules = classify.seeded(_rows(spark, "vendor string, prefix string, kind string, priority int"))
    return classify.longest_prefix(_rows(spark, "v string", ("display ip routing-table vpn",), ("display int brief",), ("DISPLAY SA",), ("quit",)), "v", rules.where("vendor = 'huawei'"), [])


# Questions and names.

ASKED = ((1, "Show all interfaces of CORE-1"), (2, "why is bgp down on edge2?"), (3, "search config vlan 12"), (4, "列出 设备"), (5, "display ospf neighbor"), (6, "hello mpls ldp"), (7, "list peers over te"))


@query
def question_kinds(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return _rows(spark, "question_id int, question string", *ASKED).select("question_id", questions.intent(q).alias("intent"), questions.protocol(q).alias("protocol"), questions.search_term(q).alias("term"))


@query
def question_devices(spark: SparkSession, d: str) -> DataFrame:
    known = _rows(spark, "id string, hostname string", ("d1", "core-1"), ("edge2", "Edge2.lab"), ("d9", ""))
    return questions.relevant_devices(_rows(spark, "question_id int, question string", *ASKED), known)


@query
def question_sections(spark: SparkSession, d: str) -> DataFrame:
    text = "#\nsysname a\n#\nbgp 100\n peer 10.0.0.1 as-number 200\n#\nospf 1\n area 0\n#\nip route-static 0.0.0.0 0 10.0.0.9\n#"
    rows = _rows(spark, "i int, q string, most int", (1, "bgp peers?", 0), (2, "hello", 0), (3, "OSPF and route", 0))
    return rows.select("i", F.replace(questions.sections(F.lit(text), F.col("q"), 60), F.lit("\n"), F.lit("|")).alias("config"))


@query
def question_context(spark: SparkSession, d: str) -> DataFrame:
    known = _rows(spark, "id string, hostname string", ("d1", "core-1"), ("edge2", "Edge2.lab"))
    configs = _rows(spark, "device_id string, config_text string", ("edge2", "#\nbgp 65001\n peer 1.1.1.1 enable\n#"))
    out = questions.context(_rows(spark, "question_id int, question string", *ASKED[:3]), known, configs)
    return out.withColumn("config", F.replace("config", F.lit("\n"), F.lit("|")))


@query
def names_and_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, "i int, n long, c string, h string, p string", (1, 1023, "display traffic-policy statistics {name}", "IP Address", "REGEX (?P<a>x) (?P<b>y)(?P<a>z)"), (2, 1536, "show version", " PHY-Status ", ""), (3, 5 << 20, "dis ip routing-table vpn-instance {name} verbose", "Größe (MB)", "(?P<only>.)"))
    c = F.col("c")
    return rows.select("i", naming.byte_size(F.col("n")).alias("size"), naming.identifier(c).alias("identifier"), naming.generated_type(F.lit("huawei"), c).alias("cmd_type"), naming.column_name(F.col("h")).alias("column_name"), F.array_join(naming.group_names(F.col("p")), ",").alias("group_names"), naming.minute(F.make_timestamp(F.lit(2026), F.lit(3), F.lit(5), F.lit(7), F.lit(8), F.lit(9))).alias("minute"))


@query
def knowledge_groups(spark: SparkSession, d: str) -> DataFrame:
    hits = search.scored(_rows(spark, "source string", ("local",), ("wiki:a",), ("wiki:b",), (":x",)), "local")
    return hits.groupBy(naming.source_group(F.col("source")).alias("source_group")).agg(F.count("*").alias("hits"), F.max("score").alias("score"))


# Configurations (CFG).

HUAWEI = "#\nsysname a\n#\nip vpn-instance RED\n ipv4-family\n  route-distinguisher 100:1\n  vpn-target 100:1 100:2 export-extcommunity\n  vpn-target 100:1 import-extcommunity\n#\nip vpn-instance RED\n  tnl-policy T1\n#\ninterface GigabitEthernet0/0/1\n description to b\n ip address 10.0.0.1 255.255.255.252\n ospf enable 1 area 0.0.0.0\n#\ninterface LoopBack0\n ip address 1.1.1.1 32\n isis enable 7\n#\ninterface Eth-Trunk3.12\n shutdown\n#\nbgp 100\n group IN internal\n peer IN as-number 100\n peer IN connect-interface LoopBack0\n peer 2.2.2.2 group IN\n peer 3.3.3.3 as-number 300\n peer 3.3.3.3 description up stream\n #\n ipv4-family unicast\n  peer 2.2.2.2 enable\n  peer 3.3.3.3 enable\n  peer 3.3.3.3 route-policy P1 import\n #\n ipv4-family vpn-instance RED\n  peer 3.3.3.3 enable\n#\nospf 1\n#\nroute-policy P1 permit node 10\n if-match ip-prefix X\n apply cost 20\n apply local-preference 200\n#\nroute-policy P1 deny node 20\n#\nip route-static 0.0.0.0 0 10.0.0.2\nip route-static vpn-instance RED 10.9.0.0 255.255.0.0 GigabitEthernet0/0/1 10.0.0.2\n#\n"
CISCO = "vrf RED\n rd 100:5\n address-family ipv4 unicast\n  import route-target\n   100:1\n   100:2\n  !\n  export route-target\n   100:1\n  !\n !\n!\ninterface GigabitEthernet0/0/0/1\n description to b\n ipv4 address 10.0.0.2 255.255.255.252\n!\ninterface Loopback0\n ipv4 address 2.2.2.2 255.255.255.255\n shutdown\n!\nroute-policy P1\n  if community matches-any (C1, C2) and next-hop in N1 then\n    set local-preference 200\n    pass\n  elseif destination in D1 then\n    drop\n  else\n    prepend as-path 100 2\n  endif\nend-policy\n!\nroute-policy ALL\n  pass\nend-policy\n!\nrouter bgp 100\n neighbor-group IN\n  remote-as 100\n  update-source Loopback0\n  address-family vpnv4 unicast\n  !\n !\n neighbor 1.1.1.1\n  use neighbor-group IN\n !\n vrf RED\n  rd 100:1\n  import route-policy P1\n  neighbor 10.0.0.9\n   remote-as 900\n   description customer nine\n   address-family ipv4 unicast\n    route-policy P1 in\n   !\n  !\n !\n vrf BLUE\n  rd 100:2\n !\n!\n"
JUNIPER = 'system { host-name j; } # comment\ninterfaces {\n  ge-0/0/0 {\n    description "uplink #3 to core; {main}";\n    unit 0 { family inet { address 10.0.0.1/30; } }\n    unit 5 {\n      disable;\n      family inet {\n        address 10.0.5.1/24;\n      }\n    }\n  }\n  /* a note; with { */\n  ge-0/0/1 {\n    disable;\n    unit 0 {\n      family inet {\n        address 10.0.1.1/30;\n      }\n    }\n  }\n}\nrouting-options {\n  autonomous-system 65000;\n}\nprotocols {\n  bgp {\n    group IN {\n      type internal;\n      local-address 1.1.1.1;\n      family inet { unicast; }\n      family inet-vpn { unicast; }\n      export OUT;\n      neighbor 2.2.2.2 { description "to two"; }\n    }\n  }\n}\nrouting-instances {\n  RED {\n    instance-type vrf;\n    route-distinguisher 1:1;\n    vrf-import IMP;\n  }\n  OTHER { instance-type virtual-router; }\n}\npolicy-options {\n  policy-statement OUT {\n    term one {\n      from protocol direct;\n      then accept;\n    }\n    then reject;\n  }\n}\n'


def _configs(spark: SparkSession, **texts: str) -> DataFrame:
    return _rows(spark, "vendor string, text string", *texts.items())


@query
def config_interfaces(spark: SparkSession, d: str) -> DataFrame:
    flat = config.interfaces(_configs(spark, huawei=HUAWEI, cisco=CISCO), "text", "vendor", ["vendor"])
    return flat.unionByName(config.nested_interfaces(_configs(spark, juniper=JUNIPER), "text", ["vendor"]))


@query
def config_routes_and_members(spark: SparkSession, d: str) -> DataFrame:
    df = _configs(spark, huawei=HUAWEI)
    routes = df.select(F.explode(config.static_routes(F.col("text"))).alias("r")).select(F.lit("route").alias("what"), F.concat_ws(" ", "r.vrf", "r.destination", "r.mask", "r.next_hop").alias("said"))
    return routes.union(config.igp_members(df, "text", ["vendor"]).select(F.lit("igp"), F.concat_ws(" ", "protocol", "process", "interfaces")))


@query
def config_expected_commands(spark: SparkSession, d: str) -> DataFrame:
    return config.coverage(_configs(spark, huawei=HUAWEI), "text", "vendor", [])


@query
def config_coverage(spark: SparkSession, d: str) -> DataFrame:
    out = config.coverage_share(config.coverage(_configs(spark, huawei=HUAWEI), "text", "vendor", []), ["vendor"])
    return out.withColumn("percent", F.round("percent", 4))


@query
def config_peers(spark: SparkSession, d: str) -> DataFrame:
    columns = ["vendor", "local_as", "address_family", "peer_ip", "remote_as", "peer_group", "update_source", "import_policy", "export_policy"]
    text = lambda df: df.select("vendor", F.col("local_as").cast("long"), "address_family", "peer_ip", F.col("remote_as").cast("long"), *(F.coalesce(c, F.lit("")).alias(c) for c in columns[5:]))
    flat = text(config.bgp_peers(_configs(spark, huawei=HUAWEI), "text", ["vendor"]))
    return flat.union(text(routing.indented_peers(_configs(spark, cisco=CISCO), "text", ["vendor"]))).union(text(routing.nested_peers(_configs(spark, juniper=JUNIPER), "text", ["vendor"])))


@query
def config_vrfs(spark: SparkSession, d: str) -> DataFrame:
    flat = routing.vrfs(_configs(spark, huawei=HUAWEI), "text", ["vendor"]).select("vendor", "vrf_name", "rd", "import_rt", "export_rt", F.lit("").alias("import_policy"))
    own = routing.indented_vrfs(_configs(spark, cisco=CISCO), "text", ["vendor"]).select("vendor", "vrf_name", "rd", "import_rt", "export_rt", "import_policy")
    return flat.union(own).union(routing.nested_vrfs(_configs(spark, juniper=JUNIPER), "text", ["vendor"]).select("vendor", "vrf_name", "rd", F.lit(""), F.lit(""), "import_policy"))


@query
def config_policies(spark: SparkSession, d: str) -> DataFrame:
    pairs = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["type"], x["value"])), "; ").alias(c)
    flat = [f(_configs(spark, **{v: t}), "text", ["vendor"]).select("vendor", "policy", "sequence", "action", pairs("match"), pairs("apply")) for f, v, t in ((routing.policy_nodes, "huawei", HUAWEI), (routing.indented_policy_nodes, "cisco", CISCO))]
    nested = routing.nested_policy_nodes(_configs(spark, juniper=JUNIPER), "text", ["vendor"]).select("vendor", "policy", "sequence", "action", F.array_join("match", "; "), F.array_join("apply", "; "))
    return flat[0].union(flat[1]).union(nested)


# Topology, graphs, plans.


def _facts(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "devices": _rows(spark, "id string, hostname string, vendor string, router_id string", ("a", "core1", "huawei", "1.1.1.1"), ("b", "edge2", "cisco", "2.2.2.2"), ("c", "agg3", "huawei", "")),
        "interfaces": _rows(
            spark, "id string, device_id string, name string, type string, status string, ip_address string, mask string, parent_id string, description string",
            ("a1", "a", "GE1", "physical", "up", "10.0.0.1", "30", "", "to-EDGE2-uplink"), ("a2", "a", "GE2", "physical", "down", "", "", "a3", ""), ("a3", "a", "Eth-Trunk1", "lag", "up", "10.0.1.1", "255.255.255.0", "", "towards agg3x"),
            ("b1", "b", "Gi0/1", "physical", "up", "10.0.0.2", "30", "", "link core1"), ("c1", "c", "GE9", "physical", "up", "10.0.1.9", "24", "", ""), ("c2", "c", "Eth-Trunk7", "lag", "", "", "", "", "agg3 itself"),
        ),
        "neighbors": _rows(spark, "device_id string, protocol string, remote_id string, remote_address string, state string", ("a", "ospf", "2.2.2.2", "10.0.0.2", "full/DR"), ("a", "bgp", "10.0.1.9", "10.0.1.9", "established"), ("b", "ospf", "1.1.1.1", "10.0.0.1", "2way"), ("c", "bgp", "A", "", "idle")),
        "peers": _rows(spark, "device_id string, peer_ip string, peer_group string, local_as long, remote_as long", ("a", "10.0.1.9", "RR-CLIENTS", 100, 100), ("a", "10.0.0.2", "", 100, 200), ("a", "10.0.1.8", "RR-CLIENTS", 100, 100), ("b", "10.0.0.1", "TRANSIT", 200, 100)),
    }


@query
def topology_links(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark)
    return topology.links(f["interfaces"], f["devices"])


@query
def topology_aggregates(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark)["interfaces"]
    own = topology.aggregates(f).select(F.lit("lag").alias("what"), "device_id", "name", F.col("members").alias("other"))
    return own.union(topology.with_parent(f).where("parent_id <> ''").select(F.lit("parent"), "device_id", "name", "parent_name"))


@query
def topology_peer_groups(spark: SparkSession, d: str) -> DataFrame:
    return topology.peer_groups(_facts(spark)["peers"])


@query
def topology_peer_interfaces(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark)
    return topology.peer_interfaces(f["peers"], f["interfaces"])


@query
def topology_precheck(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark)
    return topology.precheck(f["devices"], f["neighbors"], f["interfaces"], f["peers"])


@query
def topology_summary(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark)
    return topology.summary(f["devices"], f["interfaces"], f["peers"], topology.links(f["interfaces"], f["devices"]))


def _objects(spark: SparkSession) -> DataFrame:
    return _rows(spark, "device_id string, kind string, name string, role string", ("a", "igp", "ospf 1", ""), ("a", "bgp", "RR-CLIENTS", "reflector"), ("a", "bgp", "ISP", "upstream"), ("a", "interface", "GE1", ""), ("a", "ldp", "GE1", ""))


@query
def plan_isolation(spark: SparkSession, d: str) -> DataFrame:
    return topology.isolation_plan(_facts(spark)["devices"].where("id <> 'c'"), _objects(spark))


@query
def plan_upgrade(spark: SparkSession, d: str) -> DataFrame:
    return topology.upgrade_plan(_facts(spark)["devices"].where("id = 'a'"), _objects(spark), "V8R22", "new.cc")


@query
def plan_cutover(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark)
    return topology.cutover_plan(_rows(spark, "device_id string, vendor string, old string, new string", ("a", "huawei", "ge1", "GE8"), ("b", "cisco", "GI0/1", "Gi0/9"), ("c", "huawei", "nope", "GE5")), topology.links(f["interfaces"], f["devices"]), f["interfaces"])


@query
def plan_vendor_isolation(spark: SparkSession, d: str) -> DataFrame:
    links = _rows(
        spark, "device_id string, vendor string, n int, local_interface string, peer_device string, peer_ip string, protocols array<string>",
        ("a", "huawei", 1, "GE1", "b", "10.0.0.2", ["ospf", "bgp"]), ("a", "huawei", 2, "GE1", "c", "", ["bgp", "ldp"]), ("h", "h3c", 1, "FGE1", "b", "10.1.0.2", ["ospf"]),
    )
    return topology.vendor_isolation_plan(links)


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    f = _facts(spark)
    return graph.build(f["devices"], f["interfaces"], f["neighbors"])


@query
def graph_of_facts(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark)[1]


@query
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.counts(*_graph(spark))


@query
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    edges = _graph(spark)[1]
    near = graph.neighbours(edges, _rows(spark, "id string", ("a",), ("b1",)), None)
    return near.union(graph.between(edges, "a1", "b1").select("src", "dst", F.lower("type")))


@query
def graph_distances_of_devices(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    return graph.distances_over(nodes, edges, _rows(spark, "origin string, node string", ("b", "b"), ("c1", "c1")), "device")


@query
def graph_dot(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    lines = sinks.dot(nodes.where("type = 'device'"), edges.where("type = 'PEER'").select("src", "dst", F.lower("type").alias("label")))
    return lines.select("part", "line")


@query
def report_script(spark: SparkSession, d: str) -> DataFrame:
    return sinks.script(_rows(spark, "category string, command string, n int", ("bgp", "display bgp peer", 2), ("system", "display version", 1), ("bgp", "display bgp routing", 3)), "category", "command", "n")


@query
def report_inventory(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark)
    return reports.inventory(f["devices"], f["interfaces"], _rows(spark, "id string", ("a",)))


@query
def report_dashboard(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark)
    return reports.dashboard(f["devices"], f["interfaces"])


@query
def report_supported_types(spark: SparkSession, d: str) -> DataFrame:
    return reports.supported_types(_rows(spark, "vendor string, kind string", *((v, kind) for v, rules in classify.PREFIXES.items() for _, kind in rules)))


@query
def report_field_compare(spark: SparkSession, d: str) -> DataFrame:
    return reports.compare_fields(_rows(spark, "vendor string, field string, description string", ("huawei", "state", "of a peer"), ("cisco", "state", "FULL and so on"), ("huawei", "area", "of a process")), ["cisco", "huawei"])


@query
def merge_touched(spark: SparkSession, d: str) -> DataFrame:
    stored = _rows(spark, "k int, v string, updated long", (1, "a", 5), (2, "b", 5))
    both = merge.insert_unique(stored, _rows(spark, "k int, v string, updated long", (3, "c", 6)), ["k"])
    return merge.touched(both, _rows(spark, "k int", (2,), (2,)), ["k"], "updated", F.lit(9).cast("long"))


@query
def command_kinds(spark: SparkSession, d: str) -> DataFrame:
    said = (("huawei", "dis ip rout"), ("juniper", "show route table mpls.0"), ("cisco", "sh ip bgp summary"), ("h3c", "dis int brief"), ("huawei", "dis bgp peer 10.0.0.1 verbose"), ("cisco", "show clock"))
    rows = _rows(spark, "vendor string, command string", *said)
    norm = commands.normalise(F.col("vendor"), F.col("command"))
    return rows.select("vendor", "command", classify.command_type(F.col("vendor"), F.col("command")).alias("cmd_type"), commands.strip_args(norm).alias("pattern"), commands.category(commands.strip_args(norm)).alias("category"))


@query
def network_masks(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, "i int, m string, n int", (1, "255.255.255.252", 30), (2, "255.0.255.0", 0), (3, "24", 24), (4, "33", 32))
    return rows.select("i", network.mask_length(F.col("m")).cast("int").alias("length"), network.dotted_mask(F.col("n")).alias("dotted"))
