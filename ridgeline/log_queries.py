"""Queries over device logs and configurations that Spark writes from the driver's tables and reads again.

A supplier is a device, its lineitems are interfaces and routes; a hundred customers are one. What the parsers find
must be what the tables say, which the SQL takes from them without any text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators import config, devices, graph, scenarios, sessions, topology
from ridgeline.queries import query
from ridgeline.session import checkpoint_dir, table

LINES_SQL = """lines AS (SELECT s_suppkey AS s, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS INTEGER) AS i,
  '10.' || l_orderkey // 65536 % 256 || '.' || l_orderkey // 256 % 256 || '.' || l_orderkey % 256 AS ip, '172.16.' || l_partkey // 256 % 256 || '.' || l_partkey % 256 AS hop, l_returnflag AS flag, l_linestatus AS state, l_linenumber AS cost, s_suppkey % 2 = 0 AS first
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """s, i, ip, hop, flag, state, cost, first: a supplier's lineitems in order."""
    part = lambda c, n: F.pmod(F.floor(F.col(c) / n), F.lit(256)).cast("string")
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    own = table(spark, d, "lineitem").withColumn("i", place - 1).join(table(spark, d, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    ip = F.concat_ws(".", F.lit("10"), part("l_orderkey", 65536), part("l_orderkey", 256), part("l_orderkey", 1))
    hop = F.concat_ws(".", F.lit("172.16"), part("l_partkey", 256), part("l_partkey", 1))
    return own.select(F.col("s_suppkey").alias("s"), "i", ip.alias("ip"), hop.alias("hop"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"), F.col("l_linenumber").alias("cost"), (F.col("s_suppkey") % 2 == 0).alias("first"))


def _joined(rows: DataFrame, key: str, order: str, *texts: tuple[str, Column]) -> DataFrame:
    """key and, for each text, its rows' lines in order."""
    held = F.array_sort(F.collect_list(F.struct(order, *(t.alias(n) for n, t in texts))))  # of one device
    return rows.groupBy(key).agg(held.alias("_h")).select(key, *(F.array_join(F.col(f"_h.{n}"), "\n").alias(n) for n, _ in texts))


def _logs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """file, content (and s, if asked for): a log of each supplier, with the prompts and tables of one of two vendors."""
    c, first = F.col, F.col("first")
    name = F.concat(F.lit("GE0/0/"), c("i"))
    proto = F.when(c("state") == "O", "up").otherwise("down")
    one = F.concat_ws(" ", name, F.when(c("flag") == "N", "up").when(c("flag") == "R", "*down").otherwise("down"), proto, F.lit("0% 0% 0 0"))
    two = F.concat_ws(" ", name, c("ip"), F.lit("YES NVRAM"), F.when(c("flag") == "N", "up").when(c("flag") == "R", "administratively down").otherwise("down"), proto)
    route = F.when(first, F.concat_ws(" ", F.concat(c("ip"), F.lit("/32")), F.lit("Static 60"), c("cost"), F.lit("RD"), c("hop"), name)).otherwise(F.concat(F.lit("O    "), c("ip"), F.lit("/32 [110/"), c("cost"), F.lit("] via "), c("hop"), F.lit(", 00:01:02, "), name))
    peer = F.when(first, F.concat_ws(" ", F.lit("0.0.0.0"), name, c("ip"), F.lit("Full"))).otherwise(F.concat_ws(" ", c("ip"), F.lit("1 FULL/DR 00:00:35"), c("hop"), name))
    text = _joined(_lines(spark, d), "s", "i", ("faces", F.when(first, one).otherwise(two)), ("routes", route), ("peers", peer))
    host = F.concat(F.lit("Sup"), c("s"))
    prompt = F.when(c("s") % 2 == 0, F.concat(F.lit("<"), host, F.lit(">"))).otherwise(F.concat(host, F.lit("#")))
    said = lambda a, b: F.when(c("s") % 2 == 0, a).otherwise(b)
    part = lambda commands, heads, body: F.concat(prompt, said(*commands), F.lit("\n"), said(*heads), F.lit("\n"), c(body), F.lit("\n"))
    content = F.concat(
        part(("display interface brief", "show ip interface brief"), ("Interface PHY Protocol InUti OutUti inErrors outErrors", "Interface IP-Address OK? Method Status Protocol"), "faces"),
        part(("display ip routing-table", "show ip route"), ("Routing Tables: Public\n Destination/Mask Proto Pre Cost Flags NextHop Interface", "Codes: C - connected, S - static, O - OSPF"), "routes"),
        part(("display ospf peer brief", "show ip ospf neighbor"), (" Area Id Interface Neighbor id State", "Neighbor ID Pri State Dead Time Address Interface"), "peers"),
        F.lit("\n"), prompt, F.lit("quit"),
    )
    return text.select(F.concat(F.lit("log-"), "s").alias("file"), content.alias("content"), *more)


VENDOR = "CASE WHEN s % 2 = 0 THEN 'huawei' ELSE 'cisco' END"


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """file, content: the logs with time stamps, a configuration, a question for help and a prompt of another kind; every fourth device is of a third vendor, which only its configuration says."""
    c = F.col
    said = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.min("l_shipdate").alias("began"), F.max("l_shipdate").alias("ended"))
    s, host = c("s"), F.concat(F.lit("Sup"), "s")
    time = lambda x: F.concat(F.date_format(x, "yyyy-MM-dd-HH-mm-ss"), F.lit(": "))
    prompt = F.when(s % 2 == 0, F.concat(F.lit("<"), host, F.lit(">"))).otherwise(F.concat(host, F.lit("#")))
    shown = F.when(s % 4 == 0, F.concat(F.lit("display current-configuration\nversion 7.1.070\n#\nsysname "), host)).when(s % 2 == 0, F.concat(F.lit("display current-configuration\n#\nsysname "), host)).otherwise(F.concat(F.lit("show running-config\nhostname "), host))
    asked = F.when(s % 2 == 0, "display ip rout ?").otherwise("show ip rout ?")
    last = F.when(s % 2 == 0, F.concat(F.lit("["), host, F.lit("]dis cur"))).when(s % 4 == 1, F.concat(F.lit("RP/0/RSP0/CPU0:"), host, F.lit("#show mpls forwarding"))).otherwise(F.concat(F.lit("admin@"), host, F.lit(">show version")))
    content = F.concat(F.lit("noise\n"), time("began"), "content", F.lit("\n"), time("ended"), prompt, shown, F.lit("\n"), prompt, asked, F.lit("\nhelp\n"), last, F.lit("\n12:00\n"))
    return _logs(spark, d, "s").join(said, "s").select("file", content.alias("content"))  # by s, as logs lie already


@query(f"""
WITH {LINES_SQL}, b AS (SELECT DISTINCT s FROM lines), t AS (SELECT l_suppkey AS s, min(l_shipdate) AS began, max(l_shipdate) AS ended FROM lineitem GROUP BY 1),
k AS (SELECT s, n, began, ended, CASE WHEN s % 2 = 0 THEN ['display interface brief', 'display ip routing-table', 'display ospf peer brief', 'quit', 'display current-configuration', '', 'dis cur'][n + 1] WHEN n = 6 THEN CASE WHEN s % 4 = 1 THEN 'show mpls forwarding' ELSE 'show version' END ELSE ['show ip interface brief', 'show ip route', 'show ip ospf neighbor', 'quit', 'show running-config'][n + 1] END AS command FROM b JOIN t USING (s), range(7) AS r(n) WHERE n <> 5)
SELECT 'log-' || s AS file, CAST(n AS INTEGER) AS block_no, 'Sup' || s AS hostname, CASE WHEN s % 4 = 0 THEN 'h3c' WHEN s % 4 = 3 AND n = 6 THEN 'juniper' ELSE {VENDOR} END AS vendor, command,
  CASE WHEN n = 6 AND s % 2 = 1 THEN CASE WHEN s % 4 = 1 THEN 'lfib' ELSE 'unknown' END ELSE ['interface', 'rib', 'neighbor', 'unknown', 'config', '', 'config'][n + 1] END AS cmd_type, CASE command WHEN 'dis cur' THEN 'display current-configuration' ELSE command END AS command_norm,
  CASE WHEN n = 6 AND s % 2 = 1 THEN CASE WHEN s % 4 = 1 THEN 'mpls' ELSE 'other' END ELSE ['interface', 'routing', 'ospf', 'other', 'config', '', 'config'][n + 1] END AS category,
  strftime(CASE n WHEN 0 THEN began WHEN 4 THEN ended END, '%Y-%m-%d %H:%M:%S') AS captured_at FROM k""")
def log_blocks(spark: SparkSession, d: str) -> DataFrame:
    return devices.ingest(_sessions(spark, d))["blocks"].select("file", "block_no", "hostname", "vendor", "command", "cmd_type", "command_norm", "category", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"))


@query(f"""
WITH {LINES_SQL}, b AS (SELECT s, count(*) AS n FROM lines GROUP BY s)
SELECT 'Sup' || s AS hostname, {VENDOR} AS vendor, CASE WHEN s % 2 = 0 THEN ['display interface brief', 'display ip routing-table', 'display ospf peer brief', 'quit'][k + 1] ELSE ['show ip interface brief', 'show ip route', 'show ip ospf neighbor', 'quit'][k + 1] END AS command,
  CAST(CASE WHEN k = 3 THEN 0 WHEN k = 1 AND s % 2 = 0 THEN n + 2 ELSE n + 1 END AS INTEGER) AS lines FROM b, range(4) AS r(k)""")
def log_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The logs stand one behind another in the files of the tasks that make them, packed by a codec whose files can be read in ranges, as they are."""
    folder = f"{checkpoint_dir(spark)}/logs-{uuid.uuid4().hex}"
    _logs(spark, d).select("content").write.text(folder, compression="bzip2")
    found = sessions.split_ranges(spark, folder)
    return found.select("hostname", "vendor", "command", F.when(F.col("output") == "", 0).otherwise(F.size(F.split("output", "\n"))).alias("lines"))


@query(f"WITH {LINES_SQL} SELECT DISTINCT 'sup' || s AS device_id, 'Sup' || s AS hostname, {VENDOR} AS vendor, CAST(4 AS INTEGER) AS commands FROM lines")
def log_device_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return devices.ingest(_logs(spark, d))["devices"].select("device_id", "hostname", "vendor", F.size("commands").alias("commands"))


@query(f"""
WITH {LINES_SQL} SELECT 'sup' || s AS device_id, i AS row_no, 'GE0/0/' || i AS name, CASE flag WHEN 'N' THEN 'up' WHEN 'R' THEN 'admin-down' ELSE 'down' END AS status, CASE WHEN state = 'O' THEN 'up' ELSE 'down' END AS protocol, CASE WHEN s % 2 = 1 THEN ip END AS ip_address FROM lines""")
def log_interfaces(spark: SparkSession, d: str) -> DataFrame:
    return devices.ingest(_logs(spark, d))["interfaces"].select("device_id", "row_no", "name", "status", "protocol", "ip_address")


@query(f"""
WITH {LINES_SQL} SELECT 'sup' || s AS device_id, i AS row_no, 'default' AS vrf, ip AS prefix, 32::BIGINT AS mask_len, CASE WHEN s % 2 = 0 THEN 'static' ELSE 'ospf' END AS protocol, CASE WHEN s % 2 = 0 THEN 60 ELSE 110 END::BIGINT AS preference, cost::BIGINT AS metric, hop AS next_hop, 'GE0/0/' || i AS outgoing_interface FROM lines""")
def log_routes(spark: SparkSession, d: str) -> DataFrame:
    return devices.ingest(_logs(spark, d))["routes"].select("device_id", "row_no", "vrf", "prefix", "mask_len", "protocol", "preference", "metric", "next_hop", "outgoing_interface")


@query(f"""
WITH {LINES_SQL} SELECT 'sup' || s AS device_id, i AS row_no, 'ospf' AS protocol, ip AS remote_id, 'full' AS state, 'GE0/0/' || i AS local_interface FROM lines""")
def log_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return devices.ingest(_logs(spark, d))["neighbors"].select("device_id", "row_no", "protocol", "remote_id", "state", "local_interface")


# Configurations of a hundred customers each.

MEMBERS_SQL = """members AS (SELECT c_custkey // 100 AS g, c_custkey % 100 AS i, c_custkey, c_name, c_mktsegment, '10.' || c_custkey // 65536 % 256 || '.' || c_custkey // 256 % 256 || '.' || c_custkey % 256 AS ip, c_acctbal < 0 AS shut FROM customer)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n: F.pmod(F.floor(F.col("c_custkey") / n), F.lit(256)).cast("string")
    ip = F.concat_ws(".", F.lit("10"), part(65536), part(256), part(1))
    return table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 100).alias("g"), (F.col("c_custkey") % 100).alias("i"), "c_custkey", "c_name", "c_mktsegment", ip.alias("ip"), (F.col("c_acctbal") < 0).alias("shut"))


def _configs(spark: SparkSession, d: str) -> DataFrame:
    """g, vendor, text: a configuration in the words of each vendor with an interface, a static route and a peer for each customer, a subinterface for each that is shut, and a loopback."""
    c, lit = F.col, F.lit
    off = lambda said: F.when(c("shut"), said).otherwise("")
    face = F.concat(lit("interface GigabitEthernet0/0/"), "i", lit("\n description "), "c_name", lit("\n ip address "), "ip", lit(" 255.255.255.252"), off("\n shutdown"), lit("\n#"), off(F.concat(lit("\ninterface Eth-Trunk"), "i", lit(".12\n shutdown\n#"))))
    route = F.concat(lit("ip route-static "), "ip", lit(" 255.255.255.255 172.16.0.1"))
    flat = F.concat(lit("interface GigabitEthernet0/0/0/"), "i", lit("\n description "), "c_name", lit("\n ipv4 address "), "ip", lit(" 255.255.255.252"), off("\n shutdown"), lit("\n!"), off(F.concat(lit("\ninterface Bundle-Ether"), "i", lit(".12\n shutdown\n!"))))
    unit = F.concat(lit(" unit 0 {\n family inet { # comment\n address "), "ip", lit("/30;\n }\n }\n"))
    tree = F.concat(lit("ge-0/0/"), "i", lit(' {\n description "'), "c_name", lit(' #3; {main}";\n'), off(" disable;\n"), unit, off(" unit 5 {\n disable;\n }\n"), lit("}"))
    text = _joined(_members(spark, d), "g", "i", ("faces", face), ("routes", route), ("flat", flat), ("tree", tree))
    host = F.concat(lit("10.255."), F.pmod(F.floor(c("g") / 256), lit(256)).cast("string"), lit("."), F.pmod("g", lit(256)).cast("string"))
    huawei = F.concat(lit("#\nsysname Cus"), "g", lit("\n#\n"), "faces", lit("\ninterface LoopBack0\n ip address "), host, lit(" 32\n#\n"), "routes", lit("\n#\n"))
    cisco = F.concat(lit("hostname Cus"), "g", lit("\n!\n"), "flat", lit("\ninterface Loopback0\n ipv4 address "), host, lit(" 255.255.255.255\n!\n"))
    juniper = F.concat(lit("system {\n host-name Cus"), "g", lit(";\n}\ninterfaces {\n"), "tree", lit("\nlo0 {\n unit 0 {\n family inet {\n address "), host, lit("/32;\n }\n }\n }\n}\n"))
    each = F.array(*(F.struct(lit(v).alias("vendor"), x.alias("text")) for v, x in (("huawei", huawei), ("cisco", cisco), ("juniper", juniper))))
    return text.select("g", F.explode(each).alias("e")).select("g", "e.*")


@query(f"""
WITH {MEMBERS_SQL}, hosts AS (SELECT DISTINCT g, '10.255.' || g // 256 % 256 || '.' || g % 256 AS ip FROM members)
SELECT g, vendor, 'GigabitEthernet0/0/' || CASE vendor WHEN 'cisco' THEN '0/' ELSE '' END || i AS name, 'physical' AS type, ip AS ip_address, '255.255.255.252' AS mask, c_name AS description, CASE WHEN shut THEN 'down' ELSE 'up' END AS status FROM members, (VALUES ('huawei'), ('cisco')) AS v(vendor)
UNION ALL SELECT g, vendor, trunk || i || '.12', 'subinterface', '', '', '', 'down' FROM members, (VALUES ('huawei', 'Eth-Trunk'), ('cisco', 'Bundle-Ether')) AS v(vendor, trunk) WHERE shut
UNION ALL SELECT g, vendor, name, 'loopback', ip, mask, '', 'up' FROM hosts, (VALUES ('huawei', 'LoopBack0', '32'), ('cisco', 'Loopback0', '255.255.255.255')) AS v(vendor, name, mask)
UNION ALL SELECT g, 'juniper', 'ge-0/0/' || i, 'physical', '', '', c_name || ' #3; {{main}}', CASE WHEN shut THEN 'down' ELSE 'up' END FROM members
UNION ALL SELECT g, 'juniper', 'ge-0/0/' || i || '.0', 'subinterface', ip, '30', '', CASE WHEN shut THEN 'down' ELSE 'up' END FROM members
UNION ALL SELECT g, 'juniper', 'ge-0/0/' || i || '.5', 'subinterface', '', '', '', 'down' FROM members WHERE shut
UNION ALL SELECT g, 'juniper', 'lo0.0', 'subinterface', ip, '32', '', 'up' FROM hosts""")
def config_interfaces(spark: SparkSession, d: str) -> DataFrame:
    texts = _configs(spark, d)
    flat = config.interfaces(texts.where("vendor <> 'juniper'"), "text", "vendor", ["g", "vendor"])
    return flat.unionByName(config.nested_interfaces(texts.where("vendor = 'juniper'"), "text", ["g", "vendor"]))


# Facts as they are stored.


def _faces(spark: SparkSession, d: str) -> DataFrame:
    """Interfaces of devices of ten customers each; two and two are in one subnet, and every third names the next device."""
    rows = _members(spark, d)
    device = F.floor((F.col("c_custkey") + 3) / 10)
    id_ = F.concat(F.lit("d"), device)
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("to HOST-"), device + 1, F.lit("-x"))).otherwise("")
    return rows.select(F.concat(id_, F.lit(":"), "c_custkey").alias("id"), id_.alias("device_id"), F.concat(F.lit("ge"), "c_custkey").alias("name"), F.when(F.col("shut"), "down").otherwise("up").alias("status"), F.col("ip").alias("ip_address"), F.lit("30").alias("mask"), said.alias("description"), F.lit("").alias("parent_id"))


def _devices(faces: DataFrame) -> DataFrame:
    return faces.select(F.col("device_id").alias("id")).distinct().select("id", F.concat(F.lit("host-"), F.substring("id", 2, 20), F.lit("-x")).alias("hostname"), F.concat(F.lit("r"), F.substring("id", 2, 20)).alias("router_id"))


FACES_SQL = f"{MEMBERS_SQL}, faces AS (SELECT c_custkey AS c, (c_custkey + 3) // 10 AS n, 'd' || (c_custkey + 3) // 10 AS device_id, 'ge' || c_custkey AS name, c_custkey // 4 AS net, shut FROM members)"


@query(f"""
WITH {FACES_SQL}, said AS (SELECT device_id, name, 'd' || (n + 1) AS peer, '' AS peer_interface, 'description' AS source FROM faces WHERE c % 3 = 0 AND n + 1 IN (SELECT n FROM faces)),
near AS (SELECT a.device_id, a.name, b.device_id AS peer, b.name AS peer_interface, 'subnet' AS source FROM faces a JOIN faces b ON a.net = b.net AND a.n <> b.n)
SELECT device_id, name, peer, min(peer_interface) FILTER (WHERE peer_interface <> '') IS NOT NULL AS by_subnet, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT * FROM said UNION ALL SELECT * FROM near) GROUP BY device_id, name, peer""")
def topology_links(spark: SparkSession, d: str) -> DataFrame:
    faces = _faces(spark, d)
    return topology.links(faces, _devices(faces)).select("device_id", "name", "peer", (F.col("peer_interface") != "").alias("by_subnet"), "sources")


@query(f"""
WITH {FACES_SQL}, pairs AS (SELECT a.device_id || ':' || a.c AS a, b.device_id || ':' || b.c AS b FROM faces a JOIN faces b ON a.net = b.net AND a.c <> b.c)
SELECT device_id AS src, device_id || ':' || c AS dst, 'HAS_INTERFACE' AS type FROM faces UNION ALL SELECT a, b, 'CONNECTS_TO' FROM pairs
UNION ALL SELECT device_id || ':' || c, '10.' || c // 65536 % 256 || '.' || c // 256 % 256 || '.' || c % 256 // 4 * 4 || '/30', 'IN_SUBNET' FROM faces
UNION ALL SELECT DISTINCT device_id, 'd' || (n + 1), 'PEER' FROM faces WHERE c % 3 = 0 AND n + 1 IN (SELECT n FROM faces)""")
def graph_built(spark: SparkSession, d: str) -> DataFrame:
    faces = _faces(spark, d)
    seen = faces.where("description <> ''").select("device_id", F.concat(F.lit("r"), F.substring("device_id", 2, 20).cast("long") + 1).alias("remote_id"), F.lit("").alias("remote_address"))
    return graph.build(_devices(faces), faces, seen)[1]


@query(f"""
WITH {FACES_SQL}, o AS (SELECT (o_custkey + 3) // 10 AS n, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_custkey IN (SELECT c FROM faces)),
e AS (SELECT n, count(*) FILTER (WHERE p <= '2-HIGH') AS ospf, count(*) FILTER (WHERE p <= '2-HIGH' AND s = 'F') AS ospf_full, count(*) FILTER (WHERE p > '2-HIGH') AS bgp, count(*) FILTER (WHERE p > '2-HIGH' AND s = 'F') AS bgp_up FROM o GROUP BY n),
f AS (SELECT n, device_id, count(*) AS interfaces, count(*) FILTER (WHERE NOT shut) AS interfaces_up FROM faces GROUP BY n, device_id),
m AS (SELECT n, count(*) AS missing FROM (SELECT DISTINCT n, c FROM faces WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c AND o_orderpriority > '2-HIGH')) GROUP BY n)
SELECT device_id, coalesce(ospf, 0) AS ospf, coalesce(ospf_full, 0) AS ospf_full, coalesce(bgp, 0) AS bgp, coalesce(bgp_up, 0) AS bgp_up, interfaces, interfaces_up, coalesce(missing, 0) AS missing,
  coalesce(ospf = ospf_full, true) AND coalesce(bgp = bgp_up, true) AND coalesce(missing, 0) = 0 AS safe FROM f LEFT JOIN e USING (n) LEFT JOIN m USING (n)""")
def precheck_devices(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for neighbours of the device of their customer, customers for the peers that are expected."""
    faces = _faces(spark, d)
    device = F.concat(F.lit("d"), F.floor((F.col("o_custkey") + 3) / 10))
    high = F.col("o_orderpriority") <= "2-HIGH"
    state = F.when(F.col("o_orderstatus") != "F", "Init").when(high, "Full/DR").otherwise("Established")
    seen = table(spark, d, "orders").select(device.alias("device_id"), F.when(high, "ospf").otherwise("bgp").alias("protocol"), F.concat(F.lit("c"), "o_custkey").alias("remote_id"), state.alias("state"))
    peers = faces.select("device_id", F.concat(F.lit("c"), F.substring("name", 3, 20)).alias("peer_ip"))
    return topology.precheck(_devices(faces), seen, faces, peers)


@query(f"""
WITH {FACES_SQL}, x AS (SELECT device_id, count(*) AS interfaces, count(DISTINCT c) AS peers FROM faces GROUP BY 1), l AS (SELECT a.device_id, count(DISTINCT b.device_id) AS linked FROM faces a JOIN faces b ON a.net = b.net AND a.n <> b.n OR a.c % 3 = 0 AND b.n = a.n + 1 GROUP BY 1)
SELECT device_id, 'host-' || substr(device_id, 2) || '-x' AS hostname, interfaces, peers, coalesce(linked, 0) AS linked FROM x LEFT JOIN l USING (device_id)""")
def topology_summary(spark: SparkSession, d: str) -> DataFrame:
    faces = _faces(spark, d)
    hosts = _devices(faces)
    peers = faces.select("device_id", F.col("name").alias("peer_ip"))
    return topology.summary(hosts, faces, peers, topology.links(faces, hosts))


@query(f"""
WITH {LINES_SQL} SELECT DISTINCT 'sup' || s AS device_id, kind, command FROM (
  SELECT s, 'reference' AS kind, 'display interface GE0/0/' || i AS command FROM lines WHERE s % 2 = 0 UNION ALL SELECT s, 'context', 'display interface GE0/0/' || i FROM lines WHERE s % 2 = 0 UNION ALL SELECT s, 'reference', 'display arp' FROM lines WHERE s % 2 = 0)""")
def follow_up_commands(spark: SparkSession, d: str) -> DataFrame:
    """What follows from the routes and interfaces that the logs show."""
    facts = devices.ingest(_logs(spark, d))
    of = lambda name, command, *fields: facts[name].select("device_id", F.lit(command).alias("command"), F.create_map(*(x for f, c in fields for x in (F.lit(f), F.col(c)))).alias("fields"))
    rows = of("routes", "display ip routing-table", ("NextHop", "next_hop"), ("Interface", "outgoing_interface")).union(of("interfaces", "display interface brief", ("Interface", "name")))
    rows = rows.where(F.substring("device_id", 4, 20).cast("long") % 2 == 0)  # the relations are of one vendor's commands
    return scenarios.follow_ups(rows, scenarios.relations(spark), ["device_id"])


@query(f"""
WITH {FACES_SQL}, f AS (SELECT n, device_id, count(*) FILTER (WHERE shut) AS down FROM faces GROUP BY n, device_id), o AS (SELECT (o_custkey + 3) // 10 AS n, count(*) AS seen FROM orders GROUP BY 1),
x AS (SELECT device_id, down, coalesce(seen, 0) AS seen FROM f LEFT JOIN o USING (n))
SELECT device_id AS id, CASE WHEN seen = 0 THEN '1' WHEN down >= 3 THEN '1,2' WHEN down = 0 THEN '1,2,3' ELSE '1,2' END AS visited, CASE WHEN seen = 0 THEN 'no peers' WHEN down >= 3 THEN 'many are down' WHEN down = 0 AND seen >= 100 THEN 'busy' END AS conclusion FROM x""")
def scenario_walks(spark: SparkSession, d: str) -> DataFrame:
    faces = _faces(spark, d)
    down = faces.groupBy("device_id").agg(F.count_if(F.col("status") == "down").alias("n")).select(F.col("device_id").alias("id"), F.lit("down").alias("field"), F.col("n").cast("string").alias("value"))
    device = F.concat(F.lit("d"), F.floor((F.col("o_custkey") + 3) / 10))
    seen = table(spark, d, "orders").groupBy(device.alias("id")).agg(F.count("*").cast("string").alias("value")).select("id", F.lit("seen").alias("field"), "value")
    steps = spark.createDataFrame(
        [("s", 1, 1, "seen", "^$", 0, "no peers"), ("s", 1, 2, "seen", ".", 2, None), ("s", 2, 1, "down", "^([3-9]|[0-9]{2,})$", 0, "many are down"), ("s", 2, 2, "down", "^0$", 3, None), ("s", 3, 1, "seen", "^[0-9]{3,}$", 0, "busy"), ("s", 3, 2, "seen", ".", 1, None)],
        "scenario string, step int, place int, field string, pattern string, next int, conclusion string",
    )
    subjects = faces.select(F.col("device_id").alias("id"), F.lit("s").alias("scenario")).distinct()
    return scenarios.walked(subjects, down.union(seen), steps).select("id", F.array_join(F.transform("visited", lambda x: x.cast("string")), ",").alias("visited"), "conclusion")
