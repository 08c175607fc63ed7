"""Configuration texts to relations."""

from pyspark.sql import functions as F

from ridgeline.operators import config
from ridgeline.sources import sinks

HUAWEI = """sysname R1
#
interface GE0/0/1
 description to R2
 ip address 10.0.0.1 255.255.255.252
 ospf enable 1
#
interface LoopBack0
 ip address 1.1.1.1 32
 shutdown
#
bgp 65001
 group RR internal
 peer RR as-number 65001
 peer RR connect-interface LoopBack0
 peer 2.2.2.2 group RR
 peer 3.3.3.3 as-number 65003
 ipv4-family unicast
  peer 2.2.2.2 enable
  peer 3.3.3.3 enable
 ipv4-family vpn-instance A
  peer 3.3.3.3 enable
#
ip vpn-instance A
#
ip route-static vpn-instance A 0.0.0.0 0 10.0.0.2
ip route-static 10.9.0.0 255.255.0.0 GE0/0/1 10.0.0.6
#"""
JUNIPER = """interfaces {
    ge-0/0/0 {
        description "to core";
        disable;
        unit 0 {
            family inet { # comment
                address 10.0.0.1/30;
            }
        }
    }
    lo0 {
        unit 0 {
            family inet {
                address 1.1.1.1/32;
            }
        }
    }
}"""


def test_configurations(spark):
    df = spark.createDataFrame([("r1", "huawei", HUAWEI), ("c1", "cisco", "!\ninterface Gi0/0\n ip address 10.0.0.2 255.255.255.252\ninterface Port-channel1\n shutdown\n!\n"), ("e", "huawei", None)], "id string, vendor string, text string")
    got = {(r.id, r.name): (r.type, r.ip_address, r["mask"], r.description, r.status) for r in config.interfaces(df, "text", "vendor", ["id"]).collect()}
    assert got == {("r1", "GE0/0/1"): ("physical", "10.0.0.1", "255.255.255.252", "to R2", "up"), ("r1", "LoopBack0"): ("loopback", "1.1.1.1", "32", "", "down"), ("c1", "Gi0/0"): ("physical", "10.0.0.2", "255.255.255.252", "", "up"), ("c1", "Port-channel1"): ("lag", "", "", "", "down")}
    peers = {(r.peer_ip, r.address_family, r.vrf): (r.local_as, r.peer_group, r.remote_as, r.update_source) for r in config.bgp_peers(df, "text", ["id"]).collect()}
    assert peers == {("2.2.2.2", "ipv4-unicast", ""): (65001, "RR", "65001", "LoopBack0"), ("3.3.3.3", "ipv4-unicast", ""): (65001, "", "65003", None), ("3.3.3.3", "ipv4-unicast", "A"): (65001, "", "65003", None)}
    routes = df.where("id = 'r1'").select(config.static_routes(F.col("text")).alias("r")).first().r
    assert [tuple(r) for r in routes] == [("A", "0.0.0.0", "0.0.0.0", "10.0.0.2"), ("", "10.9.0.0", "255.255.0.0", "10.0.0.6")]
    assert [tuple(r) for r in config.igp_members(df, "text", ["id"]).collect()] == [("r1", "ospf", "1", "GE0/0/1")]
    wanted = {r.command for r in config.expected_commands(df.where("id = 'r1'"), "text", ["id"]).collect()}
    assert {"display bgp peer", "display ip routing-table vpn-instance A", "display version"} <= wanted and "display isis peer" not in wanted


def test_nested(spark):
    df = spark.createDataFrame([("j", JUNIPER)], "id string, text string")
    got = {r.name: (r.type, r.ip_address, r["mask"], r.status) for r in config.nested_interfaces(df, "text", ["id"]).collect()}
    assert got["ge-0/0/0.0"] == ("subinterface", "10.0.0.1", "30", "down") and got["lo0.0"][1:] == ("1.1.1.1", "32", "up")


def test_exports(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b", "a", "ospf"), ("a", "b", "bgp")], "src string, dst string, label string")
    assert [r.line for r in sinks.dot(nodes, edges).collect()] == ["graph topology {", '  "a";', '  "b";', '  "a" -- "b" [label="bgp"];', "}"]
    sinks.export({"nodes": nodes}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/nodes").count() == 2 and sinks.as_json(nodes).count() == 2
    cmds = spark.createDataFrame([(1, "b", "x"), (2, "a", "y"), (3, "b", "z")], "n int, c string, d string")
    assert [r.text for r in sinks.script(cmds, "c", "d", "n").orderBy("place").collect()] == ["# b\nx\nz", "# a\ny"]
