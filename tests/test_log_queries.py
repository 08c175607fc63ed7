"""Queries over logs and configurations that are written from tables: every form of text that the parsers know comes from the tables."""

from datetime import datetime

from ridgeline import log_queries


def _tables(spark, folder):
    day = lambda n: datetime(1996, 1, n, 1, 2, 3)
    lines = [(10 + i, 1, s, 7 + i, 1.0, 2.0, "N", "O", day(1 + s + i)) for s in (1, 2, 3, 4) for i in range(2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(s,) for s in (1, 2, 3, 4, 5)], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(101, "Customer#101", "M", -1.0), (102, "Customer#102", "M", 1.0)], "c_custkey long, c_name string, c_mktsegment string, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_blocks_of_every_vendor_with_category_and_time(spark, tmp_path):
    rows = log_queries.log_blocks(spark, _tables(spark, tmp_path)).collect()
    assert {r.vendor for r in rows} == {"huawei", "cisco", "h3c", "juniper"} and len(rows) == 24
    found = {(r.file, r.block_no): (r.vendor, r.command, r.command_norm, r.cmd_type, r.category, r.captured_at) for r in rows}
    assert found["log-4", 0] == ("h3c", "display interface brief", "display interface brief", "interface", "interface", "1996-01-05 01:02:03")
    assert found["log-2", 4] == ("huawei", "display current-configuration", "display current-configuration", "config", "config", "1996-01-04 01:02:03")
    assert found["log-2", 6][1:] == ("dis cur", "display current-configuration", "config", "config", None)
    assert found["log-1", 6][0] == "cisco" and found["log-3", 6][0] == "juniper" and ("log-1", 5) not in found


def test_interfaces_of_every_vendor(spark, tmp_path):
    rows = log_queries.config_interfaces(spark, _tables(spark, tmp_path)).collect()
    found = {(r.vendor, r.name): (r.type, r.ip_address, r["mask"], r.description, r.status) for r in rows}
    assert len(rows) == len(found) == 14 and {r.g for r in rows} == {1}
    assert found["huawei", "GigabitEthernet0/0/1"] == ("physical", "10.0.0.101", "255.255.255.252", "Customer#101", "down")
    assert found["cisco", "GigabitEthernet0/0/0/2"] == ("physical", "10.0.0.102", "255.255.255.252", "Customer#102", "up")
    assert found["cisco", "Loopback0"] == ("loopback", "10.255.0.1", "255.255.255.255", "", "up") and found["huawei", "LoopBack0"][2] == "32"
    assert found["juniper", "ge-0/0/1"] == ("physical", "", "", "Customer#101 #3; {main}", "down") and found["juniper", "ge-0/0/2.0"] == ("subinterface", "10.0.0.102", "30", "", "up")
    assert {k for k, v in found.items() if v[0] == "subinterface" and v[4] == "down"} == {("huawei", "Eth-Trunk1.12"), ("cisco", "Bundle-Ether1.12"), ("juniper", "ge-0/0/1.0"), ("juniper", "ge-0/0/1.5")}
