"""Commands, sessions, typed outputs, merges, graphs, search and streams on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import classify, commands, network
from ridgeline.operators import blocks, graph, merge, outputs, reports, search, sessions
from ridgeline.sources.tables import NotFound, point, scan


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_commands(spark):
    said = [("huawei", "dis  link-agg ver"), ("cisco", "sh int bri"), ("cisco", "show bgp nei 192.0.2.1"), ("huawei", "display bgp vpnv4 vpn-instance A peer 10.0.0.1 verbose"), ("huawei", "display interface GigabitEthernet0/0/1 brief"), ("h3c", "dis ospf 100 peer brief"), ("juniper", "show route table inet.0 exact 10.0.0.0/8"), ("cisco", "quit"), ("huawei", "display area all 7")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(said)], "i int, vendor string, c string")
    norm = commands.normalise(F.col("vendor"), F.col("c"))
    got = [tuple(r)[1:] for r in df.select("i", commands.strip_args(norm), commands.is_control(F.col("vendor"), F.col("c"))).orderBy("i").collect()]
    assert got == [
        ("display link-aggregation verbose", False), ("show interface brief", False), ("show bgp neighbor {ip}", False), ("display bgp vpnv4 vpn-instance {name} peer {ip} verbose", False), ("display interface {interface} brief", False),
        ("display ospf {id} peer brief", False), ("show route table {name} exact {ip}", False), ("quit", True), ("display area all {id}", False),
    ]
    help_text = "  all       Show all\n  brief     Show brief\n  detail    Show detail"
    assert column(spark, [help_text, "a\n<cr>", "10.0.0.1   Up\nx   Y\nz   W", ""], commands.is_help) == [True, True, False, False]
    assert column(spark, ["x\n   ^", "% bad", "Error: no", "fine %"], commands.is_error) == [True, True, True, False]
    assert column(spark, ["display mpls ldp", "show version"], commands.category) == ["mpls", "other"]


def test_classification(spark):
    df = spark.createDataFrame([(0, "huawei", "dis ip rout"), (1, "juniper", "show route table mpls.0"), (2, "cisco", "show clock"), (3, "juniper", "show configuration | display set")], "i int, v string, c string")
    kinds = lambda **o: [r.k for r in df.select("i", classify.command_type(F.col("v"), F.col("c"), **o).alias("k")).orderBy("i").collect()]
    assert kinds() == ["rib", "lfib", "unknown", "config_set"] and kinds(compat=True)[1] == "rib"
    pairs = spark.createDataFrame([("show_x", "*"), ("show_x", "show*"), ("show_x", "show_x"), ("show_x", "sh")], "n string, r string")
    assert [r[0] for r in pairs.select(classify.tool_allowed(F.col("n"), F.col("r"))).collect()] == [True, True, True, False]


def test_networks(spark):
    assert column(spark, ["255.255.255.252", "30", "255.0.255.0", "33", "x"], network.mask_length) == [30, 30, None, None, None]
    rows = spark.createDataFrame([("10.0.0.5", "30"), ("10.0.0.256", "30"), ("192.168.7.9", "255.255.0.0"), ("1.2.3.4", "0")], "ip string, m string")
    assert [r[0] for r in rows.select(network.subnet(F.col("ip"), F.col("m"))).collect()] == ["10.0.0.4/30", None, "192.168.0.0/16", "0.0.0.0/0"]
    assert column(spark, [30, 0, 32], network.dotted_mask, "int") == ["255.255.255.252", "0.0.0.0", "255.255.255.255"]


LOG = "noise\n2026-03-21-13-11-26: <core-1>display version\nV8\n<core-1>display ip routing-table\nDest\r\n\nRP/0/RSP0/CPU0:edge#show interfaces\nup\nuser@jun>show route\nr1\n<cr>not a prompt\n[core-1]dis cur\nversion 7.1\n#\n"


def test_sessions(spark):
    df = spark.createDataFrame([(1, LOG), (2, ""), (3, None)], "f int, raw string")
    got = [(r.block_no, r.hostname, r.vendor, r.command, r.output, r.captured_at) for r in sessions.split_log(df, "raw", ["f"]).orderBy("f", "block_no").collect()]
    assert got == [
        (0, "core-1", "huawei", "display version", "V8", dt.datetime(2026, 3, 21, 13, 11, 26)), (1, "core-1", "huawei", "display ip routing-table", "Dest", None), (2, "edge", "cisco", "show interfaces", "up", None),
        (3, "jun", "juniper", "show route", "r1\n<cr>not a prompt", None), (4, "core-1", "huawei", "dis cur", "version 7.1\n#", None),
    ]
    blocks = sessions.reclassified(sessions.split_log(df, "raw", ["f"]))
    assert {r.vendor for r in blocks.where("hostname = 'core-1'").collect()} == {"h3c"}
    kinds = sessions.classified(blocks).orderBy("block_no").collect()
    assert [r.cmd_type for r in kinds] == ["unknown", "rib", "interface", "rib", "config"]
    raw = spark.createDataFrame([("#\n sysname R1\n version 7.1\n",), ("nothing",)], "t string").select(sessions.raw_config(F.col("t")).alias("c")).collect()
    assert (raw[0].c.hostname, raw[0].c.vendor, raw[1].c) == ("R1", "h3c", None)


def test_typed_outputs(spark):
    one = lambda f, text: [tuple(r) for r in column(spark, [text], f)[0]]
    routes = "Routing Tables: Public\nDestination/Mask Proto Pre Cost Flags NextHop Interface\n10.0.0.0/8 Static 60 0 RD 10.1.1.1 GE0/0/1\n\nRouting Tables: VPN_A\n20.0.0.0/16 OSPF 10 x RD 10.2.2.2 GE0/0/2\n"
    assert one(outputs.huawei_routes, routes) == [("default", "10.0.0.0", 8, "static", 60, 0, "10.1.1.1", "GE0/0/1"), ("VPN_A", "20.0.0.0", 16, "ospf", 10, 0, "10.2.2.2", "GE0/0/2")]
    brief = "Interface    IP-Address  OK? Method Status   Protocol\nGi0/0 10.0.0.1 YES NVRAM up up\nGi0/1 unassigned YES NVRAM administratively down down\n"
    assert one(outputs.cisco_interfaces, brief) == [("Gi0/0", "10.0.0.1", "up", "up"), ("Gi0/1", "", "admin-down", "down")]
    assert one(outputs.cisco_routes, "O 10.1.0.0/16 [110/20] via 10.0.0.2, 00:01:02, Gi0/0\nC 10.0.0.0/30 is directly connected, Gi0/1") == [("10.1.0.0", 16, "ospf", 110, 20, "10.0.0.2", "Gi0/0"), ("10.0.0.0", 30, "connected", 0, 0, "", "Gi0/1")]
    assert one(outputs.juniper_routes, "10.0.0.0/8 *[OSPF/10] 1d\n  > to 1.1.1.1 via ge-0/0/0.0\n    to 2.2.2.2 via ge-0/0/1.0\n20.0.0.0/8 *[Static/5] 2d\n  > to 3.3.3.3 via ge-0/0/2.0") == [("default", "10.0.0.0", 8, "ospf", 10, 0, "2.2.2.2", "ge-0/0/1.0"), ("default", "20.0.0.0", 8, "static", 5, 0, "3.3.3.3", "ge-0/0/2.0")]
    assert one(outputs.juniper_interfaces, "Interface Admin Link Proto Local\nge-0/0/0 up down\nge-0/0/0.0 up up inet 10.0.0.1/30") == [("ge-0/0/0", "down", "", ""), ("ge-0/0/0.0", "up", "10.0.0.1", "30")]
    assert one(outputs.huawei_labels, "FEC In/Out IF Vrf\n1.1.1.1/32 NULL/1024 -/GE1\n2.2.2.2/32 3/NULL -/-\n3.3.3.3/32 1025/1026 GE1/GE2") == [("1.1.1.1/32", 0, "1024", "push", "GE1"), ("2.2.2.2/32", 3, "NULL", "pop", "-"), ("3.3.3.3/32", 1025, "1026", "swap", "GE2")]


def test_merges(spark):
    t = [dt.datetime(2026, 1, d) for d in range(1, 5)]
    stored = spark.createDataFrame([("a", "old", t[1], 1), ("b", "old", t[2], 2), ("c", "old", t[1], 3)], "id string, v string, at timestamp, seq int")
    batch = spark.createDataFrame([("a", "new", t[2], 4), ("b", "late", t[0], 5), ("c", "same", t[1], 6), ("d", "x", t[0], 7)], stored.schema)
    assert {r.id: r.v for r in merge.newer_wins(stored, batch, ["id"], "at", "seq").collect()} == {"a": "new", "b": "old", "c": "same", "d": "x"}
    device = spark.createDataFrame([("r", "m1", "", 1), ("r", "", "v2", 2), ("r", "", "", 3)], "id string, model string, os string, seq int")
    assert [tuple(r) for r in merge.keep_filled(device, ["id"], F.col("seq"), ["model", "os"]).collect()] == [("r", "m1", "v2", 3)]
    texts = spark.createDataFrame([("d", "A", 1), ("d", "B", 2), ("d", "A", 3)], "id string, t string, n int")
    assert sorted((r.n, r.changed) for r in merge.changed_texts(texts, "id", "t", "n").collect()) == [(1, False), (2, True)]
    assert merge.newest(spark.range(205), 200, "id").agg(F.min("id")).first()[0] == 5
    with pytest.raises(NotFound):
        point(stored, "id", "zz")
    assert scan(stored, {"id": None}, {"v": "OL"}, ["-id"], 1, 1).first().id == "b"


def test_graphs(spark):
    both = lambda pairs: [(a, b) for x, y in pairs for a, b in ((x, y), (y, x))]
    edges = spark.createDataFrame(both([("a", "b"), ("b", "c"), ("c", "d"), ("b", "e"), ("e", "d")]), "src string, dst string")
    assert graph.shortest_path(edges, "a", "d") == ["a", "b", "c", "d"] and graph.shortest_path(edges, "a", "z") == [] and graph.shortest_path(edges, "q", "q") == ["q"]
    start = spark.createDataFrame([("a",)], "node string")
    paths = {tuple(r.path) for r in graph.simple_paths(edges, start, 5).collect()}
    assert ("a", "b", "c", "d") in paths and ("a", "b", "e", "d") in paths and all(len(set(p)) == len(p) <= 5 for p in paths)
    star = spark.createDataFrame(both([("b", "a"), ("b", "c"), ("b", "d")]), "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert {(r.id, r.cut_off) for r in blocks.cut_points(nodes, star).collect()} == {("b", 2)}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert {r.node for r in graph.on_cycles(loop).collect()} == {"a", "b", "c"}
    devices = spark.createDataFrame([("r1", "1.1.1.1"), ("R2", "2.2.2.2")], "id string, router_id string")
    faces = spark.createDataFrame([("r1:g", "r1", "10.0.0.1", "30", ""), ("R2:g", "R2", "10.0.0.2", "255.255.255.252", "R2:t"), ("R2:t", "R2", "", "", "")], "id string, device_id string, ip_address string, mask string, parent_id string")
    peers = spark.createDataFrame([("r1", "2.2.2.2", ""), ("R2", "r1", "9.9.9.9")], "device_id string, remote_id string, remote_address string")
    found = {(r.src, r.dst, r.type) for r in graph.build(devices, faces, peers)[1].collect()}
    assert {("r1", "R2", "PEER"), ("R2", "r1", "PEER"), ("r1:g", "R2:g", "CONNECTS_TO"), ("R2:g", "r1:g", "CONNECTS_TO"), ("R2:g", "R2:t", "MEMBER_OF"), ("r1:g", "10.0.0.0/30", "IN_SUBNET")} <= found and len(found) == 10


def test_search(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick quick fox"), (3, "lazy dog")], "id int, t string")
    assert [r.id for r in search.bm25(docs, "id", "t", ["quick", "fox"]).orderBy(F.desc("score")).collect()] == [2, 1]
    test = lambda q: [r.id for r in docs.where(search.query_test(F.col("t"), q)).orderBy("id").collect()]
    assert (test("quick fox"), test('"brown fox"'), test("la* OR brown"), test("quick NOT brown")) == ([1, 2], [1], [1, 3], [2])
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0])], "id int, v array<float>")
    assert [r.id for r in search.top_k(v, "id", "v", [1.0, 0.0], 3).collect()] == [1, 4]
    assert column(spark, ["# t\n## one " + "x" * 50 + "\n## two\n"], search.chunks) == [["one " + "x" * 50]]
    pieces = column(spark, ["a" * 700 + "\n" + "b" * 700], search.greedy_chunks)[0]
    assert pieces == ["a" * 700, "b" * 700]


def test_reports(spark):
    turns = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((10, 50, 50, 20, 20, 5))], "c int, t int, m string")
    assert [r.t for r in reports.within_budget(turns, "c", "t", "m", 60).orderBy("t").collect()] == [0, 3, 4, 5]
    assert [r.t for r in reports.within_budget(turns, "c", "t", "m", 1).orderBy("t").collect()] == [0, 4, 5]


def test_stream_equals_batch(spark, tmp_path):
    from ridgeline.streaming import ingest

    log = LOG.lstrip("noise\n")
    cuts = [0, 20, 61, 62, 120, len(log)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        (tmp_path / f"r.log.{a}").write_text(log[a:b])
    pieces = ingest.logs(spark, str(tmp_path), 1)
    stream = ingest.blocks(pieces).writeStream.format("memory").queryName("blocks_seen").option("checkpointLocation", str(tmp_path / "_c")).trigger(availableNow=True).start()
    assert stream.awaitTermination(120)
    got = [(r.hostname, r.command, r.output) for r in spark.table("blocks_seen").orderBy("seq", "block_no").collect()]
    whole = sessions.split_log(spark.createDataFrame([(log,)], "t string"), "t", [], complete_only=True)
    assert got == [(r.hostname, r.command, r.output) for r in whole.orderBy("block_no").collect()]


def test_pieces_in_any_order_and_rotated_files():
    import random

    from ridgeline.streaming.ingest import Log

    text = (LOG.lstrip("noise\n") + "<core-2>display clock ü\n12:00\n<core-2>q x\n").encode()
    whole = Log()
    whole.add(0, text)
    want = whole.complete()
    rng = random.Random(1)
    for _ in range(50):
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(6))})
        pieces = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]
        rng.shuffle(pieces)
        log, got = Log(), []
        for offset, data in pieces:
            log.add(offset, data)
            log = Log(*log.state())
            got.append(log.complete())
        assert "\n".join(x for x in got if x) == want and log.reached == len(text) and not log.waiting
    log = Log()
    log.add(0, b"<a-host>one\n1\n<a-host>two\n")
    assert log.complete() == "<a-host>one\n1"
    log.add(0, b"<b-host>one\n1\n<b-host>two\nand more than before\n<b-host>three\n")  # rotated, and longer
    assert log.complete() == "<b-host>one\n1\n<b-host>two\nand more than before"
    log.add(0, b"<b-host>one\n1\n<b-host>two\nand more than before\n<b-host>three\n3\n<b-host>four\n")  # the same file, grown
    assert log.complete() == "<b-host>three\n3"


def test_upserts_go_on_from_what_is_stored(spark, tmp_path):
    from ridgeline.streaming import ingest

    target = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string, at long, s long")
    ingest.upserting(target, ["k"], "at", "s", 4)(rows((1, "a", 1, 1), (2, "b", 1, 2), (1, "c", 2, 3)), 0)
    ingest.upserting(target, ["k"], "at", "s", 4)(rows((1, "old", 0, 1), (3, "d", 1, 2)), 0)  # another checkpoint
    fold = ingest.upserting(target, ["k"], "at", "s", 4)
    fold(rows((2, "e", 5, 1)), 1)
    fold(rows((2, "e", 5, 1)), 1)  # run again
    fold(rows().limit(0), 2)
    assert sorted((r.k, r.v) for r in ingest.stored(spark, target).collect()) == [(1, "c"), (2, "e"), (3, "d")]


def test_index_grows(spark):
    rows = [(i, f"alpha beta {'gamma ' * (i % 4)}x{i}") for i in range(20)] + [(20, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    grown = search.with_documents(search.index(df.where("k < 9"), "k", "t"), df.where("k >= 9"), "k", "t")
    want = {r.k: round(r.score, 9) for r in search.bm25(df, "k", "t", ["gamma", "Beta"]).collect()}
    assert {r.k: round(r.score, 9) for r in search.search_index(grown, "k", ["gamma", "Beta"]).collect()} == want and len(want) == 15


def test_cycles_against_reachability(spark):
    import random

    rng = random.Random(3)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(17)} | {(20, 20), (21, 22)}
    reach = dict.fromkeys(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - set(reach)
        if not more:
            break
        reach |= dict.fromkeys(more)
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {r.node for r in graph.on_cycles(df).collect()} == {a for a, b in reach if a == b}
    assert graph.on_cycles(df.limit(0)).count() == 0


def test_running_values_of_hot_keys(spark, monkeypatch):
    import random

    from ridgeline.operators import running

    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 6), rng.randrange(40), i, rng.choice([None, rng.randrange(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, i int, v int").repartition(4)
    plain = sorted(map(tuple, sessions.carried(sessions.sessions(df, ["k"], ["t", "i"], F.coalesce(F.col("v") > 6, F.lit(False))), ["k"], ["t", "i"], F.col("v"), "last").collect()), key=str)
    monkeypatch.setattr(running, "HOT", 30)
    monkeypatch.setattr(running, "PARTS", 8)
    split = sessions.carried(sessions.sessions(df, ["k"], ["t", "i"], F.coalesce(F.col("v") > 6, F.lit(False))), ["k"], ["t", "i"], F.col("v"), "last")
    assert split.columns == [*df.columns, "session_no", "last"]
    assert sorted(map(tuple, split.collect()), key=str) == plain


def test_edit_scripts_are_the_shortest():
    import random

    def common(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        script = reports.shortest_script(a, b)
        assert [x for s, x in script if s != "+"] == a and [x for s, x in script if s != "-"] == b
        assert sum(s == " " for s, _ in script) == common(a, b)
