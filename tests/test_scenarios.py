"""Commands that follow, and walks through steps: ends, no decision, and loops."""

from ridgeline.operators import scenarios


def test_follow_ups(spark):
    rows = spark.createDataFrame([(1, "display bgp peer", {"Peer": "10.0.0.1", "Interface": ""}), (1, "display bgp peer", {"Peer": "10.0.0.1"}), (2, "display arp", {"Peer": "x"}), (3, "display ip vpn-instance", {"VPN-Instance": "A"}), (4, "display bgp peer", None)], "k int, command string, fields map<string,string>")
    got = sorted(tuple(r) for r in scenarios.follow_ups(rows, scenarios.relations(spark), ["k"]).collect())
    assert got == [(1, "context", "display bgp peer 10.0.0.1 verbose"), (3, "context", "display bgp vpnv4 vpn-instance A peer"), (3, "context", "display ip routing-table vpn-instance A")]


def test_walks(spark):
    steps = spark.createDataFrame([("s", 1, 1, "a", "^x", 0, "ends"), ("s", 1, 2, "a", "^y", 2, None), ("s", 1, 3, "b", "^$", 2, None), ("s", 2, 1, "b", "1", 1, None), ("s", 2, 2, "b", "^$", 0, "nothing of b")], "scenario string, step int, place int, field string, pattern string, next int, conclusion string")
    facts = spark.createDataFrame([(1, "a", "xy"), (2, "a", "y"), (2, "b", "1"), (3, "a", "z"), (3, "b", "7"), (5, "a", None)], "id int, field string, value string")
    subjects = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s"), (4, "s"), (5, "s"), (6, "other")], "id int, scenario string")
    got = {r.id: (r.visited, r.conclusion) for r in scenarios.walked(subjects, facts, steps).collect()}
    assert got == {1: ([1], "ends"), 2: ([1, 2], None), 3: ([1], None), 4: ([1, 2], "nothing of b"), 5: ([1, 2], "nothing of b"), 6: ([1], None)}
