"""Topology, plans and edit scripts on small facts."""


from ridgeline.operators import reports, topology

DEVICES = [("r1", "R1"), ("r2", "R2"), ("r3", "R3")]
FACES = [("r1:a", "r1", "a", "physical", "up", "10.0.0.1", "30", "to R2 core", ""), ("r2:a", "r2", "a", "physical", "up", "10.0.0.2", "255.255.255.252", "", "r2:t"), ("r2:t", "r2", "t", "lag", "down", "", "", "", ""), ("r3:z", "r3", "z", "physical", "up", "", "", "xR1", "")]


def test_topology(spark):
    devices = spark.createDataFrame(DEVICES, "id string, hostname string")
    faces = spark.createDataFrame(FACES, "id string, device_id string, name string, type string, status string, ip_address string, mask string, description string, parent_id string")
    peers = spark.createDataFrame([("r1", 1, "10.0.0.2", 1, "RR"), ("r1", 1, "9.9.9.9", 7, ""), ("r2", 1, "10.0.0.1", 1, "RR")], "device_id string, local_as long, peer_ip string, remote_as long, peer_group string")
    found = topology.links(faces, devices)
    assert {tuple(r) for r in found.collect()} == {("r1", "a", "r2", "a", "description,subnet"), ("r2", "a", "r1", "a", "subnet"), ("r3", "z", "r1", "", "description")}
    assert {(r.id, r.parent_name) for r in topology.with_parent(faces).collect()} == {("r1:a", "a"), ("r2:a", "t"), ("r2:t", "t"), ("r3:z", "z")}
    assert [tuple(r) for r in topology.aggregates(faces).collect()] == [("r2", "t", "a")]
    assert {tuple(r) for r in topology.peer_groups(peers).collect()} == {("r1", "RR", "internal", "reflector", 1), ("r1", "9.9.9.9", "external", "external", 1), ("r2", "RR", "internal", "reflector", 1)}
    assert {tuple(r) for r in topology.peer_interfaces(peers, faces).collect()} == {("r1", "10.0.0.2", "a"), ("r2", "10.0.0.1", "a")}
    neighbors = spark.createDataFrame([("r1", "ospf", "x", "Full"), ("r1", "bgp", "10.0.0.2", "Established"), ("r2", "bgp", "10.0.0.1", "Idle")], "device_id string, protocol string, remote_id string, state string")
    checked = {r.device_id: (r.ospf_full, r.bgp_up, r.interfaces_up, r.missing, r.safe) for r in topology.precheck(devices, neighbors, faces, peers).collect()}
    assert checked == {"r1": (1, 1, 1, 1, False), "r2": (0, 0, 1, 0, False), "r3": (0, 0, 1, 0, True)}
    assert {tuple(r) for r in topology.summary(devices, faces, peers, found).collect()} == {("r1", "R1", 1, 2, 1), ("r2", "R2", 2, 1, 1), ("r3", "R3", 1, 0, 1)}
    objects = spark.createDataFrame([("r1", "bgp", "RR", "reflector"), ("r1", "bgp", "CUST", "downstream"), ("r1", "interface", "a", None)], "device_id string, kind string, name string, role string")
    plan = [(r.phase, r.step, r.command) for r in topology.isolation_plan(devices, objects).where("device_id = 'r1'").orderBy("phase", "step").collect()]
    assert plan == [(1, 1, "save configuration"), (3, 1, "wait for convergence"), (5, 1, "shut peer group CUST"), (5, 2, "shut peer group RR"), (6, 1, "shut interface a")]


def test_edit_scripts(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd", "a\nc\nx\nd"), (2, None, "q")], "k int, o string, n string")
    rows = reports.sequence_difference(df, ["k"], "o", "n").orderBy("k", "pos").collect()
    for k, o, n in (tuple(r) for r in df.collect()):
        own = [r for r in rows if r.k == k]
        assert [r.line for r in own if r.sign != "+"] == (o or "").split("\n") and [r.line for r in own if r.sign != "-"] == n.split("\n")
    assert [r.sign for r in rows if r.k == 1] == [" ", "-", " ", "+", " "]
