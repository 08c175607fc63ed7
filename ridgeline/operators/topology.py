"""Topology from stored facts: links between devices, groups of peers, aggregates, checks (JOIN-04..08, AGG-07, 13, 14, QRY-04, 05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.mentions import mentions
from ridgeline.functions.network import dotted_mask, mask_length, network, subnet, to_long
from ridgeline.operators import blocks


def links_by_description(interfaces: DataFrame, devices: DataFrame) -> DataFrame:
    """device_id, name, peer: interfaces whose description contains the host name of another device, whatever the case (JOIN-04).

    All host names are looked for at once in one pass over a description, so no pair of tables is
    compared row by row.
    """
    named = devices.where("hostname <> ''").select(F.lower("hostname").alias("mention"), F.col("id").alias("peer"))
    said = mentions(interfaces, ["device_id", "name"], F.col("description"), named, "mention")
    return said.join(named, "mention").where("peer <> device_id").select("device_id", "name", "peer").distinct()


def links_by_subnet(interfaces: DataFrame) -> DataFrame:
    """device_id, name, peer, peer_interface: interfaces of two devices in one subnet."""
    own = interfaces.select("device_id", "name", subnet(F.col("ip_address"), F.col("mask")).alias("subnet")).where("subnet is not null")
    other = own.select(F.col("device_id").alias("peer"), F.col("name").alias("peer_interface"), "subnet")
    return own.join(other, "subnet").where("device_id <> peer").select("device_id", "name", "peer", "peer_interface")


def links(interfaces: DataFrame, devices: DataFrame) -> DataFrame:
    """device_id, name, peer, peer_interface, sources: what both ways find, merged by interface and peer (JOIN-05)."""
    found = links_by_description(interfaces, devices).select("*", F.lit("").alias("peer_interface"), F.lit("description").alias("source"))
    found = found.unionByName(links_by_subnet(interfaces).withColumn("source", F.lit("subnet")))
    return found.groupBy("device_id", "name", "peer").agg(F.coalesce(F.min(F.nullif("peer_interface", F.lit(""))), F.lit("")).alias("peer_interface"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def with_parent(interfaces: DataFrame) -> DataFrame:
    """interfaces with parent_name, or their own name without a parent (JOIN-06)."""
    parents = interfaces.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))
    out = interfaces.join(parents, F.nullif("parent_id", F.lit("")) == F.col("_pid"), "left")
    return out.withColumn("parent_name", F.coalesce("_pname", "name")).drop("_pid", "_pname")


def aggregates(interfaces: DataFrame) -> DataFrame:
    """device_id, name, members (joined by name): aggregated interfaces, also those without members (JOIN-08)."""
    members = interfaces.where("parent_id <> ''").groupBy("parent_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("members"))
    own = interfaces.where("type = 'lag'").select("id", "device_id", "name")
    return own.join(members, own.id == members.parent_id, "left").select("device_id", "name", F.coalesce("members", F.lit("")).alias("members"))


def peer_role(name: Column, internal: Column) -> Column:
    """What a group of peers is for, by its name."""
    low = F.lower(name)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    return F.when(has("rr", "reflector"), "reflector").when(has("isp", "transit", "upstream"), "upstream").when(has("cust", "downstream"), "downstream").when(internal, "internal").otherwise("external")


def peer_groups(peers: DataFrame) -> DataFrame:
    """device_id, peer_group, kind, role, peers: a peer without a group is one itself; the kind is that of the first peer by address (AGG-07)."""
    own = peers.withColumn("peer_group", F.when(F.col("peer_group") != "", F.col("peer_group")).otherwise(F.col("peer_ip")))
    internal = F.min_by((F.col("remote_as") == F.col("local_as")) & (F.col("local_as") != 0), F.col("peer_ip"))
    out = own.groupBy("device_id", "peer_group").agg(internal.alias("_in"), F.count_distinct("peer_ip").alias("peers"))
    return out.select("device_id", "peer_group", F.when(F.col("_in"), "internal").otherwise("external").alias("kind"), peer_role(F.col("peer_group"), F.col("_in")).alias("role"), "peers")


def peer_interfaces(peers: DataFrame, interfaces: DataFrame) -> DataFrame:
    """device_id, peer_ip, name: the first interface by name whose subnet holds the peer (JOIN-07).

    Each interface's mask length is known, so a peer is looked up once for each length that its
    device uses, by equality.
    """
    own = interfaces.select("device_id", "name", to_long(F.col("ip_address")).alias("n"), mask_length(F.col("mask")).alias("len")).where("n is not null and len is not null")
    own = own.select("device_id", "name", "len", network(F.col("n"), F.col("len")).alias("net"))
    used = own.select("device_id", "len").distinct()
    asked = peers.select("device_id", "peer_ip").distinct().join(used, "device_id").withColumn("net", network(to_long(F.col("peer_ip")), F.col("len")))
    return asked.join(own, ["device_id", "len", "net"]).groupBy("device_id", "peer_ip").agg(F.min("name").alias("name"))


def precheck(devices: DataFrame, neighbors: DataFrame, interfaces: DataFrame, peers: DataFrame) -> DataFrame:
    """A row for each device: OSPF and BGP neighbours, whether all are up, interfaces up, expected peers that are missing, and whether it is safe (AGG-13, JOIN-09)."""
    state = F.lower("state")
    seen = neighbors.groupBy("device_id").agg(
        F.count_if(F.col("protocol") == "ospf").alias("ospf"), F.count_if((F.col("protocol") == "ospf") & state.startswith("full")).alias("ospf_full"),
        F.count_if(F.col("protocol") == "bgp").alias("bgp"), F.count_if((F.col("protocol") == "bgp") & (state == "established")).alias("bgp_up"),
    )
    faces = interfaces.groupBy("device_id").agg(F.count("*").alias("interfaces"), F.count_if(F.col("status") == "up").alias("interfaces_up"))
    observed = neighbors.where("protocol = 'bgp'").select("device_id", F.col("remote_id").alias("peer_ip")).distinct()
    missing = peers.select("device_id", "peer_ip").distinct().join(observed, ["device_id", "peer_ip"], "left_anti").groupBy("device_id").agg(F.count("*").alias("missing"))
    out = devices.select(F.col("id").alias("device_id"))
    for side in (seen, faces, missing):
        out = out.join(side, "device_id", "left")
    out = out.na.fill(0)
    return out.withColumn("safe", (F.col("ospf") == F.col("ospf_full")) & (F.col("bgp") == F.col("bgp_up")) & (F.col("missing") == 0))


def summary(devices: DataFrame, interfaces: DataFrame, peers: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each device with its interfaces, peers and linked devices, in one plan for all (QRY-05, AGG-14)."""
    out = devices.select(F.col("id").alias("device_id"), "hostname")
    for side, name in ((interfaces.groupBy("device_id").agg(F.count("*").alias("interfaces")), "interfaces"), (peers.groupBy("device_id").agg(F.count_distinct("peer_ip").alias("peers")), "peers"), (found.groupBy("device_id").agg(F.count_distinct("peer").alias("linked")), "linked")):
        out = out.join(side, "device_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def single_points(nodes: DataFrame, edges: DataFrame, devices: DataFrame) -> DataFrame:
    """device, single_point, affected: of each device asked about (id), whether others lose their way without it, and how many (GRA-09); blocks.impact() has which.

    nodes: id; edges: src, dst, both ways. The whole graph is taken apart once for all devices.
    """
    lost = blocks.impact(nodes, edges, devices).groupBy(F.col("gone").alias("id")).agg(F.count("*").alias("affected"))
    out = devices.select("id").distinct().join(lost, "id", "left")
    return out.select(F.col("id").alias("device"), F.col("affected").isNotNull().alias("single_point"), F.coalesce("affected", F.lit(0)).alias("affected"))


#: Steps of taking a device out of service: phase, kind of object, what is said for each (QRY-06).
ISOLATION = ((1, "device", "save configuration"), (2, "igp", "raise cost of {name}"), (3, "wait", "wait for convergence"), (4, "ldp", "disable ldp on {name}"), (5, "bgp", "shut peer group {name}"), (6, "interface", "shut interface {name}"))
RANKS = ("downstream", "external", "upstream", "internal", "reflector")


def isolation_plan(devices: DataFrame, objects: DataFrame) -> DataFrame:
    """device_id, phase, step, command: phases in order, peer groups by role, the rest by name (QRY-06, SORT-02).

    objects: device_id, kind (igp, ldp, bgp, interface), name, role. Phases without objects stay
    out, save those that are of the device itself.
    """
    steps = devices.select(F.col("id").alias("device_id")).withColumn("t", F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(k).alias("kind"), F.lit(c).alias("text")) for p, k, c in ISOLATION)))).select("device_id", "t.*")
    fixed = steps.where("kind in ('device', 'wait')").select("device_id", "phase", "text", F.lit("").alias("name"), F.lit(0).alias("rank"))
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.coalesce("role", F.lit(""))).cast("int")
    own = steps.join(objects, ["device_id", "kind"]).select("device_id", "phase", "text", "name", rank.alias("rank"))
    every = fixed.unionByName(own)
    place = F.row_number().over(Window.partitionBy("device_id", "phase").orderBy("rank", "name"))
    return every.select("device_id", "phase", place.alias("step"), F.replace("text", F.lit("{name}"), F.col("name")).alias("command"))


#: Steps of an upgrade for the device itself: collection, checks, the upgrade, its check, and what follows the recovery (QRY-06).
UPGRADE = (
    (0, "display version"), (1, "confirm that the target version is {version}"), (1, "confirm that flash: has room"), (1, "confirm that {file} is on the device"),
    (4, "start {file} and reload"), (5, "confirm that display version says {version}"), (5, "confirm that no hardware alarm is there"), (7, "display version"),
)


def upgrade_plan(devices: DataFrame, objects: DataFrame, version: str, file: str) -> DataFrame:
    """device_id, phase, step, command of eight phases: 0 collection, 1 checks, 2 protocols and 3 interfaces
    out of service, 4 the upgrade, 5 its check, 6 all that was taken out back in reverse, 7 a last check (QRY-06).
    """
    fixed = devices.select(F.col("id").alias("device_id"), F.posexplode(F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(c).alias("command")) for p, c in UPGRADE))).alias("at", "t"))
    fixed = fixed.select("device_id", "t.phase", F.struct(F.lit(0).alias("x"), F.col("at").alias("y")).alias("place"), F.replace(F.replace("t.command", F.lit("{version}"), F.lit(version)), F.lit("{file}"), F.lit(file)).alias("command"))
    out = isolation_plan(devices, objects).where("phase > 1")
    undone = F.regexp_replace(F.regexp_replace(F.regexp_replace("command", "^shut ", "undo shut "), "^disable ", "enable "), "^raise cost of ", "restore cost of ")
    place = lambda sign: F.struct((sign * F.col("phase")).alias("x"), (sign * F.col("step")).alias("y")).alias("place")
    rows = fixed.union(out.select("device_id", F.when(F.col("phase") < 6, 2).otherwise(3), place(1), "command")).union(out.select("device_id", F.lit(6), place(-1), undone))
    step = F.row_number().over(Window.partitionBy("device_id", "phase").orderBy("place"))  # the objects of one device
    return rows.select("device_id", "phase", step.alias("step"), "command")


def cutover_plan(cutovers: DataFrame, found: DataFrame, interfaces: DataFrame) -> DataFrame:
    """device_id, old, new, phase, command: what an interface has goes to another (QRY-06).

    cutovers: device_id, vendor, old, new. found: device_id, name, peer, as of links(). The old
    interface is looked up whatever the case; address, mask and description are copied; Cisco writes
    masks with dots, the others as they are.
    """
    own = interfaces.select("device_id", F.lower("name").alias("_old"), "ip_address", "mask", "description")
    peers = found.groupBy("device_id", F.lower("name").alias("_old")).agg(F.array_join(F.array_sort(F.collect_set("peer")), ",").alias("peers"))
    rows = cutovers.withColumn("_old", F.lower("old")).join(own, ["device_id", "_old"], "left").join(peers, ["device_id", "_old"], "left").na.fill("", ["ip_address", "mask", "description", "peers"])
    cisco = F.col("vendor") == "cisco"
    mask = F.when(cisco, F.coalesce(dotted_mask(mask_length(F.col("mask"))), F.col("mask"))).otherwise(F.col("mask"))
    address = F.when(F.col("ip_address") != "", F.concat(F.when(cisco, "ipv4 address ").otherwise("ip address "), "ip_address", F.lit(" "), mask))
    steps = [
        (0, F.concat(F.lit("display interface "), "old")), (1, F.concat(F.lit("confirm that "), "old", F.lit(" leads to "), F.when(F.col("peers") == "", "no known device").otherwise(F.col("peers")))), (2, F.concat(F.lit("interface "), "new")),
        (2, F.when(F.col("description") != "", F.concat(F.lit("description "), "description"))), (2, address), (3, F.concat(F.lit("display interface "), "new")), (4, F.concat(F.lit("move traffic from "), "old", F.lit(" to "), "new")), (5, F.concat(F.lit("shut interface "), "old")), (6, F.concat(F.lit("display interface "), "new")),
    ]
    each = F.filter(F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(i).alias("step"), c.alias("command")) for i, (p, c) in enumerate(steps))), lambda x: x["command"].isNotNull())
    return rows.select("device_id", "old", "new", F.explode(each).alias("t")).select("device_id", "old", "new", "t.*")


# What two vendors' devices are asked, what takes a protocol or an interface out of service, and what brings it back.
ASKED = (("", "display interface brief"), ("", "display ip routing-table statistics"), ("ospf", "display ospf peer brief"), ("bgp", "display bgp peer"), ("ldp", "display mpls ldp session"))
BASELINE = ("display current-configuration", "display lldp neighbor brief", "display version")
CHANGES = {"ospf": ("interface {interface}", "ospf cost 65535", "undo ospf cost"), "bgp": ("bgp", "peer {peer} ignore", "undo peer {peer} ignore"), "ldp": ("interface {interface}", "undo mpls ldp", "mpls ldp")}


def vendor_isolation_plan(links: DataFrame) -> DataFrame:
    """device_id, phase, step, on_device, seq, command: a device taken out of service in its vendor's words (QRY-07).

    links: device_id, vendor (huawei or h3c), n (their order), local_interface, peer_device, peer_ip,
    protocols (an array). Phases: 0 baseline of the device and of each peer, as first seen, 1 checks,
    2 protocols, 3 interfaces, each once, 4 each peer again, 5 the way back. A device's links are one row.
    """
    ls = F.array_sort(F.collect_list(F.struct("n", "local_interface", "peer_device", "peer_ip", "protocols")))
    rows = links.na.fill("", ["local_interface", "peer_ip"]).groupBy("device_id", "vendor").agg(ls.alias("l"))
    none = F.array().cast("array<string>")
    words = lambda *x: F.array(*map(F.lit, x))
    ospf = F.when(F.col("vendor") == "h3c", "display ospf peer").otherwise("display ospf peer brief")

    def asked(ls: Column) -> Column:
        has = F.array_distinct(F.flatten(F.transform(ls, lambda x: x["protocols"])))
        return F.concat(*(F.array(ospf if p == "ospf" else F.lit(c)) if not p else F.when(F.array_contains(has, p), F.array(ospf if p == "ospf" else F.lit(c))).otherwise(none) for p, c in ASKED))

    def change(link: Column, protocol: Column, way: int) -> Column:
        said = lambda c: F.replace(F.replace(F.lit(c), F.lit("{interface}"), link["local_interface"]), F.lit("{peer}"), F.coalesce(link["peer_ip"], F.lit("")))
        out = none
        for name, texts in CHANGES.items():
            fits = (protocol == name) & ((F.coalesce(link["peer_ip"], F.lit("")) != "") if name == "bgp" else F.lit(True))
            out = F.when(fits, F.array(said(texts[0]), said(texts[way]), F.lit("quit"))).otherwise(out)
        return out

    def within(commands: Column) -> Column:
        return F.concat(words("system-view"), commands, words("return"))

    def protocols(way: int) -> Column:
        return within(F.flatten(F.transform("l", lambda x: F.flatten(F.transform(x["protocols"], lambda q: change(x, q, way))))))

    def interfaces(said: str) -> Column:
        names = F.array_distinct(F.filter(F.transform("l", lambda x: x["local_interface"]), lambda n: n != ""))
        return within(F.flatten(F.transform(names, lambda n: F.array(F.concat(F.lit("interface "), n), F.lit(said), F.lit("quit")))))

    peers = F.array_distinct(F.transform("l", lambda x: x["peer_device"]))
    step = lambda phase, device, commands: F.struct(F.lit(phase).alias("phase"), device.alias("on_device"), commands.alias("commands"))
    of_peers = lambda phase: F.transform(peers, lambda q: step(phase, q, asked(F.filter("l", lambda x: x["peer_device"] == q))))
    own = lambda phase, commands: F.array(step(phase, F.col("device_id"), commands))
    steps = F.concat(
        own(0, F.concat(asked(F.col("l")), words(*BASELINE))), of_peers(0), own(1, asked(F.col("l"))), own(2, protocols(1)), own(2, F.array(ospf, F.lit("display bgp peer"))),
        own(3, interfaces("shutdown")), of_peers(4), own(5, protocols(2)), own(5, interfaces("undo shutdown")),
    )
    each = rows.select("device_id", F.posexplode(steps).alias("step", "s"))
    return each.select("device_id", "s.phase", "step", "s.on_device", F.posexplode("s.commands").alias("seq", "command"))
