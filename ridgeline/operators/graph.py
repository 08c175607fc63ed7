"""Typed property graphs as tables of nodes and edges, and walks over them.

Walks go level by level: a frontier is joined to the edges, and what is new goes on. Each level is
written to the checkpoint folder, so plans stay short and lost executors cost a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.network import subnet
from ridgeline.session import cut, written


def links_by_subnet(interfaces: DataFrame, key: str, ip: str, mask: str) -> DataFrame:
    """a, b, subnet: pairs of interfaces of one subnet, a < b (JOIN-02)."""
    own = interfaces.select(F.col(key).alias("a"), subnet(F.col(ip), F.col(mask)).alias("subnet")).where("subnet is not null")
    return own.join(own.select(F.col("a").alias("b"), "subnet"), "subnet").where("a < b").select("a", "b", "subnet")


def build(devices: DataFrame, interfaces: DataFrame, neighbors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type) and edges (src, dst, type) of the stored facts (GRA-01).

    devices: id, router_id. interfaces: id, device_id, ip_address, mask, parent_id. neighbors:
    device_id, remote_id, remote_address, those of each device's latest snapshot.
    """
    tied = interfaces.withColumn("subnet", subnet(F.col("ip_address"), F.col("mask")))
    pairs = links_by_subnet(interfaces, "id", "ip_address", "mask")
    ids = devices.groupBy("router_id").agg(F.min("id").alias("peer")).where("router_id <> ''")
    named = devices.select(F.lower("id").alias("name"), F.col("id").alias("peer"))
    found = neighbors.select("device_id", "remote_id", "remote_address").distinct()
    for i, (table, on, value) in enumerate(((ids, "router_id", "remote_id"), (named, "name", "remote_id"), (ids, "router_id", "remote_address"), (named, "name", "remote_address"))):
        side = table.select(F.col(on).alias("_on"), F.col("peer").alias(f"p{i}"))
        key = F.lower(F.col(value)) if on == "name" else F.col(value)
        found = found.join(side, key == F.col("_on"), "left").drop("_on")
    peers = found.withColumn("peer", F.coalesce("p0", "p1", "p2", "p3")).where("peer is not null and peer <> device_id").select("device_id", "peer").distinct()
    edges = [
        interfaces.select(F.col("device_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_INTERFACE").alias("type")),
        interfaces.where("parent_id <> ''").select("id", "parent_id", F.lit("MEMBER_OF")),
        tied.where("subnet is not null").select("id", "subnet", F.lit("IN_SUBNET")),
        pairs.select("a", "b", F.lit("CONNECTS_TO")),
        pairs.select("b", "a", F.lit("CONNECTS_TO")),
        peers.select("device_id", "peer", F.lit("PEER")),
    ]
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.union(e)
    nodes = devices.select("id", F.lit("device").alias("type")).union(interfaces.select("id", F.lit("interface"))).union(tied.where("subnet is not null").select("subnet", F.lit("subnet")).distinct())
    return nodes, all_edges


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair of ends once, the lesser first (SNK-02)."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def neighbours(edges: DataFrame, ids: DataFrame, kind: str | None = None) -> DataFrame:
    """id, neighbour, type: what the edges of ids (id) lead to, of one type or all (GRA-02)."""
    own = edges.where(F.col("type") == kind) if kind else edges
    return own.join(ids.select("id"), own.src == F.col("id"), "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "type").distinct()


def between(edges: DataFrame, a, b) -> DataFrame:
    """Edges from a to b (GRA-02)."""
    return edges.where((F.col("src") == F.lit(a)) & (F.col("dst") == F.lit(b)))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (node or edge), type, n (GRA-02)."""
    return nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "type", "n").union(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge"), "type", "n"))


def distances_over(nodes: DataFrame, edges: DataFrame, start: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """distances() over nodes of one type alone; a start may be of any type (GRA-04)."""
    allowed = nodes.where(F.col("type") == kind).select("id")
    return distances(edges.join(allowed, edges.dst == allowed.id, "left_semi"), start, most)


def distances(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """origin, node, hops: the fewest edges (src, dst) from each origin to each node it reaches, in `most` hops if that is given (GRA-03). start: origin, node."""
    out = edges.select("src", "dst").distinct()
    seen = cut(start.select("origin", "node", F.lit(0).alias("hops")).distinct())
    frontier, hop = seen, 0
    while most is None or hop < most:
        hop += 1
        step = frontier.join(out, frontier.node == out.src).select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["origin", "node"], "left_anti").withColumn("hops", F.lit(hop)).select("origin", "node", "hops"))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen


def _followed(ends: DataFrame, steps: DataFrame, side: str) -> DataFrame:
    """a, b, nodes: from a pair's meeting node (a, b, node) the nodes that `steps` (the pair's `side`, node, to) lead to, one after another; to is null at an end."""
    left = written(ends.select("a", "b", "node", F.array().cast(f"array<{ends.schema['node'].dataType.simpleString()}>").alias("nodes")))
    done = None
    while not left.isEmpty():
        step = written(left.join(steps, [side, "node"]))
        over = step.where("to is null").select("a", "b", "nodes")
        done = over if done is None else done.union(over)
        nodes = F.concat(F.array("to"), "nodes") if side == "a" else F.concat("nodes", F.array("to"))
        left = step.where("to is not null").select("a", "b", F.col("to").alias("node"), nodes.alias("nodes"))
    return ends.select("a", "b", "node").join(done, ["a", "b"]) if done is not None else ends.select("a", "b", "node", F.array("node").alias("nodes"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """a, b, path: for each pair (a, b) the nodes of a shortest path, null if there is none, or none of `most` edges if that is given; [a] if a is b (GRA-03).

    Each pair is searched from both ends at once, a level on one side and then one on the other, until the
    sides meet or one has nothing left; all pairs go together, and an end that many pairs share is searched
    from once. Of equal paths that over the least meeting node is taken, and from there the least node at each step.
    """
    out = written(edges.select("src", "dst").distinct())
    pairs = written(pairs.select("a", "b").distinct())
    sides = {side: written(pairs.select(side, F.col(side).alias("node"), F.lit(None).cast(pairs.schema[side].dataType).alias("to")).distinct()) for side in ("a", "b")}
    fronts, met, left = dict(sides), pairs.where("a = b").select("a", "b", F.col("a").alias("node")), pairs.where("a <> b")
    hops, side, other = 0, "a", "b"
    while (most is None or hops < most) and not left.isEmpty():
        ways = out if side == "a" else out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        own = fronts[side].join(left, side, "left_semi")
        step = own.join(ways, own.node == ways.src).groupBy(side, F.col("dst").alias("_new")).agg(F.min("src").alias("to")).withColumnRenamed("_new", "node")
        fronts[side] = written(step.join(sides[side], [side, "node"], "left_anti").select(side, "node", "to"))
        sides[side] = written(sides[side].union(fronts[side]))
        # Pairs that are left have not met before, so they meet at a new node.
        new = fronts[side].select(side, "node")
        hit = written(left.join(new, side).join(sides[other].select(other, "node"), [other, "node"]).groupBy("a", "b").agg(F.min("node").alias("node")))
        met = met.union(hit)
        left = written(left.join(hit, ["a", "b"], "left_anti").join(new, side, "left_semi"))
        hops, side, other = hops + 1, other, side
    met = written(met)
    before, after = _followed(met, sides["a"], "a"), _followed(met, sides["b"], "b")
    whole = before.withColumnRenamed("nodes", "x").join(after.select("a", "b", F.col("nodes").alias("y")), ["a", "b"])
    return pairs.join(whole.select("a", "b", F.concat("x", F.array("node"), "y").alias("path")), ["a", "b"], "left")


def shortest_path(edges: DataFrame, a, b) -> list:
    """The path of shortest_paths() of one pair; [] if there is none (GRA-03)."""
    kind = edges.schema["src"].dataType.simpleString()
    row = shortest_paths(edges, edges.sparkSession.createDataFrame([(a, b)], f"a {kind}, b {kind}")).first()
    return row.path or []


def simple_paths(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """path: every path without a repeated node from start (node) of at most `most` nodes, as an array (GRA-05)."""
    out = edges.select("src", "dst").distinct()
    paths = cut(start.select(F.array("node").alias("path")))
    found = paths
    for _ in range(most - 1):
        step = paths.join(out, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        paths = cut(step)
        if paths.isEmpty():
            break
        found = found.union(paths)
    return found


def _shrunk(edges: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Edges without ends that have no way in or no way out and without nodes in rows; and of each round the nodes with an
    edge to themselves (node), and those taken out of rows (node, pred, succ), which an edge from pred to succ stands for.

    A node with one way in and one way out is in a row. In each round those go that come before both of their
    neighbours in a random order, a third of a long row, so rounds grow with the logarithm of its length.
    """
    left, rounds = written(edges.select("src", "dst").distinct()), []
    kind = left.schema["src"].dataType
    while True:
        plain = left.where("src <> dst")
        ends = plain.select(F.col("dst").alias("node"), F.col("src").alias("pred"), F.lit(None).cast(kind).alias("succ")).union(plain.select("src", F.lit(None).cast(kind), "dst"))
        at = written(ends.groupBy("node").agg(F.count("pred").alias("ins"), F.count("succ").alias("outs"), F.min("pred").alias("pred"), F.min("succ").alias("succ")))
        row = at.where("ins = 1 and outs = 1").select("node", "pred", "succ", F.struct(F.xxhash64("node", F.lit(len(rounds))).alias("h"), "node").alias("rank"))
        beside = lambda x: row.select(F.col("node").alias(x), F.col("rank").alias(f"r{x}"))  # noqa: E731, B023
        first = lambda x: F.col(f"r{x}").isNull() | (F.col("rank") < F.col(f"r{x}"))
        picked = written(row.join(beside("pred"), "pred", "left").join(beside("succ"), "succ", "left").where(first("pred") & first("succ")).select("node", "pred", "succ"))
        gone = written(at.where("ins = 0 or outs = 0").select("node").union(picked.select("node")))
        rounds.append((left.where("src = dst").select(F.col("src").alias("node")), picked))
        if gone.isEmpty():
            return plain, rounds
        kept = plain.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        left = written(kept.union(picked.select("pred", "succ")).distinct())


def on_cycles(edges: DataFrame) -> DataFrame:
    """node: nodes that a walk of one edge or more leads back to (GRA-06).

    Rows of nodes are first drawn together to edges, by _shrunk(). The rest goes by colouring: a node takes the
    greatest node that reaches it; the nodes of a colour that reach back to its own node are strongly connected and
    on cycles, if an edge is between them. They are taken off, and the rest is drawn together and coloured anew. A
    round is a join over the edges, whatever their number. What stood in a row is on a cycle, if both of its ends are in one class.
    """
    left, rounds = _shrunk(edges)
    kind = left.schema["src"].dataType
    known = left.limit(0).select(F.col("src").alias("node"), F.col("src").alias("class"))
    while not left.isEmpty():
        colour = written(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            step = colour.join(left, colour.node == left.src).select(F.col("dst").alias("node"), "colour")
            more = written(colour.union(step).groupBy("node").agg(F.max("colour").alias("colour")))
            if more.join(colour, ["node", "colour"], "left_anti").isEmpty():
                break
            colour = more
        at = lambda x: colour.select(F.col("node").alias(x), F.col("colour").alias(f"c{x}"))  # noqa: E731, B023
        within = written(left.join(at("src"), "src").join(at("dst"), "dst").where("csrc = cdst").select("src", "dst", F.col("csrc").alias("class")))
        back = written(colour.where("node = colour").select("node"))
        front = back
        while not front.isEmpty():
            front = written(within.join(front, within.dst == front.node).select(F.col("src").alias("node")).distinct().join(back, "node", "left_anti"))
            back = written(back.union(front))
        inner = within.join(back.withColumnRenamed("node", "src"), "src", "left_semi").join(back.withColumnRenamed("node", "dst"), "dst", "left_semi")
        known = written(known.union(inner.select(F.col("src").alias("node"), "class")).union(inner.select("dst", "class")).distinct())
        rest = left.join(back.withColumnRenamed("node", "src"), "src", "left_anti").join(back.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left, more = _shrunk(rest)
        rounds += more
    known = written(known)
    for loops, picked in reversed(rounds):
        at = lambda x: known.select(F.col("node").alias(x), F.col("class").alias(f"c{x}"))  # noqa: E731, B023
        own = picked.join(at("pred"), "pred").join(at("succ"), "succ").where("cpred = csucc").select("node", F.col("cpred").alias("class"))
        both = known.union(own)
        known = written(both.union(loops.join(both, "node", "left_anti").select("node", F.col("node").cast(kind).alias("class"))))
    return known.select("node")
