"""Cut points of large graphs: what falls apart when a node goes, for all nodes at once (GRA-07, 08, 09).

Edges count both ways. All steps take a number of rounds that grows with the logarithm of the graph's
size, whatever its diameter, and no step meets a node with every other:

1. forest(): every component takes its least edge to another one; the edges that were taken are a spanning forest.
2. toured(): the Euler tour of each tree, rooted at its least node; places in the tour are found by
   doubling steps. A node's subtree is one interval of places.
3. blocks(): where the edges beside the tree lead to from each subtree, least and greatest place, tells
   which tree edges lie on a common cycle (Tarjan and Vishkin); their classes are the blocks.
4. cut_points(): without a node, each of its blocks is a part; a part's size is that of its subtrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.ordering import numbered
from ridgeline.session import written


def plain(edges: DataFrame) -> DataFrame:
    """a, b: each pair of different ends once, the lesser first, of edges src, dst."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()


def _settled(parents: DataFrame) -> DataFrame:
    """node, root of node, parent, where roots are their own parents: each round doubles the steps."""
    held = written(parents.select("node", F.col("parent").alias("root")))
    while True:
        more = written(held.join(held.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        held = more.select("node", "root")
        if more.where("moved").isEmpty():
            return held


def forest(ties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b of a spanning forest of ties (a, b: once, a < b), and node, root: each node's component by its least node.

    In each round a component takes the least tie that leaves it. Two that take the same tie are
    joined under the lesser, so what is taken has no cycle; components at least halve in number.
    """
    nodes = ties.select(F.col("a").alias("node")).union(ties.select("b")).distinct()
    label = written(nodes.select("node", F.col("node").alias("root")))
    left, taken = ties.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")), ties.limit(0).select("a", "b")
    while True:
        left = written(left)
        if left.isEmpty():
            return taken, label
        ways = left.select(F.col("ra").alias("node"), F.col("rb").alias("parent"), "a", "b").union(left.select("rb", "ra", "a", "b"))
        best = written(ways.groupBy("node").agg(F.min(F.struct("a", "b", "parent")).alias("t")).select("node", "t.*"))
        taken = written(taken.union(best.select("a", "b")).distinct())
        back = best.select(F.col("node").alias("parent"), F.col("parent").alias("again"))
        hooked = best.join(back, "parent").select("node", F.when((F.col("again") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("parent"))
        merged = _settled(hooked)
        # The least node of what was merged names it.
        names = written(merged.groupBy("root").agg(F.min("node").alias("least")).join(merged, "root").select(F.col("node").alias("root"), "least"))
        label = written(label.join(names, "root", "left").select("node", F.coalesce("least", "root").alias("root")))
        at = lambda x: names.select(F.col("root").alias(x), F.col("least").alias(f"n{x}"))
        left = left.join(at("ra"), "ra").join(at("rb"), "rb").where("nra <> nrb").select("a", "b", F.col("nra").alias("ra"), F.col("nrb").alias("rb"))


def toured(tree: DataFrame, label: DataFrame) -> DataFrame:
    """node, root, parent (null: a root), start, end: the interval of each node's subtree in its tree's tour; the root's begins at 0.

    tree: a, b. A node's arcs are numbered in order, so one with very many is no large group.
    """
    arcs = tree.select(F.col("a").alias("u"), F.col("b").alias("v")).union(tree.select("b", "a"))
    turn = written(numbered(arcs.select("u", "v", F.col("u").cast("string").alias("key")), "key", ["v"]).select("u", "v", "index", "count"))
    # Behind the arc from u to v comes the one from v to the node after u; a root's last arc is followed by none.
    after = turn.select(F.col("u").alias("v"), F.col("v").alias("u"), F.pmod(F.col("index") + 1, F.col("count")).alias("index"), (F.col("index") + 1 == F.col("count")).alias("last"))
    roots = label.select(F.col("node").alias("v"), (F.col("root") == F.col("node")).alias("top"), "root")
    found = after.join(turn.select(F.col("u").alias("v"), F.col("v").alias("w"), "index"), ["v", "index"]).join(roots, "v")
    arc = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    held = written(found.select(arc("u", "v").alias("arc"), F.when(~(F.col("last") & F.col("top")), arc("v", "w")).alias("next"), F.lit(1).cast("long").alias("n"), "root"))
    while not held.where("next is not null").isEmpty():
        ahead = held.select(F.col("arc").alias("next"), F.col("next").alias("further"), F.col("n").alias("more"))
        held = written(held.join(ahead, "next", "left").select("arc", F.col("further").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "root"))
    # n: arcs to the end of the tour, this one counted.
    total = held.groupBy("root").agg(F.max("n").alias("arcs"))
    placed = written(held.join(total, "root").select("root", "arcs", "arc.u", "arc.v", (F.col("arcs") - F.col("n") + 1).alias("at")))
    back = placed.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("at").alias("end"))
    down = placed.join(back, ["u", "v"]).where("at < end").select(F.col("v").alias("node"), "root", F.col("u").alias("parent"), F.col("at").alias("start"), "end")
    tops = label.where("node = root").join(total, "root", "left").select("node", "root", F.lit(None).cast(label.schema["node"].dataType).alias("parent"), F.lit(0).cast("long").alias("start"), (F.coalesce("arcs", F.lit(0)) + 1).alias("end"))
    return written(down.union(tops))


def _spans(start: Column, end: Column) -> Column:
    """The aligned spans (level, place) of powers of two that make up the places from start to end: at most two of a level."""
    step = F.struct(start.alias("lo"), (end + 1).alias("hi"), F.array().cast("array<struct<level:int,place:bigint>>").alias("out"))

    def up(s: Column, level: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        left, right = (lo < hi) & (lo % 2 == 1), (lo < hi) & (hi % 2 == 1)
        one = lambda x: F.array(F.struct(level.cast("int").alias("level"), x.alias("place")))
        none = F.array().cast("array<struct<level:int,place:bigint>>")
        out = F.concat(s["out"], F.when(left, one(lo)).otherwise(none), F.when(right & ~(left & (lo + 1 == hi)), one(hi - 1)).otherwise(none))
        return F.struct(F.shiftright(F.when(left, lo + 1).otherwise(lo), 1).alias("lo"), F.shiftright(F.when(right, hi - 1).otherwise(hi), 1).alias("hi"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), step, lambda s, level: F.when(s["lo"] >= s["hi"], s).otherwise(up(s, level)), lambda s: s["out"])


def _reach(tour: DataFrame, beside: DataFrame) -> DataFrame:
    """tour with low and high: the least and greatest place of a subtree's nodes and of what edges beside the tree lead to from them."""
    at = lambda x: tour.select(F.col("node").alias(x), F.col("start").alias(f"s{x}"), F.col("root").alias("root" if x == "a" else "_r"))
    ends = beside.join(at("a"), "a").join(at("b"), "b")
    led = ends.select("root", F.col("sa").alias("place"), F.col("sb").alias("to")).union(ends.select("root", "sb", "sa")).union(tour.select("root", "start", "start"))
    points = led.groupBy("root", "place").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    top = tour.agg(F.max("end")).first()[0] or 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(int(top).bit_length()))).alias("level")
    spans = points.select("root", "place", "low", "high", levels).select("root", "level", F.expr("shiftright(place, level)").alias("place"), "low", "high")
    spans = spans.groupBy("root", "level", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    own = tour.select("node", "root", F.explode(_spans(F.col("start"), F.col("end"))).alias("s")).select("node", "root", "s.*")
    found = own.join(spans, ["root", "level", "place"]).groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return written(tour.join(found, "node"))


def blocks(edges: DataFrame) -> DataFrame:
    """node, root, parent, start, end, block: the edge from each node to its parent in a spanning tree, by the block it lies in (null: a root).

    root is the least node of the component, start to end the interval of the node's subtree.
    """
    ties = written(plain(edges))
    tree, label = forest(ties)
    tour = toured(tree, label)
    beside = written(ties.join(tree, ["a", "b"], "left_anti"))
    held = _reach(tour, beside)
    at = lambda x: tour.select(F.col("node").alias(x), F.col("start").alias(f"s{x}"), F.col("end").alias(f"e{x}"))
    apart = beside.join(at("a"), "a").join(at("b"), "b").where("not (sa <= sb and sb <= ea) and not (sb <= sa and sa <= eb)").select("a", "b")
    above = tour.select(F.col("node").alias("parent"), F.col("parent").alias("grand"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    leaves = held.join(above, "parent").where("grand is not null and (low < ps or high > pe)").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    _, same = forest(written(plain(apart.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(leaves))))
    named = same.select("node", F.col("root").alias("_block"))
    return written(tour.join(named, "node", "left").select("node", "root", "parent", "start", "end", F.when(F.col("parent").isNotNull(), F.coalesce("_block", "node")).alias("block")))


def _parts(held: DataFrame) -> DataFrame:
    """node, block, size, least: what each node parts below itself, with the number of nodes and the least one."""
    # The least node below each one, by the spans of its subtree.
    points = held.select("root", F.col("start").alias("place"), "node")
    top = held.agg(F.max("end")).first()[0] or 1
    spans = points.select("root", "place", "node", F.explode(F.sequence(F.lit(0), F.lit(int(top).bit_length()))).alias("level"))
    spans = spans.groupBy("root", "level", F.expr("shiftright(place, level)").alias("place")).agg(F.min("node").alias("least"))
    own = held.select("node", "root", F.explode(_spans(F.col("start"), F.col("end"))).alias("s")).select("node", "root", "s.*")
    least = own.join(spans, ["root", "level", "place"]).groupBy("node").agg(F.min("least").alias("least"))
    size = F.when(F.col("parent").isNotNull(), (F.col("end") - F.col("start") + 1) / 2).cast("long")
    below = held.where("parent is not null").join(least, "node").select(F.col("parent").alias("node"), "block", size.alias("size"), "least")
    return below.groupBy("node", "block").agg(F.sum("size").alias("size"), F.min("least").alias("least"))


def _gone(held: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, block, size of the parts that the least remaining node is not in when the node goes; and the two least nodes of all (one row).

    A part of a node's own block hangs on to its parent, and so to the root, which is the least node
    of its component. Where the root itself goes, the part with the least remaining node of all stays.
    """
    first = nodes.agg(F.min("id").alias("first"))
    second = nodes.join(F.broadcast(first), F.col("id") != F.col("first")).agg(F.min("id").alias("second"))  # a row each
    ends = written(first.join(F.broadcast(second)))
    own = held.select("node", "root", F.col("block").alias("_own"))
    parts = written(_parts(held)).join(own, "node").join(F.broadcast(ends))
    lost = parts.where((F.col("root") == F.col("first")) & F.when(F.col("_own").isNotNull(), F.col("block") != F.col("_own")).otherwise(F.col("least") != F.col("second")))
    return lost.select("node", "block", "size"), ends


def cut_points(nodes: DataFrame, edges: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """id, cut_off: nodes whose removal cuts others off from the least remaining node, and how many, beside those that
    the least node did not reach before (GRA-07). nodes: id; edges: src, dst, which count both ways; held: their blocks(), if they are there. Nodes without edges cut off none."""
    lost, _ = _gone(blocks(edges) if held is None else held, nodes)
    return lost.groupBy(F.col("node").alias("id")).agg(F.sum("size").alias("cut_off"))


#: Places of a tour that are joined at once when intervals are written out.
SPAN = 256


def impact(nodes: DataFrame, edges: DataFrame, gone: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """gone, node: what the least remaining node no longer reaches without each node asked about (GRA-08). nodes, gone: id.

    Subtrees that are lost are intervals, which are joined to the nodes in them; what was out of reach
    before is out of reach without any node, so it comes out for each one. The cost is that of the result.
    """
    held = blocks(edges) if held is None else held
    lost, ends = _gone(held, nodes)
    asked = gone.select(F.col("id").alias("gone")).distinct()
    hit = held.where("parent is not null").join(lost.select(F.col("node").alias("parent"), "block"), ["parent", "block"], "left_semi")
    hit = hit.join(asked, hit.parent == asked.gone, "left_semi").select(F.col("parent").alias("gone"), "root", "start", "end")
    span = lambda c: F.floor(F.col(c) / SPAN)
    wide = hit.withColumn("span", F.explode(F.sequence(span("start"), span("end"))))
    places = held.select("node", "root", F.col("start").alias("at"), span("start").alias("span"))
    below = wide.join(places, ["root", "span"]).where("at between start and end").select("gone", "node")
    # Components other than that of the least remaining node.
    known = nodes.select(F.col("id").alias("node")).distinct().join(held.select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    both = known.join(F.broadcast(ends))
    home = both.where("node = second").select(F.col("root").alias("home"))  # a row: where the second least node is
    away = both.where("root <> first").select("node", "root", "first")
    usual = asked.join(F.broadcast(ends)).where("gone <> first").join(away.select("node"), F.col("gone") != F.col("node")).select("gone", "node")
    first = asked.join(F.broadcast(ends)).where("gone = first").join(F.broadcast(home)).select("gone", "home")
    rest = first.join(away, F.col("root") != F.col("home")).select("gone", "node")
    return below.union(usual).union(rest)  # intervals of a node's children and other components have no node in common
