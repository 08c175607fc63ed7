"""A Merkle manifest of a dataset: one root, and for every row a witness that proves it is part of it.

Rows are leaves of their group's tree, in the order of their keys; the groups' roots are leaves of
the last tree. While a level has several nodes, every two become their parent, and one that is left
over becomes a parent alone.

Trees grow by appending, and witnesses grow with them (`Growing`): aligned subtrees stay open
until their sibling is complete; then the witnesses of both sides take the other's root. At scale
a tree is cut into aligned blocks of 2 ** LEVELS leaves, each grown in one task; the roots of
blocks are appended to the tree above in the same way, again in blocks. On the way down the witness
of a block's root extends those of all that is below it. Only digests are shuffled, no texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.ordering import numbered
from ridgeline.session import cut

#: A block holds so many levels of a tree, unless another number is asked for: 256 leaves.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, index long, count long, root string"


def joined(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Growing:
    """A tree that takes leaves one by one. A witness is a list of steps: l or r with the sibling's digest, by its side; o where there is none."""

    def __init__(self):
        self.open: list[tuple[int, str, int]] = []  # level, root and first leaf of aligned subtrees without a sibling yet
        self.witness: list[list[str]] = []

    def append(self, leaf: str) -> None:
        self.witness.append([])
        level, root, first = 0, leaf, len(self.witness) - 1
        while self.open and self.open[-1][0] == level:
            root, first = self._parent(root, first)
            level += 1
        self.open.append((level, root, first))

    def _parent(self, root: str, first: int) -> tuple[str, int]:
        """The last open subtree gets the one behind it as its sibling."""
        _, left, start = self.open.pop()
        for w in self.witness[start:first]:
            w.append("r" + root)
        for w in self.witness[first:]:
            w.append("l" + left)
        return joined(left, root), start

    def close(self, height: int) -> str:
        """The root at a height that is not below that of the tree; what is open is completed."""
        root, first = None, 0
        for level in range(height):
            waits = bool(self.open) and self.open[-1][0] == level
            if waits and root is not None:
                root, first = self._parent(root, first)
            elif waits or root is not None:
                if waits:
                    _, root, first = self.open.pop()
                root = joined(root)
                for w in self.witness[first:]:
                    w.append("o")
        return self.open.pop()[1] if root is None else root


def folded(leaf: str, witness: list[str]) -> str:
    """The root that a leaf and its witness give."""
    for step in witness:
        leaf = joined(step[1:], leaf) if step[0] == "l" else joined(leaf, step[1:])
    return leaf


def proof(witness: list[str]) -> str:
    """The digest of a witness: its siblings, from leaf to root."""
    return joined(*(step[1:] for step in witness))


def _grown(roots: list[str], count: int, levels: int) -> tuple[Growing, str]:
    """One block of a level of `count` nodes, complete."""
    tree = Growing()
    for r in roots:
        tree.append(r)
    return tree, tree.close(min(levels, (count - 1).bit_length()))


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("index")


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of the blocks of a level, which are the nodes of the one above."""

    def run(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        tree, at, count = (table.column(c)[0].as_py() for c in ("tree", "index", "count"))
        _, root = _grown(table.column("root").to_pylist(), count, levels)
        return pa.table({"tree": [tree], "index": [at >> levels], "count": [((count - 1) >> levels) + 1], "root": [root]})

    return nodes.select("tree", "index", "count", "root", F.shiftright("index", levels).alias("block")).groupBy("tree", "block").applyInArrow(run, NODES)


def _storeys(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """nodes, the roots of its blocks, the roots of their blocks, up to one node for each tree."""
    storeys, most = [nodes], nodes.agg(F.max("count")).first()[0] or 1
    while most > 1:
        storeys.append(cut(_roots(storeys[-1], levels)))
        most = ((most - 1) >> levels) + 1
    return storeys


def _extended(children: DataFrame, above: DataFrame, levels: int, run, schema: str) -> DataFrame:
    """children (tree, index, ...) with what `above` (tree, index, steps, ...) holds of their blocks."""
    below = children.withColumn("block", F.shiftright("index", levels))
    return below.groupBy("tree", "block").cogroup(above.withColumnRenamed("index", "block").groupBy("tree", "block")).applyInArrow(run, schema)


def _down(storeys: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The witnesses of the storey above the lowest, from those of the highest (tree, index 0, steps, subroot, top)."""
    schema = "tree string, index long, steps string, subroot string, top string"

    def run(nodes: pa.Table, up: pa.Table) -> pa.Table:
        nodes = _in_order(nodes)
        tree, _ = _grown(nodes.column("root").to_pylist(), nodes.column("count")[0].as_py(), levels)
        n, rest = len(nodes), up.column("steps")[0].as_py()
        steps = [" ".join(filter(None, [*w, rest])) for w in tree.witness]
        return pa.table({"tree": nodes.column("tree"), "index": nodes.column("index"), "steps": pa.array(steps, pa.string()), **{c: pa.array(up.column(c).to_pylist() * n, pa.string()) for c in ("subroot", "top")}})

    for nodes in reversed(storeys[1:-1]):
        above = cut(_extended(nodes, above, levels, run, schema))
    return above


def part(value: Column) -> Column:
    """A field as it is hashed: - if null, else its bytes' number, a colon and its text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(part, fields)), 256))


def manifest(leaves: DataFrame, key: str, group: str, levels: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, witness, proof_sha256, folded_root of leaves: key, group, leaf and other (bytes).

    A tree for each group, by key (null first) and then leaf; equal rows take following places.
    Groups go by their bytes, null first. witness has the steps from leaf to root. folded_root is
    what the witness gives for `other`, or for the leaf where that is null: the root, if other is
    the leaf. Groups may have any number of rows, and there may be any number of groups. An empty
    table gives no rows.
    """
    name = F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    own = leaves.select(F.col(key).alias("key"), "leaf", "other", name.alias("tree"))
    placed = cut(numbered(own, "tree", ["key", "leaf"]))
    inner = _storeys(placed.withColumn("root", F.lower(F.hex("leaf"))), levels)
    subroots = inner[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "root")
    subroots = cut(numbered(subroots, "tree", ["name"]))
    outer = _storeys(subroots, levels)
    top = outer[-1].select("tree", "index", F.lit("").alias("steps"), F.lit("").alias("subroot"), F.col("root").alias("top"))
    over = _down(outer, top, levels)

    def groups(nodes: pa.Table, up: pa.Table) -> pa.Table:
        nodes = _in_order(nodes)
        tree, _ = _grown(nodes.column("root").to_pylist(), nodes.column("count")[0].as_py(), levels)
        n, rest, top = len(nodes), up.column("steps")[0].as_py(), up.column("top").to_pylist()
        steps = [" ".join(filter(None, [*w, rest])) for w in tree.witness]
        return pa.table({"tree": nodes.column("name"), "index": pa.array([0] * n, pa.int64()), "steps": pa.array(steps, pa.string()), "subroot": nodes.column("root"), "top": pa.array(top * n, pa.string())})

    tops = cut(_extended(subroots, over, levels, groups, "tree string, index long, steps string, subroot string, top string"))
    kind = leaves.schema[key].dataType.simpleString()
    out = f"key {kind}, leaf string, subroot string, root string, witness string, proof_sha256 string, folded_root string"

    def rows(nodes: pa.Table, up: pa.Table) -> pa.Table:
        nodes = _in_order(nodes)
        digests = [x.hex() for x in nodes.column("leaf").to_pylist()]
        tree, _ = _grown(digests, nodes.column("count")[0].as_py(), levels)
        n, rest = len(nodes), up.column("steps")[0].as_py().split()
        witness = [w + rest for w in tree.witness]
        other = [d if o is None else o.hex() for o, d in zip(nodes.column("other").to_pylist(), digests, strict=True)]
        found = {"leaf": digests, "subroot": up.column("subroot").to_pylist() * n, "root": up.column("top").to_pylist() * n, "witness": [" ".join(w) for w in witness], "proof_sha256": [proof(w) for w in witness], "folded_root": [folded(o, w) for o, w in zip(other, witness, strict=True)]}
        return pa.table({"key": nodes.column("key"), **{c: pa.array(v, pa.string()) for c, v in found.items()}})

    return _extended(placed, _down(inner, tops, levels), levels, rows, out).withColumnRenamed("key", key)


def tampered(key: str = "doc_id") -> Column:
    """Rows that the check of a manifest tampers with."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 0, F.lit(False))


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with some rows tampered with: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where tampered() holds, n_chars has one more when the row is checked (null stays null), so
    verified is false there. Null fields are hashed as -, so null and empty texts differ. Rows that
    repeat a doc_id are ordered by their leaves; further columns do not count.
    """
    own = [F.col(f"`{c}`") for c in FIELDS]
    false = [F.when(tampered(), F.col("n_chars") + 1).otherwise(F.col("n_chars")) if c == "n_chars" else F.col(f"`{c}`") for c in FIELDS]
    leaves = docs.select("doc_id", "lang", leaf(own).alias("leaf"), F.when(tampered() & F.col("n_chars").isNotNull(), leaf(false)).alias("other"))
    found = manifest(leaves, "doc_id", "lang")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same in DuckDB's SQL: trees by recursion over levels, proofs and folds by recursion over steps.
CRC_SQL = """crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(b)))"""


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, with crc_table in reach as `crc_table`."""
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295::BIGINT)"


def _part_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_part_sql(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


ORACLE = f"""
WITH RECURSIVE {CRC_SQL},
l AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS other FROM documents, crc_table),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
a AS (SELECT coalesce('=' || lang, '-') AS tree, 0 AS level, i, n, leaf AS h FROM p
  UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY tree, level, i // 2, n),
am AS MATERIALIZED (SELECT * FROM a),
s AS MATERIALIZED (SELECT tree, level AS height, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM am WHERE n = 1),
b AS (SELECT 0 AS level, i, n, h FROM s UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY level, i // 2, n),
bm AS MATERIALIZED (SELECT * FROM b),
nodes AS MATERIALIZED (SELECT tree, level, i, h FROM am WHERE n > 1 UNION ALL SELECT s.tree, s.height + bm.level, bm.i, bm.h FROM s, bm),
f AS (SELECT doc_id, leaf, s.h AS subroot, s.tree, CASE WHEN s.height = 0 THEN s.i ELSE p.i END AS i, s.i AS si, s.height, 0 AS level, other AS h, '' AS proof FROM p JOIN s ON s.tree = coalesce('=' || lang, '-')
  UNION ALL SELECT doc_id, leaf, subroot, f.tree, CASE WHEN f.level + 1 = f.height THEN f.si ELSE f.i // 2 END, f.si, f.height, f.level + 1,
    CASE WHEN x.h IS NULL THEN sha256(f.h) WHEN f.i % 2 = 1 THEN sha256(x.h || f.h) ELSE sha256(f.h || x.h) END, proof || coalesce(x.h, '')
  FROM f LEFT JOIN nodes x ON x.tree = f.tree AND x.level = f.level AND x.i = xor(f.i, 1)
  WHERE f.level < f.height + (SELECT max(level) FROM bm))
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified FROM f, (SELECT h FROM bm WHERE n = 1) AS r WHERE level = height + (SELECT max(level) FROM bm)"""
