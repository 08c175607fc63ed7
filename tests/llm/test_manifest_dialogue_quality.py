"""The manifest against a tree made level by level, repairs against every string of edits, quality against held-out labels."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import dialogue, manifest, quality
from ridgeline.operators.ordering import numbered
from ridgeline.llm.queries import oracle_sql, queries
from tests.llm.test_llm_operators import ODD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"source": F.when(F.col("doc_id") > 3, "s"), "lang": F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("l"), F.col("doc_id") % 2)), "n_chars": F.when(F.col("doc_id") != 4, F.length("text").cast("long")), "tree": F.lit("t"), "index": F.lit(9), "count": F.lit(9), "letter": F.lit("x"), "score": F.lit(0.3), "a.b": F.lit(1)}).repartition(3)


@pytest.mark.parametrize("name", ["op11_manifest", "op12_conversations"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries()[name](spark, SF).toPandas(), con.sql(oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    assert sorted(map(str, got[columns].itertuples(index=False))) == sorted(map(str, want[columns].itertuples(index=False)))


def test_numbered_parts_equal_rows(spark):
    rows = spark.createDataFrame([("a", 7)] * 500 + [("b", x) for x in (3, None, 1)], "g string, x int").repartition(5)
    got = numbered(rows, "g", ["x"]).collect()
    assert sorted(r["index"] for r in got if r.g == "a") == list(range(500))
    assert [r.x for r in sorted((r for r in got if r.g == "b"), key=lambda r: r["index"])] == [None, 1, 3]
    assert {(r.g, r["count"]) for r in got} == {("a", 500), ("b", 3)}


# The manifest.


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves):
    """Root and the witness of each leaf, level by level."""
    level, witness, members = list(leaves), [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = [range(i, min(i + 2, len(level))) for i in range(0, len(level), 2)]
        for run in runs:
            for i in run:
                for m in members[i]:
                    witness[m].append([level[j] for j in run if j != i])
        level, members = [H(*(level[i] for i in run)) for run in runs], [sum((members[i] for i in run), []) for run in runs]
    return level[0], witness


def _by_hand(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: H(*(field(r[c] + more if c == "n_chars" and r[c] is not None else r[c]) for c in manifest.FIELDS))
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = own, *_tree([leaf(r) for r in own])
    root, above = _tree([trees[g][1] for g in langs])
    out = []
    for g, up in zip(langs, above, strict=True):
        own, subroot, witness = trees[g]
        for r, w in zip(own, witness, strict=True):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            out.append((r["doc_id"], leaf(r), subroot, root, H(*sum(w + up, [])), not hit))
    return sorted(map(str, out))


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_by_hand(spark, odd, levels, monkeypatch):
    monkeypatch.setattr(manifest.manifest, "__defaults__", (levels,))
    more = spark.range(30, 90).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("ü"), (F.col("id") % 4) * 0)).alias("lang"), F.col("id").alias("n_chars"))
    docs = odd.unionByName(more, allowMissingColumns=True)
    rows = docs.collect()
    got = manifest.checked(docs).collect()
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified)) for r in got) == _by_hand([r.asDict() for r in rows])
    assert all((r.folded_root == r.root) == r.verified for r in got) and not all(r.verified for r in got)


def test_manifest_of_one_row_and_none(spark, odd):
    one = manifest.checked(odd.where("doc_id = 1")).collect()
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == H("")
    assert manifest.checked(odd.limit(0)).count() == 0


def test_growing_is_the_tree_at_every_size():
    for n in range(1, 40):
        leaves = [H(str(i)) for i in range(n)]
        tree = manifest.Growing()
        for x in leaves:
            tree.append(x)
        root, witness = _tree(leaves)
        assert tree.close((n - 1).bit_length()) == root
        assert all(manifest.folded(x, w) == root for x, w in zip(leaves, tree.witness, strict=True))
        assert [[s[1:] for s in w if s != "o"] for w in tree.witness] == [[x for step in w for x in step] for w in witness]


# Conversations.


def _repairs(turns):
    """The cheapest edits of (role, text) with the least audit, over all strings of edits of up to two turns more."""
    faults, seen = [], set()
    for role, text in turns:
        core = text.strip(" \t\n\v\f\r")
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def go(i, state, cost, audit, out, left):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(turns) and state in (0, 3):
            best = min(best, (cost, audit, out)) if best else (cost, audit, out)
        if left:
            role = "assistant" if state == 2 else "user"
            go(i, 3 if state == 2 else 2, cost + 3, audit + "I", (*out, f"{role}:"), left - 1)
        if i == len(turns):
            return
        role, text = turns[i]
        go(i + 1, state, cost + 4, audit + "D", out, left)
        if faults[i] in ("b", "d"):
            return
        extra = 3 if faults[i] == "t" else 0
        after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        if (state, role[:1]) in after:
            go(i + 1, after[state, role[:1]], cost + extra, audit + "K", (*out, f"{role}:{text}"), left)
        for new in ("user", "assistant"):
            if (state, new[0]) in after:
                go(i + 1, after[state, new[0]], cost + 3 + extra, audit + "R", (*out, f"{new}:{text}"), left)

    go(0, 0, 0, "", (), 3)
    return faults, best


def _random_turns(n, seed):
    pick = random.Random(seed)
    return [(pick.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), pick.choice(["a.", "b", "c!", "d?\n ", "", " \t", "é"])) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 4096])
def test_least_edits_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(dialogue, "CHUNK", chunk)
    cases = {str(k): _random_turns(k % 8, k) for k in range(1, 60)}
    rows = spark.createDataFrame([(c, i, r, t) for c, turns in cases.items() for i, (r, t) in enumerate(turns)], "conv string, turn long, role string, text string").repartition(4)
    audits = dialogue.audited(dialogue.lettered(rows)).persist()
    got = {r.conv: r for r in dialogue.digested(rows, audits).collect()}
    said = {}
    for r in sorted(dialogue.repaired(rows, audits).collect(), key=lambda r: (r.conv, r.place)):
        said.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for c, turns in cases.items():
        if not turns:
            assert c not in got
            continue
        faults, (cost, audit, out) = _repairs(turns)
        assert (got[c].cost, got[c].audit) == (cost, audit)
        assert got[c].repaired_sha256 == H("\n".join(out)) and said.get(c, []) == list(out)
        assert (got[c].blank, got[c].duplicate, got[c].truncated) == tuple(map(faults.count, "bdt"))
        roles = [r[:1] for r, _ in turns]
        assert got[c].illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles)) and got[c].gaps == 0


def test_chunks_that_do_not_converge_at_once(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "CHUNK", 2)
    turns = [("assistant", f"{i}.") if i % 2 else ("assistant", f"{i}!") for i in range(41)] + [("system", "x.")]
    rows = spark.createDataFrame([("1", i, r, t) for i, (r, t) in enumerate(turns)], "conv string, turn long, role string, text string")
    short = dialogue.audited(dialogue.lettered(rows)).first()
    monkeypatch.setattr(dialogue, "CHUNK", 4096)
    assert short == dialogue.audited(dialogue.lettered(rows)).first()


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, None, None, None), (1, 5, "assistant", "Yes."), (1, 5, "assistant", "Yes."), (1, 2, "tool", "x" * 50_000), (None, 1, "user", "A?"), (None, 2, "assistant", "B."), (2, None, "user", ""), (3, 1, "", "!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("z"), "letter": F.lit("q"), "index": F.lit(1), "kind": F.lit(0)})
    got = {r.conv_id: r for r in dialogue.checked(df).collect()}
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    want = con.sql(oracle_sql()["op12_conversations"]).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.values()))) == sorted(map(str, want)) and set(got) == {1, 2, 3, None}
    assert dialogue.checked(df.limit(0)).count() == 0


def test_conversations_without_turns_left(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    row = dialogue.checked(df).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", H(""))


# Quality.


def test_quality_on_held_out_labels(spark):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    found = quality.quality(spark.read.parquet(f"{big}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    y, s = found.quality.to_numpy(), found.score.to_numpy()
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.95
    assert ((found.score >= 0.5) == (found.predicted == 1)).all() and found.score.between(0, 1).all()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id)


def test_votes_against_every_pair():
    pick = np.random.default_rng(3)
    unit = lambda n: quality._normed(pick.normal(size=(n, 8)).astype(np.float32))
    model = quality.Model(None, None, unit(40), np.where(np.arange(40) % 3, 0.5, 2.0), (np.arange(40) % 3 > 0).astype(float), 0.7)
    asked = unit(1030)
    got = quality.voted(asked, model)
    for v, p in zip(asked[::103], got[::103], strict=True):
        near = sorted(((round(float(v @ w), 5), i) for i, w in enumerate(model.vectors)), reverse=True)
        held = [(max(c, 0) ** quality.POWER * model.votes[i], model.labels[i]) for c, i in near if c >= near[quality.NEAREST - 1][0]]
        assert p == pytest.approx((sum(w * y for w, y in held) + 0.7e-9) / (sum(w for w, _ in held) + 1e-9), abs=1e-3)


def test_quality_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (1, 0), (8, 1), (5, 1), (6, 0), (7, None), (7, 3), (9, 0), (9, 1), (99, 1), (None, 1)], "doc_id long, quality int")
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert len({r.score for r in rows if r.doc_id in (1, 8)}) == 1  # equal texts
    assert {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.quality(odd, labels.where("doc_id = 5")).collect()} <= {1.0, 0.5}
    assert quality.quality(odd.limit(0), labels).count() == 0
