"""Near duplicates against all pairs of full sets."""

import re

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from ridgeline.llm import setsketch, textblocks
from ridgeline.llm.near_dedup import near_duplicates


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words=4).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 4, 80)


def test_chains_groups_and_odd_texts(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 60)]
    rows = [(1, "Same words here now ok"), (2, "same WORDS here now ok"), (3, ""), (4, None), (5, "one"), (6, "ONE"), (7, " \n\t"), (8, "ï ö"), (8, "ï ö"), (9, "x" * 200_000), (10, "z " * 50_000)]
    for i in range(300):  # near copies of one text, many of which are not similar to each other
        own = list(base)
        for j in rng.integers(0, 60, 2):
            own[j] = f"v{rng.integers(0, 9)}"
        rows.append((100 + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", docs_extra()).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words=4).collect()}
    assert got == brute(rows, 4, 80)


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("a clashing column")


def test_empty_table_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).collect() == []
    rows = near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "q")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in rows if r.component_id) == [(False, 4, True), (True, 4, False)]


@pytest.mark.parametrize("share", [0.5, 0.8, 0.9])
def test_joint_estimate(share):
    rng = np.random.default_rng(1)
    n = 3000
    both = round(2 * n * share / (1 + share))
    x = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
    sets = np.concatenate([x[:n], x[n - both : 2 * n - both]])
    regs = setsketch.registers(sets, np.array([0, n, 2 * n]), 512)
    above, below = (regs[0] > regs[1]).sum(keepdims=True), (regs[0] < regs[1]).sum(keepdims=True)
    best, _ = setsketch.joint(above, below, 512 - above - below, np.array([float(n)]), np.array([float(n)]), 0.8)
    assert abs(best[0] - share) < 0.08
    merged = setsketch.registers(np.unique(sets), np.array([0, len(np.unique(sets))]), 512)
    assert (merged[0] == np.maximum(regs[0], regs[1])).all()


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = ["", None, "Äb c d", "a\x0bb", "end ", " x", "A a"]
    for block in textblocks.blocks(pa.array(texts)):
        assert np.diff(block.words).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
        h = block.hashes()
        assert h[-1] == h[-2] and len(set(h.tolist())) == len(h) - 1 - 1 or len(pd.unique(h)) >= len(h) - 2


def test_rows_of_one_id_are_told_by_their_text(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long), (7, long + " more"), (7, "quite another text of several words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "a.b": F.lit(1)})
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([rows[0], rows[2]])
