"""The corpus pipeline: each stage against a brute-force version of what it does to its own input."""

import re

import numpy as np
from pyspark.sql import functions as F
from test_llm_operators import ODD, repeated_by_hand
from test_near_dedup import brute

import corpus_pipeline
from ridgeline.llm import mixing, packing

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs.collect()
    before, rows = seen["language_id"]
    assert len(rows) > 0.95 * len(before) and all(r.asDict() == before[r.doc_id] for r in rows)
    before, rows = seen["line_dedup"]
    want = repeated_by_hand(sorted((i, r["text"]) for i, r in before.items()), 51)
    assert {r.doc_id: r.text for r in rows} == {i: t for i, t in want.items() if t == before[i]["text"] or t.strip()}
    assert all(r.n_chars == len(r.text) for r in rows)
    before, rows = seen["near_dedup"]
    want = {i for i, (_, _, kept) in brute([(i, r["text"]) for i, r in before.items()], 5, 80).items() if kept}
    assert sorted(r.doc_id for r in rows) == sorted(want)
    before, rows = seen["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame([(i, r["source"], r["text"]) for i, r in before.items()], "doc_id long, source string, text string")).collect()}
    words = {}
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert before[r.doc_id]["text"].startswith(r.text) and r.source == before[r.doc_id]["source"]
    assert words == {i: n for i, n in taken.items() if n}
    encode, total = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json")), {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + len(encode.encode(r.text, add_special_tokens=False).ids) + 1
    _, pieces = seen["packing"]
    packed = {}
    for p in pieces:
        packed[p.doc_id] = packed.get(p.doc_id, 0) + p.length
    assert packed == total


def test_odd_rows_and_columns(spark, tmp_path):
    names = ("accepted", "language", "lines_deleted", "_host", "row", "hash", "kept", "node", "size", "rate", "copies")
    text = "es war einmal ein kleines haus am see und alle waren froh "
    odd = ODD + [(20 + i, f"{text * 3} {i}") for i in range(12)] + [(40, text * 20), (40, text * 20)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.lit("de"), "source": F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)), "n_chars": F.length("text").cast("long"), **{c: F.lit(c) for c in names}})
    for part in (docs.repartition(3), docs.limit(0)):
        (tmp_path / str(part.count())).mkdir()
        part.write.parquet(f"{tmp_path}/{part.count()}/documents.parquet")
        at = spark.read.parquet(f"{tmp_path}/{part.count()}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, SF)
            assert out.columns == docs.columns
            rows = out.collect()
            assert all(r[c] == c for r in rows for c in names), name
            assert not rows or name != "language_id" or all(r.text and r.text.strip() for r in rows)
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{part.count()}")
        assert set(pieces.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"} and (pieces.count() > 0) == (part.count() > 0)
    assert np.all([len(s) == 2 for s in corpus_pipeline.STAGES])
