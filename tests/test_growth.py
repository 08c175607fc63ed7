"""Steps whose rounds, passes or memory must not grow faster than their input."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from ridgeline.operators import devices, graph, index, outputs, reports, sessions
from ridgeline.session import checkpoint_dir


def jobs(spark, name, run):
    """What run() gives, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_cycles_of_long_rows_take_few_rounds(spark):
    # A circle of 60 that a row of 60 leads to and another leads from, and a circle of 60 by itself.
    row = [(i, i + 1) for i in range(179)] + [(119, 60)] + [(200 + i, 200 + (i + 1) % 60) for i in range(60)]
    df = spark.createDataFrame(row, "src long, dst long")
    found, n = jobs(spark, "cycles", lambda: sorted(r.node for r in graph.on_cycles(df).collect()))
    assert found == [*range(60, 120), *range(200, 260)]
    assert n < 350


def test_shortest_paths_within_a_number_of_edges(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    pairs = spark.createDataFrame([(0, 3), (0, 4), (1, 4), (4, 4), (4, 0)], "a long, b long")
    found = {(r.a, r.b): r.path for r in graph.shortest_paths(df, pairs, 3).collect()}
    assert found == {(0, 3): [0, 1, 2, 3], (0, 4): None, (1, 4): [1, 2, 3, 4], (4, 4): [4], (4, 0): None}


def test_each_log_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    logs = spark.createDataFrame([("a", "<ne-a>display ospf peer brief\n Area Id Interface\n 0.0.0.0 GE0/0/1 1.2.3.4 Full\n<ne-a>quit"), ("b", "#\nsysname lone\n#")], "file string, content string")
    facts = devices.ingest(logs.withColumn("content", read.asNondeterministic()("content")))
    assert [r.device_id for r in facts["devices"].orderBy("device_id").collect()] == ["lone", "ne-a"]
    facts["neighbors"].collect()
    assert seen.value == 2


def test_routes_are_read_in_time_that_grows_with_lines(spark):
    text = "\n".join(["1.0.0.0/8 OSPF 10 1 D 9.9.9.9 GE1"] + [x for v in range(3) for x in [f"Routing Tables: {('Public', 'RED', 'BLUE')[v]}", *["10.0.0.0/8 Static 60 0 RD 1.1.1.1 GE0"] * 20000]])
    started = time.monotonic()
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(outputs.huawei_routes(F.col("t"))).alias("r")).groupBy("r.vrf").count().collect()
    assert {r.vrf: r["count"] for r in rows} == {"default": 20001, "RED": 20000, "BLUE": 20000}
    assert time.monotonic() - started < 60


def test_scripts_go_out_in_pieces(spark):
    assert reports.CHUNK <= 1 << 20
    df = spark.createDataFrame([(None, "a\nb", "b\nc"), (2, None, "q")], "k long, o string, n string")
    rows = sorted((r.k or 0, r.pos, r.sign, r.line) for r in reports.sequence_difference(df, ["k"], "o", "n").collect())
    assert rows == [(0, 0, "-", "a"), (0, 1, " ", "b"), (0, 2, "+", "c"), (2, 0, "-", ""), (2, 1, "+", "q")]


def shuffled(spark):
    """Rows that stages have shuffled so far."""
    sc = spark.sparkContext
    spark._jvm.java.lang.Thread.sleep(500)  # the listener's last events
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def words_index(spark, root):
    """An index of 40 documents of 500 words in tasks of some documents each, ten of them replaced and one deleted; the texts; the rows shuffled for it."""
    texts = [(i, " ".join(f"w{(i * 7 + j * j) % 311}" for j in range(500))) for i in range(40)]
    docs = spark.createDataFrame(texts, "id long, body string")
    held = index.Index(spark, str(root / "i"), 4)
    before = shuffled(spark)
    held.add(docs.where("id < 30"), "id", "body")
    held.add(docs.where("id >= 20"), "id", "body")
    held.delete(docs.where("id = 5"), "id")
    return held, dict(texts), shuffled(spark) - before


def test_an_index_shuffles_documents_not_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "WORDS", 4000, raising=False)
    held, texts, moved = words_index(spark, tmp_path)
    assert moved < 1000  # of 25,000 words
    rows = held.store.current().read("postings").collect()
    want = {(i, w, 1 + later): [j for j, x in enumerate(t.split()) if x == w] for i, t in texts.items() for later in (False, True) if (i >= 20 if later else i < 30) for w in set(t.split())}
    assert {(r.doc, r.term, r.part): r.places for r in rows} == want and len(rows) == len(want)
    assert all(r.tf == len(r.places) and r.len == 500 for r in rows)
    assert len(list((tmp_path / "i").glob("data/*/postings/bucket=0/*.parquet"))) > 2  # tasks that hold few words


def test_an_index_of_nothing(spark, tmp_path):
    held = index.Index(spark, str(tmp_path / "i"), 4)
    held.add(spark.createDataFrame([(1, None), (2, " - ")], "id long, body string"), "id", "body")
    held.merge()
    assert held.match("fox").count() == 0 and held.store.current().notes == {"n": 2, "total": 0}


def test_a_merge_shuffles_no_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "WORDS", 4000, raising=False)
    held, texts, _ = words_index(spark, tmp_path)
    before = shuffled(spark)
    held.merge()
    assert shuffled(spark) - before < 1000
    now = held.store.current()
    want = {(i, w): 1 + (i >= 20) for i, t in texts.items() if i != 5 for w in set(t.split())}
    assert {(r.doc, r.term): r.part for r in now.read("postings").collect()} == want and now.read("gone").count() == 0
    for own in now.tables["postings"]["buckets"].values():
        files = [f for x in own for f in (tmp_path / "i" / x).glob("*.parquet")]
        seen = [(r.term, r.doc) for r in spark.read.parquet(str(files[0])).collect()]
        assert len(files) == 1 and seen == sorted(seen)  # small files become one


def test_only_ends_of_a_logs_ranges_are_shuffled_and_its_lines_are_kept_packed(spark, tmp_path):
    log = "".join(f"<host-a>display clock\n{'a line of the output\n' * 500}" for _ in range(60))
    (tmp_path / "a.log").write_text(log)
    held = lambda: sum(p.stat().st_size for p in Path(checkpoint_dir(spark).removeprefix("file:")).rglob("*") if p.is_file())
    rows, size = shuffled(spark), held()
    assert sorted(r.block_no for r in sessions.split_ranges(spark, str(tmp_path)).collect()) == list(range(60))
    assert shuffled(spark) - rows < 1000 and held() - size < len(log) / 4
