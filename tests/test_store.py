"""Tables that change together, and the stored full-text index against a rebuilt one and a scan."""

import threading

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import search
from ridgeline.operators.index import Index, parsed
from ridgeline.operators.merge import newer_wins
from ridgeline.sources.store import Change, Duplicate, Store

ROWS = "k long, v string"


def _all(store, table):
    return sorted(tuple(r) for r in store.current().read(table, ROWS).select("k", "v").collect())


def test_a_duplicate_leaves_every_table_as_it_was(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), 4)
    rows = lambda *x: spark.createDataFrame(list(x), ROWS)
    assert _all(store, "a") == []
    store.insert({"a": (rows((1, "x"), (2, "y")), ["k"]), "b": (rows((1, "p")), ["k"])})
    for bad in ({"a": (rows((3, "z")), ["k"]), "b": (rows((1, "q")), ["k"])}, {"b": (rows((5, "q"), (5, "r")), ["k"]), "a": (rows((4, "w")), ["k"])}):
        with pytest.raises(Duplicate):
            store.insert(bad)
        assert _all(store, "a") == [(1, "x"), (2, "y")] and _all(store, "b") == [(1, "p")]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1  # what was staged is gone
    store.insert({"a": (rows((3, "z")), ["k"])})
    assert _all(store, "a") == [(1, "x"), (2, "y"), (3, "z")] and store.at(1).read("a").count() == 2


def test_a_writer_that_comes_second_looks_again(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "t"), 4), Store(spark, str(tmp_path / "t"), 4)
    store.insert({"a": (spark.createDataFrame([(1, "x")], ROWS), ["k"])})
    seen = []

    def slow(base):
        if not seen:  # another writer gets in between
            other.insert({"a": (spark.createDataFrame([(2, "first")], ROWS), ["k"])})
        seen.append(base.number)
        return [Change("a", spark.createDataFrame([(2, "second")], ROWS), ("k",), unique=True)], {}

    with pytest.raises(Duplicate):
        store.commit(slow)
    assert seen == [1, 2] and _all(store, "a") == [(1, "x"), (2, "first")]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    add = lambda i: Store(spark, root, 4).insert({"a": (spark.createDataFrame([(i, "v")], ROWS), ["k"])})
    threads = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert _all(Store(spark, root, 4), "a") == [(i, "v") for i in range(4)]


def test_upsert_writes_touched_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), 8)
    kind = "k long, v string, t int, s int"
    rows = lambda *x: spark.createDataFrame(list(x), kind)
    fold = lambda old, new: newer_wins(old, new, ["k"], "t", "s")
    store.upsert("a", rows(*((i, "old", 1, i) for i in range(20))), ["k"], fold)
    before = store.current().tables["a"]["buckets"]
    after = store.upsert("a", rows((3, "new", 2, 0), (4, "older", 0, 0)), ["k"], fold).tables["a"]["buckets"]
    got = {r.k: r.v for r in store.current().read("a").collect()}
    assert got == {i: "new" if i == 3 else "old" for i in range(20)}
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2


TEXTS = [(1, "The quick brown fox. The end"), (2, "quick quick brown"), (3, "A brown quick fox"), (4, None), (5, "foxes and quicksand, brown fox"), (6, "über quick-brown x")]


def test_index_follows_changes(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "id long, body string")
    one = Index(spark, str(tmp_path / "i"), 4)
    one.add(docs.where("id < 4"), "id", "body")
    one.add(docs.where("id >= 4"), "id", "body")
    one.add(spark.createDataFrame([(2, "the fox is slow"), (9, "brown brown fox")], "id long, body string"), "id", "body")
    one.delete(spark.createDataFrame([(1,), (77,)], "id long"), "id")
    now = spark.createDataFrame([(2, "the fox is slow"), (9, "brown brown fox"), *(t for t in TEXTS if t[0] in (3, 4, 5, 6))], "id long, body string")
    fresh = Index(spark, str(tmp_path / "j"), 4)
    fresh.add(now, "id", "body")
    for terms in (["fox"], ["Brown", "fox"], ["quick", "nothing"]):
        want = {r.id: pytest.approx(r.score) for r in search.bm25(now, "id", "body", terms).collect()}
        assert {r.doc: r.score for r in one.ranked(terms).collect()} == want == {r.doc: r.score for r in fresh.ranked(terms).collect()}
    for query in ("fox", '"brown fox"', "quick* NOT fox", 'quick OR "fox is"', "fo* brown", "quick-brown", '"brown quick" OR slow', "nothing"):
        want = {r.id for r in now.where(search.query_test(F.col("body"), query)).collect()}
        assert {r.doc for r in one.match(query).collect()} == want
    one.merge()
    assert one.store.current().read("gone").count() == 0
    assert {r.doc for r in one.match("fox").collect()} == {2, 3, 5, 9}


def test_queries_that_ask_for_nothing():
    with pytest.raises(ValueError):
        parsed("fox OR NOT quick")
    assert parsed('a "b c" NOT d* OR e') == [([(["a"], False), (["b", "c"], False)], [(["d"], True)]), ([(["e"], False)], [])]


def test_mentions_and_rules(spark, monkeypatch):
    from ridgeline.functions import mentions

    texts = spark.createDataFrame([(1, "The quick Fox"), (2, None), (3, ""), (4, "foxfox quick"), (4, "foxfox quick")], "id int, t string")
    names = spark.createDataFrame([("fox",), ("FOX",), ("quick f",), ("",), (None,), ("ox",)], "n string")
    want = {(1, "fox"), (1, "ox"), (1, "quick f"), (4, "fox"), (4, "ox")}
    for part in (1 << 22, 20):  # one automaton, and several
        monkeypatch.setattr(mentions, "PART", part)
        got = [tuple(r) for r in mentions.mentions(texts, ["id"], F.col("t"), names, "n").collect()]
        assert set(got) == want and len(got) == 7
    assert mentions.mentions(texts, ["id"], F.col("t"), names.limit(0), "n").count() == 0
    assert [mentions.factor(p) for p in ("(?i)abc+d", "x|yz", "a(bcd)?ef", "(hello) wor", "[ab]", "(?<!x)q", "a{2,}bc")] == ["ab", "", "ef", "hello", "", "q", "bc"]
    rules = spark.createDataFrame([(1, "v", "fox", "", None), (2, "v", "quick$", "m1", ""), (3, "v", "^.*o", "m1", "o$"), (4, "w", "fox", "", ""), (5, "v", None, "", "")], "id int, vendor string, content string, model string, os string")
    rows = spark.createDataFrame([(1, "v", "m1", "foo", "a fox"), (2, "v", "m1", "x", "fox quick"), (3, "v", None, None, None), (4, "u", "m1", "foo", "fox"), (5, "w", "", "", "a FOX")], "k int, vendor string, model string, os string, content string")
    got = {r.k: (r.rule, r.score) for r in mentions.best_rules(rows, ["k"], rules, "vendor", "model", "os", "content").collect()}
    assert got == {1: (3, 3), 2: (2, 2), 3: (5, 0), 4: (None, None), 5: (None, None)}
