"""Rotated logs, quiet paths and gaps that stay open."""

import time

from ridgeline.streaming import ingest
from ridgeline.streaming.watch import quiet_text


def test_a_shorter_whole_log_is_read_from_its_start():
    banner = b"# " + b"=" * 1500 + b"\n"
    block = b"<host-a>display one\nrow\n"
    long, short = banner + block * 200, banner + b"<host-a>display new\nx\n<host-a>display end\n"
    log = ingest.Log()
    log.add(0, long, whole=True)
    log.complete()
    log.add(0, long + block, whole=True)
    assert log.reached == len(long) + len(block)
    log.complete()
    log.add(0, short, whole=True)
    assert "display new" in log.complete() and log.reached == len(short)
    log.add(0, short, whole=True)  # the same again
    assert log.complete() == "" and log.reached == len(short)


def test_quiet_paths_and_open_gaps(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = quiet_text(ingest.logs(spark, str(land)), quiet=1500, gap=4000)
    stream = seen.writeStream.format("memory").queryName("quiet_seen").option("checkpointLocation", str(tmp_path / "c")).start()
    got = lambda: {r.path.rsplit("/", 1)[-1]: r.text for r in spark.sql("SELECT * FROM quiet_seen").collect()}

    def land_file(name, data):
        (tmp_path / name).write_bytes(data)
        (tmp_path / name).rename(land / name)

    def wait(test):
        end = time.time() + 45
        while time.time() < end and not test():
            time.sleep(0.3)
        return test()

    try:
        first = b"<host-a>display one\nrow\n"
        land_file("a.0", first)
        land_file(f"a.{len(first)}", b"<host-a>display two\n")
        land_file("b.0", b"<host-b>display one\n1\n<host-b>display lost\n")
        land_file("b.900", b"half a line\n<host-b>display three\n3\n<host-b>display four\n")
        assert wait(lambda: got().get("a") == "<host-a>display one\nrow")
        assert wait(lambda: any("display three" in r.text for r in spark.sql("SELECT * FROM quiet_seen WHERE path LIKE '%/b'").collect()))
        texts = "\n".join(r.text for r in spark.sql("SELECT * FROM quiet_seen WHERE path LIKE '%/b' ORDER BY seq").collect())
        assert "display one" in texts and "display four" not in texts
    finally:
        stream.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
