"""A log file gives the same blocks however it is cut into ranges."""

import bz2

import pytest

from ridgeline.operators import sessions

LOG = "noise before\n<host-a>display version\nVersion 1\r\n\n2024-01-02-03:04:05.host text\n2024-01-02-03:04:05.<host-a>display clock\n" + "".join(f"line {i}\n" for i in range(40)) + "bob@edge-1> show route\n0.0.0.0/0\n \t\ncore#show run\n<host-a>quit"


@pytest.mark.parametrize("size", [7, 50, 333, 1 << 20])
def test_any_split_gives_equal_blocks(spark, tmp_path, size):
    for name in ("a", "b"):
        (tmp_path / f"{name}.log").write_bytes(LOG.encode())
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = sessions.split_ranges(spark, str(tmp_path))
        got = sorted((r.block_no, r.hostname, r.vendor, r.command, r.output, str(r.captured_at)) for r in found.collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    whole = spark.createDataFrame([("f", LOG)], "file string, content string")
    want = [(r.block_no, r.hostname, r.vendor, r.command, r.output, str(r.captured_at)) for r in sessions.split_log(whole, "content", ["file"]).collect()]
    assert got == sorted(want * 2) and len(want) == 5


def test_ranges_of_packed_logs(spark, tmp_path):
    """bzip2 packs 900 kB at a time: a range begins where one of these does, within a line."""
    log = "before\r\n" + "".join(f"<host-{b}>display clock\n" + "".join(f"{b} {i * 7919 % 10007}\n" for i in range(n)) for b, n in enumerate((3, 400_000, 0, 5, 90_000)))
    (tmp_path / "a.log.bz2").write_bytes(bz2.compress(log.encode()))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
        got = sorted((r.block_no, r.hostname, r.output) for r in sessions.split_ranges(spark, str(tmp_path)).collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    whole = spark.createDataFrame([("f", log)], "file string, content string")
    assert got == sorted((r.block_no, r.hostname, r.output) for r in sessions.split_log(whole, "content", ["file"]).collect())
    assert read > 2 and [len(o) for *_, o in got][2] == 0
