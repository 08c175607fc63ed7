"""Incremental ingestion of session logs with Structured Streaming (STR-01, STR-02, SRC-02).

Files arrive as pieces of a log: a path, the offset of the piece in bytes, and its text. The state of
a path is the offset reached, the bytes behind the last prompt, pieces that came before the ones they
follow, and how the log begins. A block is given out when the next prompt shows that it is complete.
A whole log that is shorter than what was read, or a piece at 0 that begins otherwise, means that
the file was rotated: it is read from its start. What was read already is left out.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ridgeline.operators import sessions
from ridgeline.operators.merge import newer_wins

#: Bytes of a log's beginning by which a rotated file is told.
HEAD = 1024


def logs(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """path, offset, text (bytes), whole of files that appear in a folder: landed pieces of logs named <log>.<offset>, or whole logs (SRC-03, SRC-04)."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger).load(folder)
    part = F.regexp_extract("path", r"\.(\d+)$", 1)
    return rows.select(F.when(part != "", F.regexp_replace("path", r"\.\d+$", "")).otherwise(F.col("path")).alias("path"), F.coalesce(part.try_cast("long"), F.lit(0)).alias("offset"), F.col("content").alias("text"), (part == "").alias("whole"))


def is_prompt(line: str) -> bool:
    line = re.sub(sessions.LOOSE_STAMP, "", line.rstrip("\r \t"))
    for patterns in sessions.PROMPTS.values():
        for p in patterns:
            m = re.match(p, line)
            if m and re.sub(r"^[^>#\]]*[>#\]]", "", line[m.start(1) + len(m[1]) :], count=1).strip():
                return True
    return False


class Log:
    """What is known of one log."""

    def __init__(self, reached: int = 0, seq: int = 0, tail: bytes = b"", head: bytes = b"", waiting: str = "{}"):
        self.reached, self.seq, self.tail, self.head = reached, seq, tail, head
        self.waiting = {int(k): base64.b64decode(v) for k, v in json.loads(waiting).items()}

    def add(self, offset: int, data: bytes, whole: bool = False) -> None:
        """Takes a piece, or a whole log, and pieces that waited for it."""
        short = len(data) < (self.reached if whole else len(self.head))
        if offset == 0 and self.reached and (short or not data.startswith(self.head[: len(data)])):
            self.__init__(seq=self.seq)  # rotated
        if len(data) > len(self.waiting.get(offset, b"")):
            self.waiting[offset] = data
        while ready := [k for k in self.waiting if k <= self.reached]:
            for k in sorted(ready):
                fresh = self.waiting.pop(k)[self.reached - k :]
                if len(self.head) < HEAD:
                    self.head += fresh[: HEAD - len(self.head)]
                self.tail, self.reached = self.tail + fresh, self.reached + len(fresh)

    def skip(self, offset: int) -> None:
        """Leaves out what is missing up to an offset: the block that it cuts through is given up, and reading goes on at the next prompt."""
        lines = self.tail.split(b"\n")
        at = [i for i, x in enumerate(lines[:-1]) if is_prompt(x.decode(errors="replace"))]
        self.tail = b"\n".join(lines[: at[-1]]) + b"\n" if at else b""
        self.reached = offset

    def complete(self) -> str:
        """The text from the first prompt to the last, which stays. The last line may be unfinished."""
        lines = self.tail.split(b"\n")
        at = [i for i, x in enumerate(lines[:-1]) if is_prompt(x.decode(errors="replace"))]
        if len(at) < 2:
            return ""
        self.tail, self.seq = b"\n".join(lines[at[-1] :]), self.seq + 1
        return b"\n".join(lines[at[0] : at[-1]]).decode(errors="replace")

    def state(self) -> tuple:
        return self.reached, self.seq, self.tail, self.head, json.dumps({k: base64.b64encode(v).decode() for k, v in self.waiting.items()})


def plain(pieces: DataFrame) -> DataFrame:
    """path, offset, data, whole of pieces: path, offset, text, and whole if they tell."""
    whole = F.coalesce("whole", F.lit(False)) if "whole" in pieces.columns else F.lit(False)
    return pieces.select("path", "offset", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"), whole.alias("whole"))


def complete_text(pieces: DataFrame) -> DataFrame:
    """path, seq, text: for each micro-batch the part of a log up to its last prompt, beginning with a prompt.

    What is behind the last prompt stays in the state of its path, as do pieces beyond a gap, until
    it closes. Prompts are found by the same patterns as in a batch.
    """

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = Log(*state.get) if state.exists else Log()
        for row in pd.concat(list(frames)).sort_values("offset").itertuples():
            log.add(row.offset, bytes(row.data), bool(row.whole))
        seq, out = log.seq, log.complete()
        state.update(log.state())
        if out:
            yield pd.DataFrame({"path": [key[0]], "seq": [seq], "text": [out]})

    return plain(pieces).groupBy("path").applyInPandasWithState(step, "path string, seq long, text string", "reached long, seq long, tail binary, head binary, waiting string", "append", GroupStateTimeout.NoTimeout)


def blocks(pieces: DataFrame) -> DataFrame:
    """path, seq, block_no and the complete blocks, classified, of a stream of pieces."""
    return sessions.classified(sessions.split_log(complete_text(pieces), "text", ["path", "seq"]))


def upserting(target: str, keys: list[str], updated: str, seq: str, buckets: int = 64):
    """A foreachBatch function that folds a batch into a table kept in buckets by key (STR-05, UPS-09).

    Only buckets that the batch touches are written anew, each under a name of its own; then one
    manifest, numbered after the last, names the current folder of every bucket. So a new checkpoint
    goes on from what is stored, readers see whole versions, and a batch that is run again does no
    harm, as newer_wins() of the same rows changes nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema, bucket = batch.schema, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch = batch.withColumn("bucket", bucket).persist()
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # buckets at most
        if touched:
            last, folders = _manifest(spark, target)
            own = [folders[b] for b in touched if b in folders]
            stored = spark.read.schema(schema).parquet(*own).withColumn("bucket", bucket) if own else batch.limit(0)
            fresh = f"data/{uuid.uuid4().hex}"
            newer_wins(stored.select(batch.columns), batch, ["bucket", *keys], updated, seq).write.partitionBy("bucket").option("maxRecordsPerFile", 5_000_000).parquet(f"{target}/{fresh}")
            paths = folders | {b: f"{target}/{fresh}" for b in touched}
            rows = [(b, p.removeprefix(f"{target}/").split("/bucket=")[0]) for b, p in sorted(paths.items())]
            spark.createDataFrame(rows, "bucket int, folder string").coalesce(1).write.json(f"{target}/manifest/n={last + 1}")
        batch.unpersist()

    return fold


def _manifest(spark: SparkSession, target: str) -> tuple[int, dict[int, str]]:
    """Number of the newest whole manifest (0: none), and the folder of each bucket."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0, {}
    found = [s.getPath().getName() for s in files.listStatus(path) if files.exists(s.getPath().suffix("/_SUCCESS"))]
    if not found:
        return 0, {}
    last = max(int(name.removeprefix("n=")) for name in found)
    rows = spark.read.schema("bucket int, folder string").json(f"{target}/manifest/n={last}").collect()  # as many as buckets
    return last, {r.bucket: f"{target}/{r.folder}/bucket={r.bucket}" for r in rows}


def stored(spark: SparkSession, target: str, schema: str = "") -> DataFrame:
    """The current rows of a table that upserting() keeps; none, of that schema, before its first batch."""
    _, folders = _manifest(spark, target)
    return spark.read.parquet(*folders.values()) if folders else spark.createDataFrame([], schema)
