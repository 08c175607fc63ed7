"""Tables in a folder that change together or not at all (UPS-06, UPS-09, QRY-02).

A table is kept in buckets by its keys. A change writes new files under a name of their own; then one
manifest, numbered after the last, names the files of every bucket of every table. It is put in
place by a rename that fails if another writer was first: then the change is made anew on what that
one left. So readers see whole versions, and what is aborted leaves every table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel


class Duplicate(ValueError):
    """A batch repeats a key, or has one that is stored."""


@dataclass
class Change:
    """What becomes of a table: rows are added to it, or take the place of the buckets `only` (None: of all).

    placed: each task's rows are few enough to be sorted in memory, and go to files of its own in every bucket without a shuffle.
    """

    table: str
    rows: DataFrame
    keys: tuple[str, ...]
    add: bool = True
    only: Iterable[int] | None = None
    unique: bool = False
    sort: tuple[str, ...] = ()
    placed: bool = False


@dataclass
class Version:
    """One version of all tables: the folders of each bucket, and notes."""

    store: Store
    number: int = 0
    tables: dict = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def read(self, table: str, schema: str | T.StructType | None = None, buckets: Iterable[int] | None = None, spark: SparkSession | None = None) -> DataFrame:
        """A table's rows, of some buckets or all; without any, an empty table of that schema."""
        spark, held = spark or self.store.spark, self.tables.get(table)
        kind = T.StructType.fromJson(json.loads(held["schema"])) if held else T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if kind is None:
            raise KeyError(table)
        wanted = None if buckets is None else {str(b) for b in buckets}
        folders = [f"{self.store.root}/{f}" for b, own in (held["buckets"].items() if held else ()) if wanted is None or b in wanted for f in own]
        return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


class Store:
    """Tables under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, *keys: str) -> list[int]:
        """The buckets of rows: as many as there are buckets at most."""
        return [r[0] for r in rows.select(self.bucket(*keys)).distinct().collect()]

    def current(self) -> Version:
        folder = self._path(f"{self.root}/manifest")
        if not self._files.exists(folder):
            return Version(self)
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        last = max((int(n) for n in names if n.isdigit()), default=0)
        return self.at(last) if last else Version(self)

    def at(self, number: int) -> Version:
        """A version that was (QRY-02)."""
        stream = self._files.open(self._path(f"{self.root}/manifest/{number:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Version(self, number, held["tables"], held["notes"])

    def _published(self, version: Version) -> bool:
        """Whether the manifest could be put in place; False: another writer has that number."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder, staged = self._path(f"{self.root}/manifest"), self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        self._files.mkdirs(folder)
        out = self._files.create(staged, False)
        out.write(bytearray(json.dumps({"tables": version.tables, "notes": version.notes}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf).rename(staged, self._path(f"{self.root}/manifest/{version.number:012d}"), options)
        except Exception as e:
            self._files.delete(staged, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def commit(self, change: Callable[[Version], tuple[list[Change], dict]]) -> Version:
        """Makes what `change` asks for of the current version, and notes, in one step. An exception leaves all tables as they were."""
        while True:
            base = self.current()
            changes, notes = change(base)
            staged = f"data/{uuid.uuid4().hex}"
            try:
                tables = {name: {"schema": t["schema"], "buckets": dict(t["buckets"])} for name, t in base.tables.items()}
                for c in changes:
                    self._stage(base, c, f"{staged}/{c.table}", tables)
                done = self._published(Version(self, base.number + 1, tables, base.notes | notes))
            except BaseException:
                self._files.delete(self._path(f"{self.root}/{staged}"), True)
                raise
            if done:
                return Version(self, base.number + 1, tables, base.notes | notes)
            self._files.delete(self._path(f"{self.root}/{staged}"), True)

    def _stage(self, base: Version, c: Change, folder: str, tables: dict) -> None:
        rows = c.rows.withColumn("bucket", self.bucket(*c.keys))
        rows = rows.persist(StorageLevel.DISK_ONLY) if c.unique else rows  # read twice
        if c.unique and not rows.groupBy(*c.keys).count().where("count > 1").isEmpty():
            raise Duplicate(f"rows of {c.table} repeat {', '.join(c.keys)}")
        dealt = rows if c.placed else rows.repartition("bucket")
        dealt.sortWithinPartitions("bucket", *c.sort).write.partitionBy("bucket").option("maxRecordsPerFile", 5_000_000).parquet(f"{self.root}/{folder}")
        if c.unique:
            rows.unpersist()
        made = self._path(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._files.listStatus(made)]
        new = {n.removeprefix("bucket="): f"{folder}/{n}" for n in names if n.startswith("bucket=")}
        held = tables.setdefault(c.table, {"schema": json.dumps(c.rows.schema.jsonValue()), "buckets": {}})
        if c.unique and c.add:
            stored = base.read(c.table, c.rows.schema, new)
            if not self.spark.read.parquet(*(f"{self.root}/{f}" for f in new.values())).select(*c.keys).join(stored.select(*c.keys), list(c.keys), "left_semi").isEmpty() if new else False:
                raise Duplicate(f"{c.table} has rows of the same {', '.join(c.keys)}")
        if not c.add:
            gone = set(held["buckets"]) if c.only is None else {str(b) for b in c.only}
            held["buckets"] = {b: own for b, own in held["buckets"].items() if b not in gone}
        for b, f in new.items():
            held["buckets"][b] = [*held["buckets"].get(b, []), f]

    def insert(self, batches: dict[str, tuple[DataFrame, list[str]]]) -> Version:
        """Adds rows to several tables, each with its keys, which must be new; one duplicate aborts all (UPS-06)."""
        return self.commit(lambda _: ([Change(name, rows, tuple(keys), unique=True) for name, (rows, keys) in batches.items()], {}))

    def upsert(self, table: str, rows: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Version:
        """Folds rows into a table; only the buckets that they touch are read and written (UPS-09)."""

        def change(base: Version) -> tuple[list[Change], dict]:
            buckets = self.touched(rows, *keys)
            return [Change(table, merge(base.read(table, rows.schema, buckets), rows), tuple(keys), add=False, only=buckets)], {}

        return self.commit(change)
