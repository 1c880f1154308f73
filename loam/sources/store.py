"""A table of rows with a key that changes: Parquet files by bucket of the key, and manifests that say which files hold.

A change reads and rewrites the buckets of its keys only; files of other buckets stay the files that they were. Once
all new files are written, one manifest with the next number makes them hold, so readers see a change as a whole or not
at all, and an earlier version stays readable. Two writers can't both write the same number: the later one fails and
may try again. Files and manifests lie in one folder of any store that Spark's Hadoop paths reach.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.records import changed, inserted


class StoredTable:
    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        """The table in a folder at its last version, or at an earlier one."""
        self.spark, self.path = spark, path
        self.version = self._last() if version is None else version
        self.manifest = json.loads(self._read(self._manifest_path(self.version)))
        self.schema, self.key, self.buckets = StructType.fromJson(self.manifest["schema"]), self.manifest["key"], self.manifest["buckets"]

    @classmethod
    def created(cls, rows: DataFrame, path: str, key: str = "id", buckets: int = 64) -> StoredTable:
        """A table of rows, whose keys are unique, in a new folder. Rows without a key are in it, too, and no change finds them."""
        empty = {"schema": json.loads(rows.schema.json()), "key": key, "buckets": buckets, "files": {}}
        first = cls.__new__(cls)
        first.spark, first.path, first.version, first.manifest, first.schema, first.key, first.buckets = rows.sparkSession, path, -1, empty, rows.schema, key, buckets
        return first._committed(rows, list(range(buckets)))

    # Paths of any Hadoop file system.
    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _versions(self) -> list[int]:
        at, fs = self._fs(f"{self.path}/manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))

    def _last(self) -> int:
        return self._versions()[-1]

    def _read(self, path: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())

    def _write_new(self, path: str, text: str) -> None:
        """Writes a file that must not be there yet."""
        at, fs = self._fs(path)
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()

    def bucket(self, key: Column) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(key), F.lit(self.buckets)), F.lit(0)).cast("int")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        files = [f"{self.path}/{f}" for b, own in self.manifest["files"].items() if buckets is None or int(b) in set(buckets) for f in own]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def _committed(self, rows: DataFrame, buckets: list[int]) -> StoredTable:
        """The next version, in which rows are what these buckets hold."""
        name = f"data/{self.version + 1:012d}-{uuid.uuid4().hex}"
        dealt = rows.select(*self.schema.names).withColumn("__bucket", self.bucket(F.col(self.key)))
        dealt.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        files = {b: own for b, own in self.manifest["files"].items() if int(b) not in set(buckets)}
        at, fs = self._fs(f"{self.path}/{name}")
        for folder in fs.listStatus(at):
            if folder.isDirectory():
                own = [f"{name}/{folder.getPath().getName()}/{f.getPath().getName()}" for f in fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
                files[folder.getPath().getName().partition("=")[2]] = sorted(own)
        self._write_new(self._manifest_path(self.version + 1), json.dumps(self.manifest | {"files": files}))
        return StoredTable(self.spark, self.path, self.version + 1)

    def _touched(self, keys: DataFrame) -> list[int]:
        """The buckets of keys: `buckets` at most."""
        return [r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect()]

    def replaced(self, gone: DataFrame, fresh: DataFrame | None = None) -> StoredTable:
        """The next version: without the rows whose key is in gone (one column), with the rows of fresh, as one change."""
        keys = gone.select(self.key)
        buckets = self._touched(keys if fresh is None else keys.union(fresh.select(self.key)))
        left = self.rows(buckets).join(keys, self.key, "left_anti").select(*self.schema.names)
        return self._committed(left if fresh is None else left.unionByName(fresh.select(*self.schema.names)), buckets)

    def inserted(self, fresh: DataFrame, now: Column) -> StoredTable:
        """With fresh rows; see records.inserted."""
        buckets = self._touched(fresh)
        return self._committed(inserted(self.rows(buckets), fresh, now), buckets)

    def upserted(self, fresh: DataFrame) -> StoredTable:
        """With fresh rows in place of those of their keys."""
        return self.replaced(fresh.select(self.key), fresh)

    def changed(self, changes: DataFrame) -> StoredTable:
        """With the columns of changes where their keys are; see records.changed."""
        buckets = self._touched(changes)
        return self._committed(changed(self.rows(buckets), changes, self.key), buckets)

    def deleted(self, keys: DataFrame) -> StoredTable:
        return self.replaced(keys)

    def deleted_where(self, test: Column) -> StoredTable:
        """Without the rows that pass the test (null: they stay); only buckets that hold one are rewritten."""
        rows = self.rows().filter(test)
        buckets = self._touched(rows)
        return self._committed(self.rows(buckets).filter(~F.coalesce(test, F.lit(False))), buckets)

    def vacuumed(self, keep: int = 2) -> int:
        """Deletes the manifests before the last `keep` and the files that no manifest names then; gives the number of files."""
        versions = self._versions()
        held = {f for v in versions[-keep:] for own in json.loads(self._read(self._manifest_path(v)))["files"].values() for f in own}
        old = {f for v in versions[:-keep] for own in json.loads(self._read(self._manifest_path(v)))["files"].values() for f in own} - held
        for v in versions[:-keep]:
            at, fs = self._fs(self._manifest_path(v))
            fs.delete(at, False)
        for f in old:
            at, fs = self._fs(f"{self.path}/{f}")
            fs.delete(at, False)
        return len(old)


def reingest(memories: StoredTable, pages: StoredTable, fresh: DataFrame, label: str, next_id: int, built) -> tuple[StoredTable, StoredTable]:
    """(memories, pages) after pages (url, content) of the source `label` came again, each changed in one step.

    memories: id, source, content; pages, by url: url, content_hash. built: gives source, place and content of what
    changed pages become (see upkeep.section_rows). Ids go on from next_id.
    """
    from ..operators.curation import with_status
    from ..operators.ranks import places

    hashed = fresh.select("url", "content", F.sha2("content", 256).alias("content_hash"))
    open_ = with_status(hashed, pages.rows()).filter("status <> 'unchanged'").checkpoint()
    rows = built(open_.select(F.concat(F.lit(f"{label}|"), F.col("url")).alias("source"), "content"))
    numbered = places(rows, [], [F.col("source"), F.col("place")], "number").select((F.col("number") + F.lit(next_id - 1)).cast("bigint").alias("id"), "source", "content").checkpoint()
    gone = memories.rows().join(open_.select(F.concat(F.lit(f"{label}|"), F.col("url")).alias("source")), "source", "left_semi").select(memories.key)
    recorded = open_.join(numbered.select(F.substring("source", len(label) + 2, 1 << 30).alias("url")).distinct(), "url", "left_semi").select("url", "content_hash")
    return memories.replaced(gone, numbered), pages.upserted(recorded)
