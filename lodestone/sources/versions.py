"""Knowledge as a table of versions: deltas on a base, merged on read, with one atomic manifest a version.

An upsert writes what its changes come to, one row a key, beside what is there, and then the manifest of the next version, which
names the base and all deltas. A manifest comes into being whole, by a rename that fails if the version exists; a writer that
loses that race takes the version after. Data files are never changed, so a reader of an older version is not disturbed, and
what a failed writer left is named by no manifest. Compaction writes the merged rows as the base of a new version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "category string, key string, value string, metadata string, created_at long, updated_at long"
#: What a delta holds of a key: ``born`` is null if an earlier creation time stays; ``first`` is used if there is none.
DELTA = "category string, key string, gone boolean, value string, metadata string, born long, first long, at long"


def net(changes: DataFrame) -> DataFrame:
    """What changes (category, key, value, metadata, op, at, seq) come to, one row of ``DELTA`` a key, whatever was there before.

    ``add`` gives a new creation time, ``update`` keeps one that is there, ``delete`` removes; changes of a key count in order of
    ``seq``. A null category or key is a value like others; an unknown op counts as ``update``.
    """
    op = F.coalesce("op", F.lit("update"))
    rows = changes.select("category", "key", "value", "metadata", op.alias("op"), F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"))
    by = ["category", "key"]
    last = F.max_by(F.struct("op", "value", "metadata", "at"), "seq").alias("last")
    cut, added = (F.max(F.when(F.col("op") == name, F.col("seq"))).alias(name) for name in ("delete", "add"))
    whole = rows.groupBy(*by).agg(last, cut, added, F.max_by(F.when(F.col("op") == "add", F.col("at")), F.when(F.col("op") == "add", F.col("seq"))).alias("added_at"), F.min_by("at", "seq").alias("first"))
    # behind a delete without a later add the first change after it creates the key
    open_ = whole.where("`delete` is not null and last.op <> 'delete' and coalesce(`add` < `delete`, true)").select(*(F.col(c).alias(f"_{c}") for c in by), F.col("delete").alias("_cut"))
    same = rows["category"].eqNullSafe(F.col("_category")) & rows["key"].eqNullSafe(F.col("_key"))
    again = rows.join(open_, same).where("seq > _cut").groupBy("_category", "_key").agg(F.min_by("at", "seq").alias("again"))
    both = whole.join(again, whole["category"].eqNullSafe(F.col("_category")) & whole["key"].eqNullSafe(F.col("_key")), "left")
    return both.select(*by, (F.col("last.op") == "delete").alias("gone"), "last.value", "last.metadata", F.coalesce("again", "added_at").alias("born"), "first", "last.at")


class VersionedTable:
    """Knowledge rows (``ROWS``) under a folder of any Hadoop store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.fs, self.conf = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self.store = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def version(self) -> int:
        """The newest version; -1 if there is none."""
        log = self._at("log")
        names = [s.getPath().getName() for s in self.store.listStatus(log)] if self.store.exists(log) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] not in "._"), default=-1)

    def manifest(self, version: int) -> dict:
        if version < 0:
            return {"base": None, "deltas": []}
        stream = self.store.open(self._at(f"log/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, manifest: dict) -> bool:
        """Makes a version visible; False if another writer made it first."""
        new, done = self._at(f"log/_{uuid.uuid4().hex}"), self._at(f"log/{version:020d}.json")
        out = self.store.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(self.fs.Options.Rename, 0)
        try:
            self.fs.FileContext.getFileContext(self.store.getUri(), self.conf).rename(new, done, plain)
        except Exception as e:  # noqa: BLE001  the JVM's exception tells whether the version exists
            self.store.delete(new, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def read(self, version: int | None = None) -> DataFrame:
        """The merged rows of a version, the newest by default."""
        held = self.manifest(self.version() if version is None else version)
        if not held["deltas"]:
            return self.spark.read.schema(ROWS).parquet(f"{self.path}/{held['base']}") if held["base"] else self.spark.createDataFrame([], ROWS)
        parts = [self.spark.read.schema(DELTA).parquet(f"{self.path}/{d}").withColumn("n", F.lit(i)) for i, d in enumerate(held["deltas"])]
        if held["base"]:
            base = self.spark.read.schema(ROWS).parquet(f"{self.path}/{held['base']}")
            parts.insert(0, base.select("category", "key", F.lit(False).alias("gone"), "value", "metadata", F.col("created_at").alias("born"), F.col("created_at").alias("first"), F.col("updated_at").alias("at"), F.lit(-1).alias("n")))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        # a key has one row a delta at most, so what meets here is bounded by the number of deltas
        steps = F.array_sort(F.collect_list(F.struct("n", "gone", "value", "metadata", "born", "first", "at"))).alias("s")
        born = F.aggregate("s", F.lit(None).cast("long"), lambda b, s: F.when(s["gone"], F.lit(None).cast("long")).otherwise(F.coalesce(s["born"], b, s["first"])))
        last = F.element_at("s", -1)
        merged = rows.groupBy("category", "key").agg(steps).where(~last["gone"])
        return merged.select("category", "key", last["value"].alias("value"), last["metadata"].alias("metadata"), born.alias("created_at"), last["at"].alias("updated_at"))

    def _written(self, rows: DataFrame, kind: str) -> str:
        name = f"data/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def create(self, rows: DataFrame) -> int:
        """The first version, with these rows; an error if the table exists."""
        if not self.commit(0, {"base": self._written(rows.select("category", "key", "value", "metadata", F.col("created_at").cast("long").alias("created_at"), F.col("updated_at").cast("long").alias("updated_at")), "base"), "deltas": []}):
            raise ValueError(f"{self.path} is a table already")
        return 0

    def upsert(self, changes: DataFrame, most_deltas: int = 16) -> int:
        """Adds the changes as a new version, and its number; a table of more deltas than ``most_deltas`` is compacted afterwards."""
        name = self._written(net(changes), "delta")
        while True:
            version = self.version()
            held = self.manifest(version)
            if self.commit(version + 1, held | {"deltas": [*held["deltas"], name]}):
                return self.compact() if len(held["deltas"]) >= most_deltas else version + 1

    def compact(self) -> int:
        """A new version whose base has the merged rows; deltas that came meanwhile stay deltas."""
        version = self.version()
        held, base = self.manifest(version), self._written(self.read(version), "base")
        while True:
            now = self.version()
            more = self.manifest(now)
            if more["base"] != held["base"] or more["deltas"][: len(held["deltas"])] != held["deltas"]:
                return now  # another compaction came first
            if self.commit(now + 1, {"base": base, "deltas": more["deltas"][len(held["deltas"]) :]}):
                return now + 1
