"""Written intermediate tables, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Cuts lineage by writing: a lost executor costs the running stage only. The tables go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="lodestone-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def drop(self) -> None:
        """Removes the folder with all of its tables."""
        self.remove("")

    def remove(self, name: str) -> None:
        """Removes a table that is no longer read."""
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        try:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder's owner clears it
            return

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")


def resident(name: str, key, make):
    """A worker's own object, made once per process and key and kept between tasks; another key replaces it."""
    store = sys.__dict__.setdefault("_lodestone_core", {})
    if name not in store or store[name][0] != key:
        store[name] = (key, make())
    return store[name][1]
