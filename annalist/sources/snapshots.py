"""Snapshots: tables exported with a manifest that proves them, read back, replayed, promoted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(rows: DataFrame, split: str, columns: list[str]) -> DataFrame:
    """Per split: rows and a digest of the named columns that does not depend on their order. Aggregated before the shuffle."""
    one = F.xxhash64(*(F.col(c).cast("string") for c in columns))
    return rows.groupBy(split).agg(F.count("*").alias("rows"), F.bit_xor(one).alias("digest"))


def export(rows: DataFrame, path: str, split: str, columns: list[str]) -> None:
    """Writes rows as JSON lines by split, and the manifest beside them."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(split).json(f"{path}/rows")
    manifest(rows, split, columns).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str, schema: str, split: str, columns: list[str]) -> DataFrame:
    """The rows of a snapshot; raises if they aren't what its manifest says."""
    rows = spark.read.schema(schema).json(f"{path}/rows")
    said = spark.read.schema(f"`{split}` string, rows bigint, digest bigint").json(f"{path}/manifest")
    now = manifest(rows, split, columns).select(F.col(split).cast("string").alias(split), "rows", "digest")
    if said.exceptAll(now).unionByName(now.exceptAll(said)).limit(1).count():
        raise ValueError(f"the snapshot {path} is not what its manifest says")
    return rows


def replayed(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """A snapshot without what was deleted since."""
    return rows.join(deleted.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An upsert: of the rows of a key the last by order; ties go to the new rows."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys and c != order]
    best = both.groupBy(*keys).agg(F.max(F.struct(order, "_new", *rest)).alias("_r"))
    return best.select(*keys, f"_r.{order}", *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*old.columns)


def moved_home(old: DataFrame, new: DataFrame, key: str, home: str) -> DataFrame:
    """New rows whose key already lives in another partition: an upsert must refuse them."""
    return new.join(old.select(key, F.col(home).alias("_home")), key).filter(~F.col(home).eqNullSafe(F.col("_home"))).drop("_home")


class VersionedTable:
    """Immutable versions of a table in one folder, with a pointer to the one that is read; built beside, then promoted."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def stage(self, rows: DataFrame) -> int:
        """Writes a new version that is not read yet."""
        n = (self.versions() or [0])[-1] + 1
        rows.write.mode("error").parquet(f"{self.path}/v={n}")
        return n

    def promote(self, version: int) -> None:
        """Lets readers see the version, by a marker that is created whole or not at all; markers are never changed."""
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        fs, path = self._fs()
        markers = self._markers()
        fs.create(path(f"{self.path}/promoted/{(markers or [(0, 0)])[-1][0] + 1}-{version}"), False).close()

    def _markers(self) -> list[tuple[int, int]]:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/promoted")):
            return []
        return sorted(tuple(map(int, s.getPath().getName().split("-"))) for s in fs.listStatus(path(f"{self.path}/promoted")))

    def current(self) -> int | None:
        markers = self._markers()
        return markers[-1][1] if markers else None

    def read(self, version: int | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise ValueError(f"{self.path} has no promoted version")
        return self.spark.read.parquet(f"{self.path}/v={version}")

    def collect_garbage(self, keep: int) -> list[int]:
        """Deletes all but the last versions and the one that is read; gives the deleted ones."""
        fs, path = self._fs()
        dead = [v for v in self.versions()[:-keep] if v != self.current()] if keep else []
        for v in dead:
            fs.delete(path(f"{self.path}/v={v}"), True)
        return dead
