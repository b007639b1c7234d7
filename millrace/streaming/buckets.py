"""A table in key buckets, of which a merge rewrites those that it touches.

The rows of a bucket (a hash of the key) lie in a folder of their own, and a manifest, one small file
for each version, names the folder of each bucket. A merge reads and writes the buckets of the
incoming rows; a new manifest, put in its place by one rename, makes them the table. So readers see
one version or the next, files of other buckets stay as they are, and what a merge that was lost
wrote is in no manifest and is written over by the next attempt. A table has one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import merge
from millrace.streaming.jobs import names

_BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketTable:
    """The table under ``path``, with ``count`` buckets of its ``key``. Keys are unique, so buckets are about
    even; a bucket is written by one task, so ``count`` grows with the table (some 100 MB each). The
    driver holds one name for each bucket."""

    path: str
    key: str
    count: int = 256

    def bucket(self) -> Column:
        """The bucket of a row; rows with a null key have one as well."""
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.count)).cast("int")

    def versions(self, spark: SparkSession) -> list[int]:
        found = names(spark, f"{self.path}/manifests")
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and n[0].isdigit())

    def _manifest(self, spark: SparkSession, version: int) -> dict:
        text = spark.read.option("wholetext", True).text(f"{self.path}/manifests/{version}.json").first()[0]
        found = json.loads(text)
        if found["count"] != self.count or found["key"] != self.key:
            raise ValueError(f"{self.path} has {found['count']} buckets of {found['key']}")
        return found

    def _commit(self, spark: SparkSession, version: int, folders: dict[str, str], schema: StructType) -> None:
        made = {"count": self.count, "key": self.key, "schema": schema.jsonValue(), "folders": folders}
        hadoop = spark._jvm.org.apache.hadoop.fs
        put, place = (hadoop.Path(f"{self.path}/manifests/{n}") for n in (f"_{uuid.uuid4().hex}", f"{version}.json"))
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        out = store.create(put)
        out.write(json.dumps(made).encode())
        out.close()
        if store.exists(place) or not store.rename(put, place):
            raise ValueError(f"version {version} of {self.path} is there already")

    def _folders(self, spark: SparkSession, folders: list[str], schema: StructType) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, df: DataFrame, version: int) -> dict[str, str]:
        """The rows by bucket, and the folder of each bucket that has rows."""
        to = f"v{version}"
        by_bucket = df.withColumn(_BUCKET, self.bucket()).repartition(_BUCKET)
        by_bucket.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/{to}")
        made = [n for n in names(df.sparkSession, f"{self.path}/{to}") if n.startswith(f"{_BUCKET}=")]
        return {n.partition("=")[2]: f"{to}/{n}" for n in made}

    def create(self, df: DataFrame) -> None:
        """Version 0 of a table that isn't there yet."""
        if self.versions(df.sparkSession):
            raise ValueError(f"{self.path} is there already")
        self._commit(df.sparkSession, 0, self._write(df, 0), df.schema)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The newest version, or an older one."""
        found = self._manifest(spark, self.versions(spark)[-1] if version is None else version)
        return self._folders(spark, [*found["folders"].values()], StructType.fromJson(found["schema"]))

    def merge(self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> list[int]:
        """Version ``version`` out of the one before it: ``combine`` gives the new rows out of the stored ones of the
        buckets touched and the incoming ones. Returns the buckets touched. A version that is there already stays as it is."""
        spark = incoming.sparkSession
        if version in self.versions(spark):
            return []
        before = self._manifest(spark, version - 1)
        schema = StructType.fromJson(before["schema"])
        touched = sorted(r[0] for r in incoming.select(self.bucket()).distinct().collect())  # ``count`` at most
        folders = dict(before["folders"])
        if touched:
            stored = self._folders(spark, [folders.pop(str(b)) for b in touched if str(b) in folders], schema)
            folders |= self._write(combine(stored, incoming).select(*[f"`{c}`" for c in schema.names]), version)
        self._commit(spark, version, folders, schema)
        return touched


def bucket_sink(table: BucketTable, rules: merge.Ownership, newest: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges batch n into the table as version n + 1. Of a key's rows in a
    batch the one with the greatest ``newest`` counts. A batch that runs again changes nothing once
    its version is there."""

    def combine(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        return merge.ownership_merge(stored, incoming, rules)

    def merge_batch(batch: DataFrame, number: int) -> None:
        row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in batch.columns]), F.col(newest)).alias("row")
        last = batch.filter(F.col(rules.key).isNotNull()).groupBy(rules.key).agg(row).select("row.*")
        table.merge(last, combine, number + 1)

    return merge_batch
