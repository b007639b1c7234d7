"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The temporary folder of a local session, by application.
_LOCAL: dict[str, str] = {}
#: The tables that open scopes have seen written.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session without one has a temporary folder;
    on a cluster, whose executors could not see that, the setting is needed."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _LOCAL[context.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for one table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """A scope at whose end the tables that were written in it are deleted. What an operator returns
    reads some of them, so its result has to be written elsewhere before the scope ends."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, so that later jobs do not
    depend on the executors that made it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that more than this share of the rows have are joined beside a broadcast, which has
#: 1 / HOT_SHARE rows at most.
HOT_SHARE = 0.001


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The inner join of ``rows`` with ``groups``, a written table of one row for each key whose
    column ``n`` says how many rows have it. No task gets more than HOT_SHARE of them for one key."""
    least = HOT_SHARE * (groups.agg(F.sum(n)).first()[0] or 0)
    hot = groups.filter(F.col(n) >= least)
    if least < 1000 or hot.isEmpty():
        return rows.join(groups, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col(n) < least), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, so that names used on the way cannot clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The columns of ``row`` and then those of ``added``; an added column replaces an input
    column of the same name (whatever its case)."""
    taken = {c.lower() for c in added}
    kept = [F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *added)
