"""Small column and DataFrame helpers shared by the operators."""
from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROUND = ["match_id", "round_id", "round_number"]
_SOURCE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ratio(n: Column, d: Column) -> Column:
    """n / d, NULL when d is not positive."""
    return F.when(d > 0, n / d)


def percentage(n: Column, d: Column) -> Column:
    return F.when(d > 0, n * 100.0 / d)


def truth(c: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(c, F.lit(False))


def flag(c: Column) -> Column:
    return truth(c).cast("long")


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(flag(c)), F.lit(0).cast("long"))


def any_of(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def coverage_status(covered: Column, population: Column) -> Column:
    """available / partial / unavailable from a covered share."""
    return (F.when(population == 0, "unavailable").when(covered == population, "available")
            .when(covered > 0, "partial").otherwise("unavailable"))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(truth(c), F.lit(code)) for c, code in pairs]))


def text(arr: Column) -> Column:
    """Array as one comma separated string."""
    return F.array_join(arr, ",")


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add costly columns that later filters and projections read several times.

    A one-element ``inline`` keeps the optimizer from copying the expression into every
    reference, so each row computes it once.
    """
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, where both are one process, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="roundscope-"))
        root = sc.getCheckpointDir()
    return root


_SHARED: list[tuple[SparkSession, str]] = []


def shared(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches read, as Parquet in the shared folder: its lineage is cut, readers prune columns and know its size."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/shared-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SHARED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def shared_union(*dfs: DataFrame) -> DataFrame:
    """``union_all`` of the parts, stored as by ``shared``, but each part by a job of its own.

    One job over all parts would run the stages of every part at once, and each task would report the metrics of every part: the driver's memory would grow
    with the number of tasks times the number of parts.
    """
    spark = dfs[0].sparkSession
    schema = union_all(*dfs).schema
    path = f"{shared_root(spark)}/shared-{uuid.uuid4().hex}"
    _SHARED.append((spark, path))
    for i, df in enumerate(dfs):
        df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{path}/{i}")
    return spark.read.schema(schema).parquet(*[f"{path}/{i}" for i in range(len(dfs))])


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_shared() -> None:
    """Delete the intermediate results of ``shared``; DataFrames that read them can't be used afterwards."""
    while _SHARED:
        remove_folder(*_SHARED.pop())


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it; a cluster installs it or gets --py-files."""
    env = spark.sparkContext.environment
    if _SOURCE not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_SOURCE, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))]))


def first_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """First row per key by an aggregate, so hot keys are reduced before the shuffle."""
    packed = F.struct(*[F.col(c) for c in order + [k for k in keep if k not in order]])
    return df.groupBy(*keys).agg(F.min(packed).alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in keep])


def last_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    packed = F.struct(*[F.col(c) for c in order + [k for k in keep if k not in order]])
    return df.groupBy(*keys).agg(F.max(packed).alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in keep])


def ties_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows sharing the smallest ``order`` of their key (aggregate, then join back)."""
    low = df.groupBy(*keys).agg(F.min(order).alias("_low"))
    return df.join(low, keys).where(F.col(order) == F.col("_low")).drop("_low")


def share_table(df: DataFrame, scope: list[str], key: list[str]) -> DataFrame:
    """count per (scope, key) with its share of the scope total."""
    per = df.groupBy(*scope, *key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*scope))
    return per.withColumn("total", total).withColumn("share", ratio(F.col("n"), F.col("total")))


def lagged(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str], bucket: str) -> DataFrame:
    """Previous row's values along ``order`` with long groups cut by ``bucket``.

    Rows are windowed inside (keys, bucket); the value carried into a bucket is the
    last row of the previous bucket that has any.  Only one row per bucket takes part
    in the second window, so a hot key never sits in one task.  ``bucket`` must be
    monotone in ``order``.
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    packed = F.struct(*[F.col(c).alias(n) for c, n in cols.items()])
    rows = df.withColumn("_row", packed).withColumn("_prev", F.lag("_row").over(inner))
    rows = rows.withColumn("_head", F.row_number().over(inner) == 1)
    tails = df.groupBy(*keys, bucket).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carried = tails.withColumn("_in", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(bucket))).drop("_tail")
    rows = rows.join(carried, keys + [bucket])
    prev = F.when(F.col("_head"), F.col("_in")).otherwise(F.col("_prev"))
    rows = rows.withColumn("_p", prev)
    return rows.select(*df.columns, *[F.col(f"_p.{n}").alias(n) for n in cols.values()])
