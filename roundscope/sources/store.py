"""Reading and writing table sets: canonical JSON, derived runs, deletes, counts."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.common import shared_root, union_all

def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_canonical(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """One JSON document per match with an array of rows for each table."""
    doc = None
    for name, df in tables.items():
        rows = df.groupBy("match_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "match_id"])).alias(name))
        doc = rows if doc is None else doc.join(rows, "match_id", "full")
    doc.withColumn("schema_version", F.lit(version)).write.option("ignoreNullFields", "false").json(path)


def load_canonical(spark: SparkSession, path: str, shapes: dict[str, StructType], version: int = 1) -> dict[str, DataFrame]:
    """Documents of one version as tables; ``shapes`` names the tables and their columns, match_id among them.

    Fields are read by schema, without a pass to infer it; documents of other versions are left out, and a table that a document lacks has no rows of it.
    """
    of = {n: StructType([f for f in s.fields if f.name != "match_id"]) for n, s in shapes.items()}
    schema = StructType([StructField("match_id", StringType()), StructField("schema_version", IntegerType()), *[StructField(n, ArrayType(s)) for n, s in of.items()]])
    doc = spark.read.schema(schema).json(path).where(F.col("schema_version") == version)
    return {n: doc.select("match_id", F.inline(n)).select(*shapes[n].names) for n in shapes}


def outdated(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Matches whose fingerprint is not stored yet: only these need saving."""
    return new.join(stored.select("match_id", "fingerprint"), ["match_id", "fingerprint"], "left_anti")


def round_events(tables: dict[str, DataFrame], match_id: str | None = None, round_number: int | None = None) -> DataFrame:
    """All event families of one round (or of everything) in tick order; filters reach the scan."""
    out = []
    for family, df in tables.items():
        if match_id is not None:
            df = df.where(F.col("match_id") == match_id)
        if round_number is not None:
            df = df.where(F.col("round_number") == round_number)
        out.append(df.select("match_id", "round_number", "tick", "event_id", F.lit(family).alias("family"), "phase"))
    return union_all(*out).orderBy("match_id", "round_number", "tick", "event_id", "family")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all(*[df.groupBy("match_id").agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(n)) for n, df in tables.items()])
