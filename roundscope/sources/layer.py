"""A columnar layer of tables in hashed match buckets.

A table is a folder of Parquet files, partitioned by a hash of its key (the match, unless it is told otherwise), so that reads of some matches prune
buckets, all reads prune columns, and a change of some matches rewrites their buckets only.  Buckets are dealt by Spark's rebalancing, which splits one that
holds much more than others.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.common import remove_folder
from ..operators.lineage import dataset_fingerprint
from .store import outdated

BUCKET = "_bucket"


@dataclass(frozen=True)
class Edge:
    """Rows of ``child`` go if their ``column`` is that of a row of ``parent`` that goes."""
    parent: str
    child: str
    column: str


class Layer:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        """``root`` lies in the file system that driver and executors share; ``buckets`` should grow with the number of matches."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schemas: dict[str, StructType] = {}
        self.keys: dict[str, str] = {}
        self.edges: list[Edge] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def bucket(self, key: Column | str = "match_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _put(self, name: str, df: DataFrame, key: str) -> None:
        rows = df.withColumn(BUCKET, self.bucket(key)).hint("rebalance", BUCKET)
        rows.sortWithinPartitions(BUCKET, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path(name))

    def write(self, name: str, df: DataFrame, key: str = "match_id") -> DataFrame:
        """Write a table for the first time and give it back as it is stored."""
        if self.open(name, key):
            raise ValueError(f"{name} is written already")
        self._put(name, df, key)
        self.schemas[name], self.keys[name] = df.schema, key
        return self.read(name)

    def open(self, name: str, key: str = "match_id") -> bool:
        """Take over a table that an earlier session wrote below the same root; whether there is one."""
        if name not in self.schemas and self._exists(self.path(name)):
            found = self.spark.read.parquet(self.path(name)).schema
            self.schemas[name], self.keys[name] = StructType([f for f in found.fields if f.name != BUCKET]), key
        return name in self.schemas

    def read(self, name: str, keys: list | None = None) -> DataFrame:
        """A table, or its rows of some matches: their buckets alone are read."""
        schema = self.schemas[name]
        full = StructType([*schema.fields, StructField(BUCKET, IntegerType())])
        df = self.spark.read.schema(full).parquet(self.path(name)) if self._exists(self.path(name)) else self.spark.createDataFrame([], full)
        if keys is not None:
            key = self.keys[name]
            some = self.spark.createDataFrame([(k,) for k in keys], f"{key} {schema[key].dataType.simpleString()}")
            chosen = sorted({r[0] for r in some.select(self.bucket(key)).collect()})
            df = df.where(F.col(BUCKET).isin(chosen) & F.col(key).isin(keys))
        return df.drop(BUCKET)

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, fs = self._hadoop(path)
        return fs.exists(where) and any(s.getPath().getName().startswith(f"{BUCKET}=") for s in fs.listStatus(where))

    def _remove(self, path: str) -> None:
        remove_folder(self.spark, path)

    # -- changes of some matches ---------------------------------------------
    def _buckets(self, keys: DataFrame, key: str) -> list[int]:
        """Buckets that hold some keys; there are no more than the layer has."""
        return sorted(r[0] for r in keys.select(self.bucket(key).alias("b")).distinct().collect())

    def _rewrite(self, name: str, gone: DataFrame, column: str, new: DataFrame | None = None) -> list[int]:
        """Replace the rows whose ``column`` is in ``gone`` by ``new``; only buckets that either touches are written.

        The new content is staged in a table of its own, because Spark must not read the folders that it replaces; an attempt that
        was cut short can be repeated.
        """
        key, old = self.keys[name], self.read(name)
        hit = old.join(gone.select(column).distinct(), column, "left_semi").select(key)
        touched = self._buckets(hit if new is None else hit.unionByName(new.select(key)), key)
        if not touched:
            return []
        staged = f"{self.root}/_staged/{name}-{uuid.uuid4().hex}"
        kept = old.where(self.bucket(key).isin(touched)).join(gone.select(column).distinct(), column, "left_anti").select(*old.columns)
        (kept if new is None else kept.unionByName(new)).write.parquet(staged)
        content = self.spark.read.schema(self.schemas[name]).parquet(staged)
        filled = self._buckets(content, key)
        if filled:
            self._put(name, content, key)
        for b in touched:
            if b not in filled:
                self._remove(f"{self.path(name)}/{BUCKET}={b}")
        self._remove(staged)
        return touched

    def refresh(self, name: str, inputs: dict[str, DataFrame], derive: Callable[[dict[str, DataFrame]], DataFrame]) -> list[int]:
        """Bring a derived table up to date; gives the buckets that were written.

        The table carries, per match, the fingerprint of all its inputs.  Only matches whose fingerprint isn't stored are derived again, and
        matches that the inputs no longer have go.
        """
        pins = f"{name}_pins"
        now = dataset_fingerprint(inputs)
        if not (self.open(pins) and self.open(name)):
            if not self.open(name):
                self.write(name, derive(inputs))
            else:  # an earlier attempt ended before the pins were written
                self._rewrite(name, self.read(name), "match_id", derive(inputs))
            self.write(pins, now)
            return self._buckets(self.read(pins), "match_id")
        stored = self.read(pins)
        stale = outdated(now, stored).select("match_id")
        lost = stored.join(now.select("match_id"), "match_id", "left_anti").select("match_id")
        changed = f"{self.root}/_staged/{name}-changed-{uuid.uuid4().hex}"
        stale.withColumn("lost", F.lit(False)).unionByName(lost.withColumn("lost", F.lit(True))).write.parquet(changed)
        changed_rows = self.spark.read.schema("match_id string, lost boolean").parquet(changed)
        if changed_rows.isEmpty():
            return []
        again = changed_rows.where("not lost").select("match_id")
        fresh = derive({n: df.join(again, "match_id", "left_semi") for n, df in inputs.items()})
        touched = self._rewrite(name, changed_rows, "match_id", fresh)
        self._rewrite(pins, changed_rows, "match_id", now.join(again, "match_id", "left_semi"))
        self._remove(changed)
        return touched

    def derived(self, parent: str, child: str, column: str = "match_id") -> None:
        """Note that rows of ``child`` stand or fall with the rows of ``parent`` of their ``column``."""
        self.edges.append(Edge(parent, child, column))

    def delete(self, name: str, gone: DataFrame) -> dict[str, list[int]]:
        """Delete the rows of ``name`` whose key is in ``gone`` and all that was derived from them; gives the buckets rewritten per table.

        The walk over the lineage gathers, for each table and column, the values whose rows go, until no table adds any.
        """
        root = f"{self.root}/_staged/delete-{uuid.uuid4().hex}"
        going: dict[tuple[str, str], list[DataFrame]] = {}
        todo = [(name, self.keys[name], gone.select(self.keys[name]).distinct())]
        while todo:
            table, column, values = todo.pop(0)
            for known in going.get((table, column), []):
                values = values.join(known, column, "left_anti")
            path = f"{root}/{uuid.uuid4().hex}"
            values.write.parquet(path)
            values = self.spark.read.schema(values.schema).parquet(path)
            if values.isEmpty():
                continue
            going.setdefault((table, column), []).append(values)
            rows = self.read(table).join(values, column, "left_semi")
            for edge in self.edges:
                if edge.parent == table and (edge.child, edge.column) != (table, column):
                    todo.append((edge.child, edge.column, rows.select(edge.column).where(F.col(edge.column).isNotNull()).distinct()))
        touched: dict[str, list[int]] = {}
        for (table, column), values in going.items():
            for some in values:
                if written := self._rewrite(table, some, column):
                    touched[table] = sorted({*touched.get(table, []), *written})
        self._remove(root)
        return touched

    def drop(self) -> None:
        """Delete all tables."""
        self._remove(self.root)
        self.schemas.clear()
