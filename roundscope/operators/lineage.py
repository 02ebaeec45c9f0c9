"""Deterministic ids, data set fingerprints and source pins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(*parts) -> Column:
    """Name-based id: SHA-256 of the parts joined by a colon."""
    return F.sha2(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def cell_text(name: str, kind: str) -> Column:
    """A cell as text that tells all values of its type apart.

    Doubles are their whole part and their fraction in units of 2^-62; maps and arrays are JSON.
    """
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        d = c.cast("double")
        whole = F.floor(d)
        exact = F.concat(whole.cast("string"), F.lit("+"), F.floor((d - whole) * float(1 << 62)).cast("string"))
        return F.when(F.isnan(d) | (F.abs(d) >= float(1 << 62)), d.cast("string")).otherwise(exact)
    if kind.startswith(("array", "map", "struct")):
        return F.to_json(c)
    return c.cast("string")


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as text: its columns by name, lengths before values, NULLs told apart from everything else."""
    kinds = dict(df.dtypes)
    cells = []
    for name in sorted(columns or df.columns):
        value = cell_text(name, kinds[name])
        cells.append(F.coalesce(F.concat(F.lit(f"{name}="), F.length(value).cast("string"), F.lit(":"), value), F.lit(f"{name}!")))
    return F.concat_ws(",", *cells)


def content_sums(df: DataFrame, name: str, key: str = "match_id", columns: list[str] | None = None) -> DataFrame:
    """Fingerprint of a multiset of rows per key: their number, and the sums of the two halves of their 128-bit hashes, modulo 2^64.

    Sums don't depend on order or partitioning, are combined on the map side, and can be added and subtracted: see ``merged_sums``.
    """
    h = df.select(key, F.md5(row_text(df, columns)).alias("h"))
    half = lambda at: F.sum(F.conv(F.substring("h", at, 16), 16, 10).cast("decimal(20,0)"))
    return _as_sums(h.groupBy(key).agg(F.count("*").alias("rows"), half(1).alias("high"), half(17).alias("low")).withColumn("table_name", F.lit(name)), key)


def _as_sums(df: DataFrame, key: str) -> DataFrame:
    wrap = lambda c: F.pmod(F.col(c), F.expr("CAST('18446744073709551616' AS DECIMAL(20,0))")).cast("decimal(20,0)").alias(c)
    return df.select(key, "table_name", "rows", wrap("high"), wrap("low"))


def merged_sums(*parts: tuple[int, DataFrame], key: str = "match_id") -> DataFrame:
    """Fingerprints of added (1) and removed (-1) rows as those of what is left; keys without rows are left out."""
    every = None
    for sign, df in parts:
        one = df.select(key, "table_name", *[(F.col(c) * sign).cast("decimal(38,0)").alias(c) for c in ("rows", "high", "low")])
        every = one if every is None else every.unionByName(one)
    out = every.groupBy(key, "table_name").agg(F.sum("rows").cast("long").alias("rows"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    return _as_sums(out, key).where("rows <> 0 OR high <> 0 OR low <> 0")


def fingerprint_text() -> Column:
    """Rows, high and low sum as one text of hexadecimal digits."""
    hexed = lambda c: F.lpad(F.lower(F.conv(F.col(c).cast("string"), 10, 16)), 16, "0")
    return F.concat(F.col("rows").cast("string"), F.lit(":"), hexed("high"), hexed("low"))


def dataset_fingerprint(tables: DataFrame | dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """match_id, fingerprint over all columns of a table or of a set of tables, independent of row order."""
    tables = tables if isinstance(tables, dict) else {"table": tables}
    sums = None
    for name, df in tables.items():
        one = content_sums(df, name, columns=columns)
        sums = one if sums is None else sums.unionByName(one)
    listed = F.sort_array(F.collect_list(F.concat_ws("=", "table_name", fingerprint_text())))  # one entry for each table
    return sums.groupBy("match_id").agg(F.md5(F.array_join(listed, ",")).alias("fingerprint"))


def fresh_runs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Derived runs whose pinned fingerprint still equals the source's."""
    pin = current.select("match_id", F.col("fingerprint").alias("source_fingerprint"))
    return runs.join(pin, ["match_id", "source_fingerprint"], "left_semi")
