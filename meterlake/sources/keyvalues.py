"""Usage in databases whose tables nobody described: key-value stores, and tables with columns that speak of tokens."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, usage
from ..operators.shapes import usage_within
from ..schema import conform
from . import sqlite

# Keys of a store that may speak of usage, columns of a table that do, and databases that hold them.
KEYS = "(?i)usage|token|cascade|chat|billing|credit|model"
COLUMNS = "(?i)token|usage|credit|cost"
STORES = r"(?i)(?:.*/)?(?:[^/]*\.vscdb|(?![^/]*lock)[^/]*\.db)$"
SCHEMA = "path string, mtime timestamp, name string, row_id long, tag string, value string"


def tables_with_usage(paths: list[tuple[str, int]]) -> list[str]:
    """Names of tables that have keys and values, or columns of usage; of what can't be opened, none. Only the databases' schemas are read."""
    out: dict[str, str] = {}
    for path, _ in paths:
        try:
            db = sqlite._open(path)
        except sqlite3.Error:
            continue
        try:
            for (name,) in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite\\_%' escape '\\' order by rowid"):
                columns = [r[1].lower() for r in db.execute(f"pragma table_info({sqlite._quoted(name)})")]
                if {"key", "value"} <= set(columns) or any(re.search(COLUMNS, c) for c in columns):
                    out.setdefault(name.lower(), name)
        except sqlite3.Error:
            continue
        finally:
            db.close()
    return sorted(out.values())


def read_values(spark: SparkSession, roots: list[str], name: str = STORES) -> DataFrame:
    """(path, mtime, name, row_id, tag, value) of rows that may hold usage: values of keys that speak of it, else whole rows, as JSON."""
    found, _ = sqlite.databases(spark, roots, name, 10)
    out = spark.createDataFrame([], SCHEMA)
    for table in tables_with_usage(found):
        rows = sqlite.scan(spark, found, table, "_path string, _mtime timestamp, _rowid long, key string, value string, _data string")
        stored = F.lower(F.lit(table)) == "itemtable"
        whole = F.when(F.col("value").isNull(), F.col("_data")).otherwise(F.col("value"))
        rows = rows.filter(~stored | F.coalesce(F.col("key").rlike(KEYS), F.lit(False)))
        out = out.unionByName(rows.select(F.col("_path").alias("path"), F.col("_mtime").alias("mtime"), F.lit(table).alias("name"), F.col("_rowid").alias("row_id"), F.coalesce("key", F.lit("")).alias("tag"), whole.alias("value")))
    return out


def usage_of_values(values: DataFrame, agent: str) -> DataFrame:
    """Usage rows of (path, mtime, name, row_id, tag, value): objects with tokens wherever they are in a value. Values that aren't JSON have none."""
    opened = values.withColumn("value", F.try_parse_json("value")).filter("value is not null")
    keys = ["path", "name", "row_id", "tag"]
    found = usage_within(opened, keys).join(values.select("path", "mtime").distinct(), "path")
    r = F.col("found")
    counts = {f"{n}_tokens": F.col(f"b.{n}") for n in ("input", "output", "cache_read", "cache_write")}
    shown = found.select(
        F.col("row_id").alias("seq"), text.stable_id(F.lit(agent), *[F.col(k) for k in keys], F.col("place"), F.col("b.input")).alias("id"), F.lit(agent).alias("agent"), usage.model_of(r).alias("model"), usage.time_of(r, fallback=F.col("mtime")).alias("ts"),
        *[c.alias(n) for n, c in counts.items()], F.col("path").alias("source_path"), F.lit(False).alias("estimated"),
    )
    return conform(shown.withColumn("total_tokens", F.expr(" + ".join(counts))))


def read_key_values(spark: SparkSession, roots: list[str], agent: str) -> DataFrame:
    return usage_of_values(read_values(spark, roots), agent)
