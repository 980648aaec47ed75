"""Helpers that the training-data operators share.

Texts reach Python as Arrow batches; the helpers here view them as flat byte
arrays, so that the work inside a task is numpy over a few megabytes at a time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on.
STEP_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder. Python workers are told where this package is, should they have been started elsewhere."""
    env, home = spark.sparkContext.environment, str(Path(__file__).parents[2])
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{env['PYTHONPATH']}:{home}" if env.get("PYTHONPATH") else home
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, local mode takes a temporary folder; a cluster is an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meterlake-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/meterlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = _scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Like ``materialize``, but bucketed by ``keys``: joins with the table by these keys don't shuffle it again."""
    spark = df.sparkSession
    path, table = _scratch(spark, name), f"meterlake_{name}_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    df.write.bucketBy(buckets, *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application's operators have written; their results can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/meterlake/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for table in spark.catalog.listTables():
        if table.name.startswith("meterlake_"):
            spark.sql(f"DROP TABLE `{table.name}`")


def aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns that have one of ``names`` renamed by a trailing ``_in``, so that a result can have the name."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = c
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: ``name``, if need be with underscores."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty. ``offsets`` has one more entry than the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``most`` bytes each; a longer row is a run of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row where its words begin (one entry more than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[buf]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def small_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", limit: int = 100_000, salts: int = 16) -> DataFrame:
    """Join a table of few rows for each key to a large one.

    ``dim`` is counted first: up to ``limit`` rows it is broadcast; beyond, it is
    repeated for each of ``salts`` salts and the join is shuffled by key and
    salt, so that a hot key is spread over that many tasks.
    """
    if dim.count() <= limit:
        return facts.join(F.broadcast(dim), keys, how)
    name = fresh(facts, "salt")
    salted = dim.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*[c for c in facts.columns if c not in keys] or keys), F.lit(salts)).cast("int")
    return facts.withColumn(name, salt).join(salted, [*keys, name], how).drop(name)


def pieces(total_bytes: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` bytes hold ``total_bytes``."""
    return max(least, -(-int(total_bytes or 0) // each))
