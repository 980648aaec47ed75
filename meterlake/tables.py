"""Tables in the folder that driver and executors share, which cut a long plan."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where it is unset, local mode takes a temporary folder; a cluster is an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meterlake-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


#: Tables that are written while a ``cut_tables`` block runs, innermost last.
_open: list[list[tuple[SparkSession, str]]] = []


def cut(rows: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: a short plan, and lost executors cost nothing. It stays until the ``cut_tables`` block around it ends."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/cut/{uuid.uuid4().hex}"
    if _open:
        _open[-1].append((spark, path))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextlib.contextmanager
def cut_tables() -> Iterator[None]:
    """Tables cut within the block are deleted at its end; results that read them must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
