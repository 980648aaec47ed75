"""Files as rows: lines, JSON documents and bytes, with their path and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Folders that hold no logs of use.
PRUNED = ["node_modules", ".git", ".tmp", "tmp", "fixtures", "__tests__", "testdata", "mocks"]
NOISE = r"(?i)/(plugin-eval|fixtures?|__tests__|tmp|\.tmp|mocks?)/"


def existing(spark: SparkSession, roots: list[str]) -> list[str]:
    """The roots that exist, asked of their own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [(r, jvm.org.apache.hadoop.fs.Path(r)) for r in roots]
    return [r for r, p in paths if p.getFileSystem(conf).exists(p)]


def _wanted(path: Column, root: str, name: str, depth: int) -> Column:
    """Files below a root whose name fits, not too deep and in no pruned folder."""
    below = F.substring_index(path, f"{root.rstrip('/').split(':', 1)[-1].lstrip('/')}/", -1)
    pruned = below.rlike("(^|/)(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/")
    return below.rlike(name) & (F.size(F.split(below, "/")) <= depth + 1) & ~pruned


def _meta() -> list[Column]:
    return [F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("block")]


def _load(spark: SparkSession, roots: list[str], name: str, depth: int, form: str, columns: list[str], **options) -> DataFrame:
    out = None
    for root in existing(spark, roots):
        rows = spark.read.format(form).options(recursiveFileLookup="true", ignoreMissingFiles="true", **options).load(root)
        rows = rows.select(*columns, *_meta()).filter(_wanted(F.col("path"), root, name, depth))
        out = rows if out is None else out.unionByName(rows)
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """(path, block, ...) lines with ``line_no``, from 1 in each file, without ``block``.

    A block's lines stand together in one partition, in order, so each line's
    distance from its block's first is known there. Blocks are counted, and the
    running sums of those counts (one row a block) are joined back: no file's lines
    are gathered or sorted. Both passes read the same listing of files.
    """
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    blocks = placed.groupBy("path", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("path", "block", (F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return placed.join(starts, ["path", "block"]).withColumn("line_no", F.col("place") + F.col("shift")).drop("block", "place", "shift")


LINES, JSON_LINES = "path string, mtime timestamp, line_no long, value string", "path string, mtime timestamp, line_no long, row variant"


def read_lines(spark: SparkSession, roots: list[str], name: str = r"\.jsonl$", depth: int = 8) -> DataFrame:
    """(path, mtime, line_no, value) of all lines that aren't blank. Long files are split; lines are numbered from 1 in each file."""
    rows = _load(spark, roots, name, depth, "text", ["value"])
    if rows is None:
        return spark.createDataFrame([], LINES)
    return numbered(rows.filter(F.length(F.trim("value")) > 0)).select("path", "mtime", "line_no", "value")


def read_json_lines(spark: SparkSession, roots: list[str], name: str = r"\.jsonl$", depth: int = 8, keep: Column | None = None) -> DataFrame:
    """(path, mtime, line_no, row) of the lines that are JSON, and fit ``keep`` (a condition on ``value``); numbered among those."""
    return _parsed(spark, _load(spark, roots, name, depth, "text", ["value"]), keep)


def _parsed(spark: SparkSession, rows: DataFrame | None, keep: Column | None = None) -> DataFrame:
    if rows is None:
        return spark.createDataFrame([], JSON_LINES)
    rows = rows.filter(keep) if keep is not None else rows
    # exploded, a line is parsed once; Spark would repeat a projection's parse in the filter
    rows = rows.select("path", "mtime", "block", F.explode(F.array(F.try_parse_json(F.trim("value")))).alias("row")).filter("row is not null")
    return numbered(rows).select("path", "mtime", "line_no", "row")


def _named(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    found = existing(spark, paths)
    return spark.read.option("ignoreMissingFiles", "true").text(found).select("value", *_meta()) if found else None


def read_named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime, line_no, value) of the lines of some files, wherever they are; those that don't exist have none."""
    rows = _named(spark, paths)
    return spark.createDataFrame([], LINES) if rows is None else numbered(rows.filter(F.length(F.trim("value")) > 0)).select("path", "mtime", "line_no", "value")


def read_named_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime, line_no, row) of the JSON lines of some files, wherever they are."""
    return _parsed(spark, _named(spark, paths))


def listed(spark: SparkSession, roots: list[str], name: str, depth: int = 8) -> list[tuple[str, int]]:
    """(path, time in microseconds) of files, without reading them."""
    rows = _load(spark, roots, name, depth, "binaryFile", ["length"])
    return [] if rows is None else [(r.path, int(r.at)) for r in rows.select("path", F.unix_micros("mtime").alias("at")).orderBy("path").collect()]


def read_documents(spark: SparkSession, roots: list[str], name: str = r"\.json$", depth: int = 8) -> DataFrame:
    """(path, mtime, value) of whole text files."""
    rows = _load(spark, roots, name, depth, "text", ["value"], wholetext="true")
    return spark.createDataFrame([], "path string, mtime timestamp, value string") if rows is None else rows.drop("block")


def read_bytes(spark: SparkSession, roots: list[str], name: str = r"\.pb$", depth: int = 8) -> DataFrame:
    """(path, mtime, content, length) of binary files."""
    rows = _load(spark, roots, name, depth, "binaryFile", ["content", "length"])
    return spark.createDataFrame([], "path string, mtime timestamp, content binary, length long") if rows is None else rows.drop("block")


def not_noise(path: Column, roots: list[str] | None = None) -> Column:
    """Whether a path isn't in a folder of fixtures or scratch; what is above a root doesn't count."""
    for r in roots or []:
        path = F.replace(path, F.lit(r.split(":", 1)[-1].rstrip("/")), F.lit(""))
    return ~path.rlike(NOISE)


def explode_documents(documents: DataFrame) -> DataFrame:
    """(path, mtime, line_no, row): an array's elements; of an object its messages, events or usage array, else itself."""
    doc = documents.withColumn("doc", F.try_parse_json("value")).filter("doc is not null")
    array = lambda p: F.try_variant_get("doc", p, "array<variant>")
    whole = F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.array("doc"))
    rows = F.coalesce(array("$"), array("$.messages"), array("$.events"), array("$.usage"), whole)
    return doc.select("path", "mtime", F.posexplode(rows).alias("at", "row")).select("path", "mtime", (F.col("at") + 1).cast("long").alias("line_no"), "row")
