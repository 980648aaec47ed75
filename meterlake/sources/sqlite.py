"""SQLite tables as rows: a data source whose partitions are ranges of row ids.

A file of many rows is read by many tasks, each of which opens it, reads the
columns that the schema names, and hands rejected rows to nobody: filters that
Spark pushes are asked of SQLite first. Files must be visible to all executors
under one path (a local disk in local mode, a mounted folder on a cluster). Files
of other stores are fetched by Spark and read whole, one task each.

Tables whose columns vary are read as JSON text (``_data``), so that they fit one
schema.
"""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructType

from . import files

SCHEMA = "path string, mtime timestamp, name string, line_no long, data string"
FORMAT = "sqlite_table"
DATABASES = r".*\.(?:db|sqlite|sqlite3|vscdb)$"
#: Columns that every table has here: its file, the file's time, its own name, the row's id, and all of the row as JSON.
OWN = ("_path", "_mtime", "_table", "_rowid", "_data")
#: A range of row ids holds at least so many, and a file has at most a range for so many bytes.
RANGE_ROWS, RANGE_BYTES = 100_000, 1 << 20
BATCH_ROWS = 4096
PUSHED = "spark.sql.python.filterPushdown.enabled"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _plain(value):
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return value if not isinstance(value, float) or value == value else None


def local_path(path: str) -> str | None:
    """A path that can be opened as a file, or None for other stores."""
    if m := re.match(r"^file:/*(/.*)$", path):
        return unquote(m[1]) if "%" in m[1] else m[1]
    return path if path.startswith("/") else None


def _open(path: str) -> sqlite3.Connection:
    """Read only; a file whose write-ahead log can't be used is read as it is."""
    for mode in ("mode=ro", "immutable=1"):
        db = sqlite3.connect(f"file:{quote(path)}?{mode}", uri=True)
        try:
            db.execute("select count(*) from sqlite_master")
            return db
        except sqlite3.OperationalError:
            db.close()
    raise sqlite3.OperationalError(f"{path} can't be opened")


@dataclass
class Table:
    """A table of one file: its name, its columns with their declared types, and what a row's id is called (None if it has none)."""

    name: str
    columns: dict[str, str]
    row_id: str | None


def find_table(db: sqlite3.Connection, wanted: str, like: str = "", unlike: str = "") -> Table | None:
    """The table of a name, whatever its case, else the first whose name fits ``like`` and not ``unlike``."""
    names = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' order by rowid")]
    fits = [n for n in names if n.lower() == wanted.lower()]
    if not fits and like:
        fits = [n for n in names if re.search(like, n, re.I) and not (unlike and re.search(unlike, n, re.I))]
    if not fits:
        return None
    columns = {r[1]: r[2] or "" for r in db.execute(f"pragma table_info({_quoted(fits[0])})")}
    taken = {c.lower() for c in columns}
    for row_id in ("rowid", "_rowid_", "oid"):
        if row_id not in taken:
            try:
                db.execute(f"select {row_id} from {_quoted(fits[0])} limit 0")
                return Table(fits[0], columns, row_id)
            except sqlite3.OperationalError:  # a table without row ids
                break
    return Table(fits[0], columns, None)


def ranges_of(db: sqlite3.Connection, table: Table, rows: int = RANGE_ROWS) -> list[tuple[int | None, int | None]]:
    """Ranges of row ids that cover a table; one open range if it has no row ids."""
    if table.row_id is None:
        return [(None, None)]
    low, high = db.execute(f"select min({table.row_id}), max({table.row_id}) from {_quoted(table.name)}").fetchone()
    if low is None:
        return []
    size = db.execute("pragma page_count").fetchone()[0] * db.execute("pragma page_size").fetchone()[0]
    # ids may be sparse: no more ranges than the file's size could fill
    width = max(rows, -(-(high - low + 1) // max(1, -(-size // RANGE_BYTES))))
    return [(a, min(a + width, high + 1)) for a in range(low, high + 1, width)]


class Rows(InputPartition):
    def __init__(self, path: str, mtime: int, table: Table, low: int | None, high: int | None):
        self.path, self.mtime, self.table, self.low, self.high = path, mtime, table, low, high


def _long(v):
    if isinstance(v, float):
        return int(v) if v == v and abs(v) < 2**63 else None
    if isinstance(v, (str, bytes)):
        try:
            return int(v)
        except ValueError:
            return None
    return v


def _double(v):
    try:
        return None if v is None else float(v)
    except ValueError:
        return None


def _string(v):
    return v if v is None or isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


def _binary(v):
    return v if v is None or isinstance(v, bytes) else str(v).encode()


_READ = {LongType: _long, DoubleType: _double, StringType: _string, BinaryType: _binary}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
# The storage class in which a value of a column's type can be compared; rows of other classes are left to Spark.
_CLASSES = {LongType: "('integer')", DoubleType: "('integer', 'real')", StringType: "('text')"}


class SqliteReader(DataSourceReader):
    """Reads ``files`` ([path, time in microseconds] as JSON); ``aliases`` give a column's possible names in a table, ``#1`` for the first one."""

    def __init__(self, options: dict, schema: StructType):
        self.schema = schema
        self.files = json.loads(options["files"])
        self.table, self.like, self.unlike = options["table"], options.get("like", ""), options.get("unlike", "")
        self.aliases = json.loads(options.get("aliases", "{}"))
        self.rows = int(options.get("rows", RANGE_ROWS))
        self.where: list[tuple[str, str, list]] = []  # column, condition with {c} for it, values

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, mtime in self.files:
            try:
                db = _open(path)
                try:
                    table = find_table(db, self.table, self.like, self.unlike)
                    if table:
                        out += [Rows(path, mtime, table, low, high) for low, high in ranges_of(db, table, self.rows)]
                finally:
                    db.close()
            except sqlite3.Error:  # no database, or a damaged one
                continue
        return out or [InputPartition(None)]

    def column(self, table: Table, name: str) -> str | None:
        """What a table calls a column of the schema; None if it hasn't it."""
        by_name = {c.lower(): c for c in table.columns}
        for wanted in self.aliases.get(name, [name]):
            if wanted.lower() in by_name:
                return by_name[wanted.lower()]
            if wanted.startswith("#"):
                return list(table.columns)[int(wanted[1:]) - 1]
        return None

    def query(self, part: Rows) -> tuple[str, list]:
        """The statement for one range, and its values."""
        row_id = part.table.row_id or "null"
        wanted = [f.name for f in self.schema if f.name not in OWN]
        named = [self.column(part.table, c) for c in wanted]
        columns = [row_id, *[_quoted(c) if c else "null" for c in named]]
        if "_data" in self.schema.names:
            columns += [_quoted(c) for c in part.table.columns]
        conditions, values = [], []
        if part.low is not None:
            conditions.append(f"{row_id} >= ? and {row_id} < ?")
            values += [part.low, part.high]
        for name, condition, more in self.where:
            c = self.column(part.table, name)
            conditions.append(condition.format(c=_quoted(c) if c else "null"))
            values += more
        where = f" where {' and '.join(conditions)}" if conditions else ""
        order = f" order by {row_id}" if part.table.row_id else ""
        return f"select {', '.join(columns)} from {_quoted(part.table.name)}{where}{order}", values

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Rows):  # no file has the table
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        wanted = [f for f in self.schema if f.name not in OWN]
        try:
            db = _open(part.path)
        except sqlite3.Error:
            return
        db.text_factory = lambda b: b.decode("utf-8", "replace")
        try:
            found, n = db.execute(*self.query(part)), 0
            while rows := found.fetchmany(BATCH_ROWS):
                columns = {"_path": [f"file:{part.path}"] * len(rows), "_mtime": [part.mtime] * len(rows), "_table": [part.table.name] * len(rows)}
                columns["_rowid"] = [n + i if r[0] is None else r[0] for i, r in enumerate(rows, 1)]
                n += len(rows)
                for i, f in enumerate(wanted, 1):
                    columns[f.name] = [_READ[type(f.dataType)](r[i]) for r in rows]
                if "_data" in self.schema.names:
                    first = 1 + len(wanted)
                    columns["_data"] = [json.dumps(dict(zip(part.table.columns, map(_plain, r[first:]), strict=True))) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
        except sqlite3.DatabaseError:  # damaged from here on
            return
        finally:
            db.close()


class PushingReader(SqliteReader):
    """Also asks SQLite to leave out what filters reject. Values of another storage class pass, and Spark decides."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        types = {f.name: type(f.dataType) for f in self.schema}
        for f in filters:
            path = getattr(f, "attribute", ())
            name = path[0] if len(path) == 1 else None
            if name in types and name not in OWN:
                kind = _CLASSES.get(types[name])
                if isinstance(f, IsNull):
                    self.where.append((name, "({c} is null or typeof({c}) not in " + (kind or "('')") + ")", []))
                elif isinstance(f, IsNotNull):
                    self.where.append((name, "{c} is not null", []))
                elif kind and type(f) in _COMPARED:
                    self.where.append((name, "(typeof({c}) not in " + kind + " or {c} " + _COMPARED[type(f)] + " ?)", [f.value]))
                elif kind and isinstance(f, In):
                    marks = ", ".join("?" * len(f.value))
                    self.where.append((name, "(typeof({c}) not in " + kind + " or {c} in (" + marks + "))", list(f.value)))
            yield f  # Spark filters again


class SqliteSource(DataSource):
    """Options: ``files``, ``table``; ``like`` and ``unlike`` (patterns for another table if there is none of that name), ``aliases``, ``rows`` (row ids a partition), ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        """The columns of the first file that has the table, and the file's path and row id."""
        for path, _ in json.loads(self.options["files"]):
            try:
                db = _open(path)
                try:
                    table = find_table(db, self.options["table"], self.options.get("like", ""), self.options.get("unlike", ""))
                finally:
                    db.close()
            except sqlite3.Error:
                continue
            if table:
                out = StructType()
                for c, declared in table.columns.items():
                    out.add(c, _declared(declared))
                return out.add("_path", StringType()).add("_rowid", LongType())
        return StructType().add("_path", StringType()).add("_rowid", LongType())

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else SqliteReader)(dict(self.options), schema)


def _declared(kind: str):
    """The type of a column by its declaration, as SQLite tells affinities; what may be either is text."""
    k = kind.upper()
    if "INT" in k:
        return LongType()
    if any(x in k for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in k:
        return BinaryType()
    return DoubleType() if any(x in k for x in ("REAL", "FLOA", "DOUB")) else StringType()


def scan(spark: SparkSession, paths: list[tuple[str, int]], table: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table of local database files ((path, time in microseconds)); the columns of ``schema``, or all."""
    spark.dataSource.register(SqliteSource)
    pushdown = str(spark.conf.get(PUSHED, "false")).lower()
    reader = spark.read.format(FORMAT).options(files=json.dumps(paths), table=table, pushdown=pushdown, **options)
    return (reader.schema(schema) if schema else reader).load()


def _rows(content: bytes, tables: list[str]) -> Iterator[tuple[str, int, str]]:
    """(table, row id, JSON) of the wanted tables of a database; a damaged one has none."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        for name in tables:
            if table := find_table(db, name):
                row_id = table.row_id or "row_number() over ()"
                for number, *row in db.execute(f"select {row_id}, * from {_quoted(table.name)}"):
                    yield name, number, json.dumps(dict(zip(table.columns, map(_plain, row), strict=True)))
    except sqlite3.Error:
        return
    finally:
        db.close()


def databases(spark: SparkSession, roots: list[str], name: str = DATABASES, depth: int = 8) -> tuple[list[tuple[str, int]], list[str]]:
    """Database files below the roots that tasks can open ((path, time)), and the roots of other stores. The list grows with the files, not with their rows."""
    near = [r for r in roots if local_path(r)]
    found = files.listed(spark, near, name, depth)
    return [(local_path(path), mtime) for path, mtime in found], [r for r in roots if not local_path(r)]


def _newest_first(rows: DataFrame, column: str) -> DataFrame:
    """Rows of each file numbered by a column, greatest first, as SQLite orders: text, then numbers, then nulls. Without the column they keep their ids."""
    v = F.try_parse_json("data")
    kind = F.schema_of_variant(F.try_variant_get(v, f"$['{column}']", "variant"))
    said = F.try_variant_get(v, f"$['{column}']", "string")
    order = [(kind == "STRING").desc_nulls_last(), said.try_cast("double").desc_nulls_last(), said.desc_nulls_last(), F.col("line_no")]
    has = kind.isNotNull()
    return rows.withColumn("line_no", F.when(has, F.row_number().over(W.partitionBy("path").orderBy(*order)).cast("long")).otherwise(F.col("line_no")))


def read_tables(spark: SparkSession, roots: list[str], tables: list[str] | dict[str, str | None], name: str = DATABASES, depth: int = 8) -> DataFrame:
    """(path, mtime, name, line_no, data) of the wanted tables of all SQLite files below the roots.

    ``line_no`` is the row's id; of tables that name a column to read newest first by, the row's number in that order.
    """
    by = {t: c for t, c in tables.items() if c} if isinstance(tables, dict) else {}
    tables = list(tables)
    paths, far = databases(spark, roots, name, depth)
    out = spark.createDataFrame([], SCHEMA)
    if paths:
        for table in tables:
            rows = scan(spark, paths, table, "_path string, _mtime timestamp, _rowid long, _data string")
            rows = rows.selectExpr("_path as path", "_mtime as mtime", f"'{table}' as name", "_rowid as line_no", "_data as data")
            out = out.unionByName(_newest_first(rows, by[table]) if table in by else rows)
    if far:
        found = files.read_bytes(spark, far, name, depth).select("path", "mtime", "content")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for path, mtime, content in frame.itertuples(index=False):
                    rows = [(path, mtime, *r) for r in _rows(bytes(content), tables)]
                    if rows:
                        yield pd.DataFrame(rows, columns=["path", "mtime", "name", "line_no", "data"])

        rows = found.mapInPandas(run, SCHEMA)
        for table in tables:
            own = rows.filter(F.col("name") == table)
            out = out.unionByName(_newest_first(own, by[table]) if table in by else own)
    return out
