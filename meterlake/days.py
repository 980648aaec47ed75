"""A history kept by UTC day and version: a merge writes the days that it touches, and a small pointer file last.

``_versions/000000000007.json`` names the folder of each day. Readers take the
newest whole pointer; folders are never changed, so they see one version however
long they read. A writer names the version that it read: if another writer was
first, its pointer can't be created and nothing of its work shows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import conform, empty
from .sources.sqlite import local_path

UNKNOWN = "unknown"


class Conflict(Exception):
    """Another writer has committed since the version that this one read."""


@dataclass(frozen=True)
class Version:
    """The number of a version and its days' folders; 0 and none of an empty history."""

    number: int
    days: dict[str, str]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _pointer(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/_versions/{number:012d}.json"


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A file that mustn't exist yet: a hard link on a local disk, an exclusive create in other stores."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    if near := local_path(path):
        beside = f"{near}.{uuid.uuid4().hex}.tmp"
        with open(beside, "w") as out:
            out.write(text)
        try:
            os.link(beside, near)
        except FileExistsError:
            raise Conflict(path) from None
        finally:
            os.unlink(beside)
        return
    if fs.exists(p):
        raise Conflict(path)
    try:
        stream = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict(path) from e
        raise
    stream.write(bytearray(text.encode()))
    stream.close()


def current(spark: SparkSession, path: str) -> Version:
    """The newest version. A pointer that a stopped writer left unfinished is no version, but its number is taken."""
    names = [n for n in _names(spark, f"{path.rstrip('/')}/_versions") if n.endswith(".json")]
    for name in reversed(names):
        try:
            return Version(int(names[-1][:-5]), json.loads(_text(spark, f"{path.rstrip('/')}/_versions/{name}"))["days"])
        except (ValueError, KeyError):
            continue
    return Version(int(names[-1][:-5]) if names else 0, {})


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path.rstrip('/')}/_versions")
    return bool(fs.exists(p))


def read(spark: SparkSession, path: str, version: Version | None = None, days: Iterable[str] | None = None) -> DataFrame:
    """Rows of a version (the newest), or of some of its days; other days' files aren't listed."""
    held = (version or current(spark, path)).days
    wanted = [f"{path.rstrip('/')}/{held[d]}" for d in (held if days is None else days) if d in held]
    return conform(spark.read.parquet(*wanted)) if wanted else empty(spark)


def day_of() -> Column:
    return F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(UNKNOWN))


def commit(rows: DataFrame, path: str, based_on: Version, touched: Iterable[str]) -> Version:
    """Replace the ``touched`` days of a version by ``rows`` (days without rows go); Conflict if it isn't the newest any more.

    Rows must be of touched days. Partitions are rebalanced by day: small days share a task, a large one is cut over several.
    """
    spark, touched = rows.sparkSession, set(touched)
    folder = f"days/{uuid.uuid4().hex}"
    dated = rows.withColumn("day", day_of())
    dated.hint("rebalance", "day").write.partitionBy("day").parquet(f"{path.rstrip('/')}/{folder}")
    made = {n.removeprefix("day="): f"{folder}/{n}" for n in _names(spark, f"{path.rstrip('/')}/{folder}") if n.startswith("day=")}
    if set(made) - touched:
        raise ValueError(f"rows of days that aren't touched: {sorted(set(made) - touched)}")
    days = {d: f for d, f in based_on.days.items() if d not in touched} | made
    _create(spark, _pointer(path, based_on.number + 1), json.dumps({"days": days}))
    return Version(based_on.number + 1, days)


def update(spark: SparkSession, path: str, touched: Callable[[Version], Iterable[str]], merge: Callable[[DataFrame], DataFrame], tries: int = 5) -> Version:
    """Merge into the newest version: ``touched`` says which days, ``merge`` makes their rows from what they hold. Tried again when another writer was first."""
    for left in range(tries, 0, -1):
        version = current(spark, path)
        days = sorted(set(touched(version)))
        try:
            return commit(merge(read(spark, path, version, days)), path, version, days)
        except Conflict:
            if left == 1:
                raise
    raise AssertionError


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the folders of days that none of the last ``keep`` versions names, and older pointers; how many folders went."""
    path = path.rstrip("/")
    names = [n for n in _names(spark, f"{path}/_versions") if n.endswith(".json")]
    held: set[str] = set()
    whole = 0
    for name in reversed(names):
        if whole < keep:
            try:
                held |= set(json.loads(_text(spark, f"{path}/_versions/{name}"))["days"].values())
                whole += 1
            except (ValueError, KeyError):
                continue
        else:
            fs, p = _fs(spark, f"{path}/_versions/{name}")
            fs.delete(p, False)
    gone = 0
    for batch in _names(spark, f"{path}/days"):
        days = [f"days/{batch}/{n}" for n in _names(spark, f"{path}/days/{batch}") if n.startswith("day=")]
        for d in days:
            if d not in held:
                fs, p = _fs(spark, f"{path}/{d}")
                fs.delete(p, True)
                gone += 1
        if days and not held.intersection(days):
            fs, p = _fs(spark, f"{path}/days/{batch}")
            fs.delete(p, True)
    return gone
