"""Files that routers append to while they run, for the live rate, and files that an index names."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from posixpath import join, normpath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import live_hot_rows
from .files import existing, read_documents, read_named
from .tail import read_tail

# Agents and their request logs below the folder of mirrors.
HOT_FILES = [
    ("9router", "9router/usage-history.jsonl"),
    ("routerlab", "routerlab/request-details.jsonl"),
    ("routerlab", "routerlab/usage-history.jsonl"),
    ("routerlab", "xlabrouter/request-details.jsonl"),
    ("routerlab", "xlabrouter/usage-history.jsonl"),
    ("litellm", "litellm/usage-history.jsonl"),
]
#: Bytes at a file's end that the live rate looks at.
TAIL_BYTES = 512 * 1024
# Keys whose text is a path.
PATH_KEYS = ("path", "file", "session", "transcript")


def read_hot(spark: SparkSession, mirrors: str, now: datetime, minutes: int = 30, tail: int = TAIL_BYTES) -> DataFrame:
    """Usage rows of single calls of the last minutes, of the last ``tail`` bytes of each file."""
    lines = read_tail(spark, existing(spark, [f"{mirrors.rstrip('/')}/{f}" for _, f in HOT_FILES]), tail)
    agent = F.lit(None).cast("string")
    for a, f in HOT_FILES:
        agent = F.when(F.col("path").endswith(f"/{f}"), a).otherwise(agent)
    return live_hot_rows(lines.withColumn("agent", agent), now, minutes)


def _references(value, base: str) -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            named = isinstance(v, str) and v and any(x in k.lower() for x in PATH_KEYS)
            yield from [join(base, v)] if named else _references(v, base)
    elif isinstance(value, list):
        for v in value:
            yield from _references(v, base)
    elif isinstance(value, str) and value.endswith((".jsonl", ".json")):
        yield join(base, value)


def path_references(document: Column, folder: Column) -> Column:
    """Distinct paths that a JSON document names, relative ones from ``folder``: texts that end with .json or .jsonl, and texts under keys that speak of paths."""

    @F.pandas_udf("array<string>")
    def find(documents: pd.Series, folders: pd.Series) -> pd.Series:
        out = []
        for d, base in zip(documents, folders, strict=True):
            try:
                out.append(list(dict.fromkeys(normpath(p) for p in _references(json.loads(d or "null"), base or ""))))
            except ValueError:
                out.append([])
        return pd.Series(out)

    return find(document, folder)


def follow_index(spark: SparkSession, roots: list[str], index: str = r"(^|/)sessions\.json$") -> DataFrame:
    """Lines (path, mtime, line_no, value) of the files that index documents below ``roots`` name, wherever those are.

    The names are collected: there are as many as the indexes list files.
    """
    documents = read_documents(spark, roots, index)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    plain = F.regexp_replace(folder, "^file:/+", "/")
    named = documents.select(F.explode(path_references(F.col("value"), plain)).alias("named")).filter(r"named rlike '[.]jsonl?$'").distinct()
    return read_named(spark, sorted(r.named for r in named.collect()))
