"""Whole objects out of JSON text that was cut off or damaged."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# A string (open-ended if the text stops within it), or a brace outside of strings.
_MARK = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)


def outer_objects(text: str | None) -> Iterator[str]:
    """The outermost stretches from a brace to its own closing one that are JSON, in order."""
    depth, start = 0, 0
    for mark in _MARK.finditer(text or ""):
        c = mark[0]
        if c == "{":
            if not depth:
                start = mark.start()
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                found = text[start : mark.end()]
                try:
                    json.loads(found)
                except ValueError:
                    continue
                yield found


def salvage(text: Column) -> Column:
    """The objects (JSON) that can be read in a text: of a cut array all but the last; none of text without objects, or null."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(outer_objects(t)))

    return found(text)
