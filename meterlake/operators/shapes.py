"""Usage in JSON of unknown shape: values are opened level by level until each branch shows tokens or ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import usage
from ..functions.usage import is_object, kind_of
from ..tables import cut


def usage_within(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, place, found, b): objects with token counts anywhere within the variants ``value``.

    ``place`` is the way to the object (``$.a[2].b``), ``found`` the object, ``b`` its
    counts. An object that has counts, itself or in its usage, isn't opened further,
    so nothing counts twice; all others are, however deep. Each level is one pass
    over what is left of the one before, so passes are as many as values are deep.
    """
    level = cut(rows.filter(F.col(value).isNotNull()).select(*keys, F.lit("$").alias("place"), F.col(value).alias("found")))
    out = None
    while out is None or not level.isEmpty():
        counted = usage.with_buckets(level.filter(is_object(F.col("found"))), F.col("found"))
        counted = cut(counted.select(*keys, "place", F.to_json("found").alias("json"), "b"))
        out = counted if out is None else out.unionByName(counted)
        opened = level.join(counted.select(*keys, "place"), [*keys, "place"], "left_anti")
        opened = opened.filter(is_object(F.col("found")) | F.coalesce(kind_of(F.col("found")).startswith("ARRAY"), F.lit(False)))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        inner = opened.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("found").outer())).select(*keys, F.concat("place", step).alias("place"), F.col("value").alias("found"))
        level = cut(inner.filter(is_object(F.col("found")) | F.coalesce(kind_of(F.col("found")).startswith("ARRAY"), F.lit(False))))
    return out.select(*keys, "place", F.parse_json("json").alias("found"), "b")
