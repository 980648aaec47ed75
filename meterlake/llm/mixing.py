"""Mixing sources to target weights by hash-threshold histograms.

Each row has a uniform 60-bit hash. Per source, sizes are summed by the hash's
leading bits; the running sums show the bucket in which the source's budget
ends. Only the rows of that boundary bucket, which are written once, are summed
again by the next bits, until the hash is used up; then a row is taken if its hash
is below the threshold. Nothing is sorted, and a smaller budget takes a subset of
a larger one's rows. DataFrame functions only.

Rows that are equal have equal hashes, however many they are. They are merged
first and counted, and where the threshold falls on them, as many of them are
taken as come nearest to the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, aside, fresh, materialize, read, small_join

BITS, LEVELS = 10, 6  # 1024 buckets a level, 60 bits of hash


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(*keys: Column) -> Column:
    """60 bits of MD5 over the keys' text, so that other engines can compute it too."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], cap: float, budget: Column) -> DataFrame:
    """Targets of sources (src, source_size): shares of ``budget`` by weight, none above ``cap`` times its size.

    Sharing the excess again and again by weight until no source is above ends
    at min(cap_i, L * weight_i); in order of cap_i / weight_i the sources at
    their cap come first, and running sums give L. One row per source.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("src").asc_nulls_last())) - 1).withColumns({"weight": cycle, "most": F.col("source_size") * F.lit(float(cap))})
    order = W.orderBy(F.col("most") / F.col("weight"), "rank")
    ahead, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (budget - F.coalesce(F.sum("most").over(ahead), F.lit(0.0))) / F.sum("weight").over(rest)
    tried = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("most") / F.col("weight"))
    first = F.max(F.when(F.col("fits"), F.col("level"))).over(W.partitionBy())
    return tried.withColumn("target", F.least("most", F.coalesce(first * F.col("weight"), F.col("most")))).select("src", "source_size", "target")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src, cut, rest): rows of a lower hash than ``cut`` are taken, and of those at ``cut`` a size of ``rest``.

    ``rows`` have (src, h, size), ``wanted`` (src, need); sources aren't null.
    """
    state = wanted.select("src", F.lit(0).cast("long").alias("prefix"), F.col("need").cast("double"), F.lit(False).alias("ends"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("h", shift)
        open_ = state.filter(~F.col("ends")).select(F.col("src").alias("_s"), "prefix", "need")
        if level:
            key = F.shiftright("h", shift + BITS)
            rows = small_join(rows.withColumns({"_s": F.col("src"), "prefix": key}), open_.select("_s", "prefix"), ["_s", "prefix"], "inner").drop("_s", "prefix")
            rows = materialize(rows, "boundary") if level == 1 else rows  # about one row in 2**BITS
        sums = rows.withColumn("b", bucket).groupBy("src", "b").agg(F.sum("size").alias("size"))
        run = W.partitionBy("src").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
        seen = sums.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).join(open_.select(F.col("_s").alias("src"), "need"), "src")
        edge = seen.filter((F.col("before") <= F.col("need")) & (F.col("before") + F.col("size") > F.col("need")))
        edge = edge.select(F.col("src").alias("_s"), F.col("b").alias("p"), (F.col("need") - F.col("before")).alias("n"))
        # where the budget reaches past all rows of a bucket, the cut is at its end
        past = (F.col("prefix") + 1) * F.lit(1 << BITS)
        moved = open_.join(edge, "_s", "left").select(F.col("_s").alias("src"), F.coalesce("p", past).alias("prefix"), F.coalesce("n", F.lit(0.0)).alias("need"), F.col("p").isNull().alias("ends"))
        done = state.filter("ends").select("src", (F.col("prefix") * F.lit(1 << BITS) if level else F.col("prefix")).alias("prefix"), "need", "ends")
        state = materialize(moved.unionByName(done), f"cut{level}")
    return state.select("src", F.col("prefix").alias("cut"), F.col("need").alias("rest"))


def mix(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, budget: float = 1.0) -> DataFrame:
    """Rows (src, h, size, copies) with source_size, target, ``times`` and ``more``.

    A row stands for ``copies`` equal rows of ``size`` words each. All of them are
    taken ``times`` times, and ``more`` of them once more. ``budget`` is a share of
    all sizes. A source whose target is r times its size takes every row floor(r)
    times and, by its hash, some rows once more: no row more than ceil(cap) times.
    A source without words has target 0; null is a source like others and comes
    last; null sizes are 0. An empty table stays empty. Other columns of the rows
    are returned as they are.
    """
    known = aside(rows, "source_size", "target", "times", "more").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    tag = fresh(known, "tag")
    sizes = known.groupBy("src").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    plan = targets(sizes, weights, cap, F.sum("source_size").over(W.partitionBy()) * F.lit(float(budget)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0).cast("long")
    plan = materialize(plan.withColumn("times", whole).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("times") * F.col("source_size"))), "targets")
    named = F.when(F.col("src").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("src")))  # nulls don't join
    known = known.withColumn(tag, named)
    cuts = thresholds(known.filter("size > 0").select(F.col(tag).alias("src"), "h", (F.col("size") * F.col("copies")).alias("size")), plan.select(named.alias("src"), "need"))
    plan = plan.withColumn(tag, named).join(cuts.withColumnRenamed("src", tag), tag, "left").select(tag, "source_size", "target", "times", F.col("cut").alias("more"), "rest")
    plan = materialize(plan, "plan").withColumnRenamed("more", "cut")
    out = small_join(known, plan.withColumnsRenamed({"cut": f"{tag}cut", "rest": f"{tag}rest"}), [tag])
    some = F.least(F.round(F.col(f"{tag}rest") / F.col("size")).cast("long"), F.col("copies"))
    more = F.when(F.col("size") == 0, 0).when(F.col("h") < F.col(f"{tag}cut"), F.col("copies")).when(F.col("h") == F.col(f"{tag}cut"), some).otherwise(0)
    return out.withColumn("more", F.coalesce(more, F.lit(0)).cast("long")).drop(tag, f"{tag}cut", f"{tag}rest")


def one_by_one(rows: DataFrame, place: str, step: int = 1 << 20) -> DataFrame:
    """Merged rows one by one, numbered from 1 in ``place``: at first in stretches of ``step``, which are dealt anew, so that a large group is spread."""
    most = rows.agg(F.max("copies")).first()[0] or 0
    if most > step:
        first = fresh(rows, "first")
        rows = rows.withColumn(first, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(step).cast("long")))).repartition(first)
        return rows.withColumn(place, F.explode(F.sequence(F.col(first), F.least("copies", F.col(first) + step - 1)))).drop(first)
    return rows.withColumn(place, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def document_columns() -> dict[str, Column]:
    """What ``sizes_of`` takes of a document: its key, source, words and the hash of key and text."""
    h = row_hash(F.col("doc_id"), F.md5(F.col("text").cast("binary")))
    return {"doc_id": F.col("doc_id"), "src": F.col("source"), "size": word_count(F.col("text")), "h": h}


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, src, size, h, copies): equal rows merged."""
    rows = docs.select(*[c.alias(n) for n, c in document_columns().items()])
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(materialize(sizes_of(read(spark, sf_dir, "documents")), "sizes"))
    taken = F.col("size") * (F.col("times") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0))
    return one_by_one(mixed, "place").select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.alias("taken"))


#: The same rows by sorting: running sums over the hash order of each source; equal rows are numbered.
SQL = r"""
WITH d AS (SELECT doc_id, source AS src, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
                  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS k FROM d GROUP BY src),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS most FROM s),
t AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT max(CASE WHEN level <= most / weight THEN level END) AS level FROM t),
p AS (SELECT src, source_size, least(most, coalesce(l.level * weight, most)) AS target FROM t, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM p),
g AS (SELECT src, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY src ORDER BY h) - sum(size) AS before FROM d GROUP BY src, h),
x AS (SELECT g.src, g.h, greatest(0, q.target - q.whole * q.source_size) - before AS rest, g.size FROM g JOIN q ON g.src IS NOT DISTINCT FROM q.src),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, src, h, size) AS place FROM d)
SELECT n.doc_id, CAST(n.size AS BIGINT) AS size, q.source_size, round(q.target, 6) AS target,
       CAST(n.size * (q.whole + CASE WHEN n.size = 0 OR x.rest < 0 THEN 0 WHEN x.size <= x.rest OR n.place <= round(x.rest / n.size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n JOIN q ON n.src IS NOT DISTINCT FROM q.src JOIN x ON n.src IS NOT DISTINCT FROM x.src AND n.h = x.h
"""
