"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of ``documents``.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept. Columns
other than those of ``documents`` pass through all stages, whatever their names;
one named ``shard`` comes out of the last stage as ``shard_in``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlake.llm.common import materialize, read
from meterlake.llm.decontamination import flag_leaks
from meterlake.llm.langid import fold, identify, learn
from meterlake.llm.mixing import document_columns, mix, sizes_of
from meterlake.llm.sharding import assign_shards
from meterlake.llm.simhash import similar_texts

#: Bits a byte beyond which a text isn't in any learned language: about one phrase for every two bytes.
MOST_BITS = 7.0
#: Bytes of letters below which a text is too short to tell, and stays.
FEW_LETTERS = 64


def shielded(stage: Callable) -> Callable:
    """A stage to which columns that ``documents`` doesn't have go under names that no operator uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"extra {i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source", "n_chars")}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.withColumnsRenamed({n: f"{c}_in" if c in out.columns else c for c, n in names.items()})

    return run


@shielded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts that no learned language parses into phrases, go.

    Null and empty texts have no letters. Short texts stay if they have letters.
    An empty table stays empty; without labelled texts nothing is learned and
    every text is kept that has letters.
    """
    model = learn(docs, "text", "lang")
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    done = identify(docs, model)
    known = (F.col("lang_pred") != "und") & ((F.col("lang_bits") <= MOST_BITS) | (F.octet_length(fold(F.col("text"))) < FEW_LETTERS))
    return done.filter(known).select(*[f"`{c}`" for c in docs.columns])


@shielded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal or linked by a similarity of 0.8 in five-word shingles, the first by doc_id stays.

    Null doc_ids come last; of rows with one doc_id and linked texts, one stays.
    Null texts are empty, and all texts without words are linked. An empty table
    stays empty.
    """
    node, roots = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), similar_texts(docs)
    slim = docs.select("doc_id", node.alias("node")).groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("rows"))
    slim = slim.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = slim.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "rows")).alias("first"))
    first = materialize(first.select(F.col("first.doc_id").alias("first_"), F.col("first.node").alias("node_"), F.col("first.rows").alias("rows_")), "first")
    kept = docs.join(first.hint("merge"), (node == F.col("node_")) & F.col("doc_id").eqNullSafe(F.col("first_")))
    if not first.filter("rows_ > 1").isEmpty():
        kept = kept.dropDuplicates(["node_"])
    return kept.select(*[f"`{c}`" for c in docs.columns])


@shielded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and empty texts hold none, and an empty benchmark takes none."""
    return flag_leaks(docs, read(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select(*[f"`{c}`" for c in docs.columns])


@shielded
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes stay, as often as it takes them.

    A null source is a source like others; documents without words aren't taken;
    of equal rows, as many as the mix takes. An empty table stays empty.
    """
    mixed = mix(materialize(sizes_of(docs), "sizes")).filter("times * copies + more > 0 and size > 0")
    taken = materialize(mixed.select("doc_id", "src", "h", "copies", "times", "more").withColumnsRenamed({c: f"{c}_" for c in ("doc_id", "src", "h")}), "taken")
    own = document_columns()
    met = docs.join(taken, own["doc_id"].eqNullSafe(F.col("doc_id_")) & own["src"].eqNullSafe(F.col("src_")) & (own["h"] == F.col("h_")))
    place = F.lit(1)
    if not taken.filter("more > 0 and more < copies").isEmpty():  # some of equal rows, at most one such group a source
        place = F.row_number().over(W.partitionBy("doc_id_", "src_", "h_").orderBy("doc_id_"))
    more = F.when((F.col("more") == F.col("copies")) | (F.col("place_") <= F.col("more")), 1).otherwise(0)
    met = met.withColumn("place_", place).withColumn("times_", F.col("times") + more).filter("times_ > 0")
    return met.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times_")))).select(*[f"`{c}`" for c in docs.columns])


@shielded
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of 24 by their key; null keys share a shard, and so do equal ones."""
    return assign_shards(docs, F.col("doc_id"), [1.0] * 24).drop("grown_shard")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Cross-parsing and fingerprints aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
