"""Substring dedup over words: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

Every window of ``n`` words has a Rabin-Karp hash over word hashes. Windows that
cannot repeat are set aside by their minimiser blocks first (see ``repeats``);
the windows of a block, which have all words but a few in common, are counted
together by the hash of the stretch that they span, and the windows of blocks
that differ under one minimiser one by one. Spark does the counting; repeated
windows merge into maximal removal intervals. Two windows count as equal when
their Rabin-Karp hash, an XXH3 digest of their words and their minimiser agree
(64 bits each; a word is hashed by mixing its bytes, which is no polynomial).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, materialize, read, word_bounds
from .repeats import KEY, anchors_of, asked_of, covered, distinct_texts, keyed, spans_of, struct_lists
from .rolling import digests, mix, prefix, stretch, word_values

WINDOW = "ah long, bh long, wh long, xh long, at int"
SCHEMA = "k1 long, k2 int, n_words long, n_removed long, n_spans long, kept string"


def _window_rows(n: int):
    """(gram, block, window hash, window digest, place in the block) of each window of the blocks asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column("text_"))
            at, want = struct_lists(batch.column("want"))
            for i in range(batch.num_rows):
                lo, hi = at[i], at[i + 1]
                if lo == hi:
                    continue
                part = buf[offsets[i] : offsets[i + 1]]
                starts, ends, _ = word_bounds(part, np.array([0, len(part)]))
                values = word_values(part, starts, ends)
                ws, nw = want["ws"][lo:hi].astype(np.int64), want["nw"][lo:hi].astype(np.int64)
                for j in range(0, hi - lo, 4096):  # some ten thousand windows at a time
                    s, m = ws[j : j + 4096], nw[j : j + 4096]
                    which = np.repeat(np.arange(len(s)), m)
                    place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    start = s[which] + place
                    first, end = int(start.min()), int(start.max()) + n
                    wh = mix(stretch(prefix(values[first:end]), start - first, start - first + n))
                    xh = digests(values, start, start + n)
                    yield pa.RecordBatch.from_arrays([pa.array(want["ah"][lo + j : hi][which]), pa.array(want["bh"][lo + j : hi][which]), pa.array(wh.view(np.int64)), pa.array(xh.view(np.int64)), pa.array(place.astype(np.int32))], ["ah", "bh", "wh", "xh", "at"])

    return run


def window_runs(texts: DataFrame, occ: DataFrame, n: int) -> DataFrame:
    """(ah, bh, s, e): runs of windows, counted from their block's first, that occur elsewhere too."""
    blocks = occ.groupBy("ah", "bh").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "ws", "nw")).alias("one"))
    several = materialize(blocks.groupBy("ah").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1"), "several")
    known = materialize(blocks.join(several, "ah", "left").filter("c > 1 or blocks > 1").select("ah", "bh", "c", "one.*", "blocks"), "blocks")
    whole = known.filter("c > 1").select("ah", "bh", F.lit(0).alias("s"), F.col("nw").alias("e"))
    rows = asked_of(texts, known.filter("blocks > 1"), ["ah", "bh", "ws", "nw"]).mapInArrow(_window_rows(n), WINDOW)
    twice = rows.groupBy("wh", "xh").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("wh", "xh")
    partly = rows.join(twice, ["wh", "xh"], "left_semi").select("ah", "bh", F.col("at").alias("s"), (F.col("at") + 1).alias("e"))
    return whole.unionByName(partly)


def _remove(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column("text_"))
            at, span = struct_lists(batch.column("spans"))
            copies = batch.column("copies").to_numpy()
            words, removed, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                part = buf[offsets[i] : offsets[i + 1]]
                starts, ends, _ = word_bounds(part, np.array([0, len(part)]))
                m, raw = len(starts), part.tobytes()
                if m and copies[i] > 1 and m >= n:
                    a, b = np.array([0]), np.array([m])
                else:
                    a, b = covered(span["s"][at[i] : at[i + 1]], span["e"][at[i] : at[i + 1]], m) if at[i] < at[i + 1] else (np.zeros(0, int), np.zeros(0, int))
                words.append(m)
                removed.append(int((b - a).sum()))
                spans.append(len(a))
                gone = np.zeros(m, bool)
                for x, y in zip(a, b, strict=True):
                    gone[x:y] = True
                kept.append(b" ".join(raw.split()).decode() if not len(a) else b" ".join(w for w, g in zip(raw.split(), gone, strict=True) if not g).decode())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["k1", "k2", "n_words", "n_removed", "n_spans", "kept"])

    return run


def remove_repeated_windows(docs: DataFrame, text: str = "text", n: int = 35, gram: int = 8) -> DataFrame:
    """(k1, k2, n_words, n_removed, n_spans, kept) for each distinct text, to be joined by ``keyed``.

    A word goes if any window of ``n`` words that covers it occurs again, in the
    same text or another; windows are judged on the input. ``kept`` is the kept
    words joined by one space. Null and empty texts have no words; texts of
    fewer than ``n`` words keep all; repeated rows are repeats of each other.
    Other columns of ``docs`` aren't read, whatever their names; an empty table
    gives none.
    """
    texts = distinct_texts(docs, text)
    occ = anchors_of(texts, "word", n, gram)
    spans = spans_of(occ, window_runs(texts, occ, n), n)
    return texts.join(spans, KEY, "left").select(*KEY, "text_", "copies", "spans").mapInArrow(_remove(n), SCHEMA)


def op10_window_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    done = remove_repeated_windows(docs).select(*KEY, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return keyed(docs.select("doc_id", "text"), "text").select("doc_id", *KEY).join(done, KEY).drop(*KEY)
