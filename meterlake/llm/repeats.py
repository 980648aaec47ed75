"""Windows of ``n`` symbols that occur more than once in a corpus, found without comparing all pairs.

Shared by the byte-level (suffix sort) and the word-level (Rabin-Karp) substring
deduplication. A symbol is a byte or a word. The plan:

1. *Texts.* Distinct texts are written once, bucketed by two independent hashes
   (64 and 32 bits), so no later join shuffles them again.
2. *Anchors.* Every window picks its least ``gram``-symbol hash (a minimiser), so
   equal windows pick equal grams. A text of L symbols has about
   ``2 L / (n - gram)`` anchors; each owns a run of consecutive windows, its
   *block*. One slim row per anchor: (gram hash, block digest, text key, place).
   Gram hash and digest are independent 64-bit hashes of the block's content.
3. *Blocks.* Spark counts blocks. Grams with a single block that occurs once need
   no more work; the operator (``suffix_dedup``, ``window_dedup``) finds the
   repeated windows of the others.
4. *Removal.* Repeated windows become intervals of each text. Tables of runs are
   written before they are joined to the anchors, so that both sides of the join
   are plain shuffles and Spark splits the hot block of a very common passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, clustered, flat, materialize, slices, word_bounds
from .rolling import SPAN, anchors, byte_values, digests, mix, prefix, stretch, word_values

KEY = ["k1", "k2"]
OCCURRENCE = "ah long, bh long, k1 long, k2 int, ws int, nw int, ap int"


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """Rows with the two hashes that stand for their text; a null text is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"text_": t, "k1": F.xxhash64(t), "k2": F.hash(F.lit(7), t)})


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """(k1, k2, text_, copies), bucketed by key."""
    rows = keyed(docs.select(F.col(text).alias("text_")), "text_")
    return clustered(rows.groupBy(*KEY).agg(F.first("text_").alias("text_"), F.count(F.lit(1)).alias("copies")), KEY, "texts")


def symbols(buf: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """64-bit values of the symbols, what digests are taken of, where each row's symbols begin, and by how much a symbol reaches beyond its place."""
    if unit == "byte":
        return byte_values(buf), buf, offsets, SPAN - 1
    starts, ends, rows = word_bounds(buf, offsets)
    values = word_values(buf, starts, ends)
    return values, values, rows, 0


def _parts(offsets: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray, int, int]]:
    """Stretches of symbols to work on: whole rows, or overlapping pieces of one very long row."""
    for lo, hi in slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= 2 * STEP_BYTES:
            yield a, b, offsets[lo : hi + 1] - a, lo, 0
            continue
        for base in range(0, b - a, STEP_BYTES):
            end = min(b, a + base + STEP_BYTES + n - 1)
            yield a + base, end, np.array([0, end - a - base]), lo, base
            if end == b:
                break


def occurrences(buf: np.ndarray, offsets: np.ndarray, unit: str, n: int, gram: int) -> dict[str, np.ndarray]:
    """All anchors of some rows: row, gram hash, block digest, first window's start in its row, number of windows, distance of the gram from it."""
    values, content, offsets, reach = symbols(buf, offsets, unit)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "ah", "bh", "ws", "nw", "ap")}
    for a, b, offs, row, base in _parts(offsets, n):
        if b - a < n:
            continue
        h = prefix(values[a : b - reach])
        ends = np.maximum(offs[1:] - n + 1, offs[:-1])
        step = np.zeros(b - a + 1, np.int64)
        np.add.at(step, offs[:-1], 1)
        np.add.at(step, ends, -1)
        valid = np.cumsum(step)[: b - a - n + 1] > 0
        ah, pos, first, last = anchors(h, n - reach, gram - reach)
        # a run of windows with one pick may span rows: cut it where windows cross rows
        cut = np.zeros(len(valid) + 1, bool)
        cut[first] = True
        cut[np.flatnonzero(valid[1:] != valid[:-1]) + 1] = True
        begin = np.flatnonzero(cut[:-1])
        end = np.append(begin[1:], len(valid))
        keep = valid[begin]
        begin, end = begin[keep], end[keep]
        which = np.searchsorted(first, begin, side="right") - 1
        r = np.searchsorted(offs, begin, side="right") - 1
        out["row"].append(r + row)
        out["ah"].append(ah[which])
        out["bh"].append(digests(content, a + begin, a + end - 1 + n))
        out["ws"].append(begin - offs[r] + base)
        out["nw"].append(end - begin)
        out["ap"].append(pos[which] - begin)
    return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("ah", "bh") else np.int64) for k, v in out.items()}


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def anchor_rows(unit: str, n: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column("text_"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for lo, hi in slices(offsets, 4 * STEP_BYTES):
                a = offsets[lo]
                x = occurrences(buf[a : offsets[hi]], offsets[lo : hi + 1] - a, unit, n, gram)
                r = x["row"] + lo
                yield pa.RecordBatch.from_arrays([_long(x["ah"]), _long(x["bh"]), pa.array(k1[r]), pa.array(k2[r]), pa.array(x["ws"].astype(np.int32)), *(pa.array(x[c].astype(np.int32)) for c in ("nw", "ap"))], ["ah", "bh", "k1", "k2", "ws", "nw", "ap"])

    return run


def struct_lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A list-of-struct column as offsets and flat fields; a null list is empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat_ = column.flatten()
    return np.concatenate(([0], np.cumsum(lengths))), {f.name: flat_.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat_.type)}


def anchors_of(texts: DataFrame, unit: str, n: int, gram: int) -> DataFrame:
    return materialize(texts.select("text_", *KEY).mapInArrow(anchor_rows(unit, n, gram), OCCURRENCE), "anchors")


def asked_of(texts: DataFrame, blocks: DataFrame, fields: list[str]) -> DataFrame:
    """Texts with the list of their blocks that are asked for."""
    want = blocks.groupBy(*KEY).agg(F.collect_list(F.struct(*fields)).alias("want"))
    return texts.join(want, KEY)


def spans_of(occ: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """(k1, k2, spans): intervals in symbols of each text from runs (ah, bh, s, e) of repeated windows, counted from their block's first."""
    runs = materialize(runs.groupBy("ah", "bh").agg(F.collect_set(F.struct("s", "e")).alias("runs")), "runs")
    spans = occ.join(runs, ["ah", "bh"]).select(*KEY, F.expr(f"transform(runs, r -> named_struct('s', ws + r.s, 'e', ws + r.e + {n - 1}))").alias("spans"))
    return spans.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals; touching ones merge."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    on = np.concatenate(([False], np.cumsum(step)[:-1] > 0, [False]))
    return np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(on[:-1] & ~on[1:])
