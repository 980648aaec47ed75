"""Substring dedup over bytes by a hash-compared suffix sort.

Equal windows share their minimiser and their distance to it, so suffixes that
could have a common prefix of ``n`` bytes meet in one bucket: (minimiser,
distance). In a bucket, suffixes are merge-sorted; two of them are compared by
their common extension, found by binary search over prefix polynomial hashes in
a logarithmic number of steps. Neighbours in the sorted order with a common
extension of ``n`` bytes are repeats once their bytes have been compared too,
which guards against hash collisions. All buckets of a batch are sorted at once
with numpy.

Every repeat passes this sort. A block stands for all its occurrences (they have
equal 64-bit digests and equal gram hashes); two of them are sorted, so that a
block that occurs twice meets itself there.

A minimiser with more blocks than one sort takes (a passage that very many texts
share) is cut finer: windows at neighbouring distances share all but a few bytes,
and the digest of what they share is a longer gram that parts those blocks which
have the passage but not its surroundings. Blocks are cut by distance into parts
of ``STEPS`` windows, whose longer grams are the new groups; where such a group is
still too large, into single windows. A group then has one distinct window. So no
group is sorted in one task beyond the limit, and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import flat, materialize, read
from .repeats import KEY, anchors_of, asked_of, covered, distinct_texts, keyed, spans_of, struct_lists
from .rolling import SPAN, byte_values, digests, loads, mix, prefix, stretch

#: Windows in a part of a block, for the first and the second cut.
STEPS = (16, 1)
BLOCK = "ah long, bh long, block binary, ap int, nw int"
PART = f"pa long, pb long, off int, {BLOCK}"
RUNS = "ah long, bh long, s int, e int"
SCHEMA = "k1 long, k2 int, n_bytes long, n_removed long, n_spans long, kept binary"


def _extension(h: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Number of equal symbols, up to ``n``, from ``a`` and ``b`` on, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), n, np.int64)
    for _ in range(int(n).bit_length()):
        mid = (low + high + 1) >> 1
        same = stretch(h, a, a + mid) == stretch(h, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _less(order: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether suffix a < suffix b, and whether they are equal over ``n`` symbols; ``order`` are big-endian symbols."""
    same = stretch(h, a, a + n) == stretch(h, b, b + n)
    less = np.zeros(len(a), bool)
    i = np.flatnonzero(~same)
    ext = _extension(h, a[i], b[i], n - 1)
    less[i] = order[a[i] + ext] < order[b[i] + ext]
    return less, same


def suffix_sort(data: np.ndarray, h: np.ndarray, at: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Order of the suffixes ``at`` within their buckets (``bucket`` ascending): bottom-up mergesort of all buckets at once."""
    count = len(at)
    order = np.arange(count)
    first = np.searchsorted(bucket, bucket, side="left")
    size = np.searchsorted(bucket, bucket, side="right") - first
    place = np.arange(count) - first
    width, most = 1, int(size.max(initial=0))
    while width < most:
        run = place // width
        sibling = (run ^ 1) * width
        length = np.minimum(sibling + width, size) - sibling
        todo = np.flatnonzero(length > 0)
        mine, left = at[order[todo]], (run[todo] & 1) == 0
        low, high = np.zeros(len(todo), np.int64), length[todo].copy()
        base = first[todo] + sibling[todo]
        while True:  # the number of the sibling run's suffixes that go before this one
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            other = at[order[base[open_] + mid]]
            less, same = _less(data, h, other, mine[open_], n)
            before = less | (same & ~left[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        to = np.arange(count)
        pair = (run[todo] >> 1) * 2 * width
        to[todo] = first[todo] + pair + (place[todo] - run[todo] * width) + low
        new = np.empty_like(order)
        new[to] = order
        order = new
        width *= 2
    return order


def _sort_batch(n: int, ah: np.ndarray, bh: np.ndarray, data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, nw: np.ndarray) -> pa.RecordBatch:
    h = prefix(byte_values(data))
    size = n - SPAN + 1  # in symbols
    which = np.repeat(np.arange(len(nw)), nw)
    place = np.arange(nw.sum()) - np.repeat(np.cumsum(nw) - nw, nw)
    at = offsets[:-1][which] + place
    group = np.cumsum(np.concatenate(([0], ah[1:] != ah[:-1]))) if len(ah) else ah
    bucket = group[which] * (2 * n) + (anchor[which] - place)
    by = np.argsort(bucket, kind="stable")
    at, which, place, bucket = at[by], which[by], place[by], bucket[by]
    order = suffix_sort(loads(data, big=True).astype(np.uint64), h, at, bucket, size)
    at, which, place = at[order], which[order], place[order]
    x, y = at[:-1], at[1:]
    near = np.flatnonzero((bucket[1:] == bucket[:-1]) & (stretch(h, x, x + size) == stretch(h, y, y + size)))
    true = np.zeros(len(near), bool)
    for i in range(0, len(near), 4096):  # compare the bytes themselves
        p, q = x[near[i : i + 4096]], y[near[i : i + 4096]]
        true[i : i + 4096] = (data[p[:, None] + np.arange(n)] == data[q[:, None] + np.arange(n)]).all(axis=1)
    hit = np.zeros(len(at), bool)
    hit[near[true]] = True
    hit[near[true] + 1] = True
    w, p = which[hit], place[hit]
    by = np.lexsort((p, w))
    w, p = w[by], p[by]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1))) if len(w) else np.zeros(0, bool)
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(w)) - 1 if len(w) else s
    return pa.RecordBatch.from_arrays([pa.array(ah[w[s]]), pa.array(bh[w[s]]), pa.array(p[s].astype(np.int32)), pa.array((p[e] + 1).astype(np.int32))], ["ah", "bh", "s", "e"])


def _block_rows(n: int):
    """The bytes of each block asked for, with its minimiser's place and its number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column("text_"))
            at, want = struct_lists(batch.column("want"))
            base = np.repeat(offsets[:-1], np.diff(at))
            for i in range(0, len(base), 8192):
                s = base[i : i + 8192] + want["ws"][i : i + 8192]
                m = want["nw"][i : i + 8192]
                blocks = [buf[x : x + k + n - 1].tobytes() for x, k in zip(s.tolist(), m.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(want["ah"][i : i + 8192]), pa.array(want["bh"][i : i + 8192]), pa.array(blocks, pa.binary()), pa.array(want["ap"][i : i + 8192]), pa.array(m)], ["ah", "bh", "block", "ap", "nw"])

    return run


def _sort_blocks(n: int, at_once: int):
    """Suffix-sort the blocks of whole grams, which come sorted by gram, ``at_once`` blocks or a few more at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sort(table: pa.Table) -> pa.RecordBatch:
            data, offsets = flat(table.column("block"))
            return _sort_batch(n, *(table.column(c).to_numpy() for c in ("ah", "bh")), data, offsets, *(table.column(c).to_numpy().astype(np.int64) for c in ("ap", "nw")))

        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, more]) if held is not None else more
            while held.num_rows > at_once:
                ah = held.column("ah").to_numpy()
                cut = np.flatnonzero(ah[1:] != ah[:-1]) + 1
                cut = cut[cut <= at_once][-1:] if (cut <= at_once).any() else cut[:1]
                if not len(cut):
                    break
                yield sort(held.slice(0, int(cut[0])))
                held = held.slice(int(cut[0]))
        if held is not None and held.num_rows:
            yield sort(held)

    return run


def _sorted_runs(blocks: DataFrame, n: int, most: int) -> DataFrame:
    return blocks.select("ah", "bh", "block", "ap", "nw").repartition("ah").sortWithinPartitions("ah", "bh").mapInArrow(_sort_blocks(n, most), RUNS)


def _cut(n: int, step: int):
    """Parts of blocks: ``step`` windows at neighbouring distances from the gram, with the digest of what such windows share as their gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("block"))
            ah, bh, ap, nw = (batch.column(c).to_numpy() for c in ("ah", "bh", "ap", "nw"))
            # window j stands ap - j before the gram; cells of distances count down along a block
            last, first = (ap - nw + 1) // step, ap // step
            count = first - last + 1
            which = np.repeat(np.arange(len(ap)), count)
            cell = first[which] - (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
            begin = np.maximum(ap[which] - (cell + 1) * step + 1, 0)
            end = np.minimum(ap[which] - cell * step + 1, nw[which])
            core = offsets[which] + ap[which] - cell * step
            key = mix(digests(data, core, core + n - step + 1) ^ mix(ah[which].view(np.uint64) + cell.astype(np.uint64)))
            part, stop = offsets[which] + begin, offsets[which] + end - 1 + n
            own = digests(data, part, stop)
            for i in range(0, len(which), 8192):
                j = slice(i, i + 8192)
                raw = [data[x:y].tobytes() for x, y in zip(part[j].tolist(), stop[j].tolist(), strict=True)]
                w = which[j]
                numbers = [begin[j], *(x.view(np.int64) for x in (key[j], own[j]))]
                yield pa.RecordBatch.from_arrays([pa.array(ah[w]), pa.array(bh[w]), pa.array(numbers[0].astype(np.int32)), pa.array(numbers[1]), pa.array(numbers[2]), pa.array(raw, pa.binary()), pa.array((ap[w] - begin[j]).astype(np.int32)), pa.array((end[j] - begin[j]).astype(np.int32))], ["pa", "pb", "off", "ah", "bh", "block", "ap", "nw"])

    return run


def _large_runs(blocks: DataFrame, n: int, most: int, steps: tuple[int, ...]) -> DataFrame:
    """Runs of blocks whose grams have too many, by cutting them into parts with longer grams."""
    parts = materialize(blocks.mapInArrow(_cut(n, steps[0]), PART), "parts")
    twice = parts.withColumn("i", F.row_number().over(W.partitionBy("ah", "bh").orderBy("pa", "pb", "off"))).filter("i <= 2").drop("i")
    kept = materialize(twice, "kept")
    groups = materialize(kept.groupBy("ah").agg(F.count(F.lit(1)).alias("places")).filter("places > 1"), "groups")
    kept = kept.join(groups, "ah")
    runs = _sorted_runs(kept.filter(F.col("places") <= most), n, most)
    if len(steps) > 1 and (groups.agg(F.max("places")).first()[0] or 0) > most:
        runs = runs.unionByName(_large_runs(kept.filter(F.col("places") > most).select("ah", "bh", "block", "ap", "nw"), n, most, steps[1:]))
    runs = materialize(runs.distinct(), "runs")
    return parts.select("pa", "pb", "off", "ah", "bh").join(runs, ["ah", "bh"]).select(F.col("pa").alias("ah"), F.col("pb").alias("bh"), (F.col("off") + F.col("s")).alias("s"), (F.col("off") + F.col("e")).alias("e"))


def suffix_runs(texts: DataFrame, occ: DataFrame, n: int, most_blocks: int = 1024) -> DataFrame:
    """(ah, bh, s, e): runs of windows, counted from their block's first, that occur elsewhere too.

    A task sorts about ``most_blocks`` blocks at a time, whole grams only.
    """
    place = F.struct("k1", "k2", "ws", "nw", "ap")
    blocks = occ.groupBy("ah", "bh").agg(F.min(place).alias("one"), F.max(place).alias("other"))
    several = F.when(F.col("one") == F.col("other"), 1).otherwise(2)
    groups = materialize(blocks.groupBy("ah").agg(F.sum(several).alias("places")).filter("places > 1"), "groups")
    asked = blocks.join(groups, "ah").select("ah", "bh", "places", F.explode(F.array_distinct(F.array("one", "other"))).alias("at")).select("ah", "bh", "places", "at.*")
    asked = materialize(asked, "asked")
    fields = ["ah", "bh", "ws", "nw", "ap"]

    def take(rows: DataFrame) -> DataFrame:
        return asked_of(texts, rows, fields).mapInArrow(_block_rows(n), BLOCK)

    runs = _sorted_runs(take(asked.filter(F.col("places") <= most_blocks)), n, most_blocks)
    if (groups.agg(F.max("places")).first()[0] or 0) > most_blocks:
        runs = runs.unionByName(_large_runs(materialize(take(asked.filter(F.col("places") > most_blocks)), "large"), n, most_blocks, STEPS))
    return runs


def _remove(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column("text_"))
            at, span = struct_lists(batch.column("spans"))
            copies = batch.column("copies").to_numpy()
            size, removed, spans, kept = np.diff(offsets), [], [], []
            for i, m in enumerate(size.tolist()):
                part = buf[offsets[i] : offsets[i + 1]]
                if copies[i] > 1 and m >= n:
                    a, b = np.array([0]), np.array([m])
                elif at[i] < at[i + 1]:
                    a, b = covered(span["s"][at[i] : at[i + 1]], span["e"][at[i] : at[i + 1]], m)
                else:
                    a = b = np.zeros(0, np.int64)
                removed.append(int((b - a).sum()))
                spans.append(len(a))
                edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), m]
                kept.append(b"".join(part[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeated_bytes(docs: DataFrame, text: str = "text", n: int = 400, gram: int = 64, most_blocks: int = 1024) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, n_spans, kept) for each distinct text, to be joined by ``keyed``.

    A byte goes if any ``n``-byte string that covers it starts anywhere else too,
    in the same text or another; strings are judged on the input, and none
    crosses texts. Null and empty texts have no bytes; texts of fewer than ``n``
    bytes keep all; repeated rows are repeats of each other. Other columns of
    ``docs`` aren't read, whatever their names; an empty table gives none.
    """
    texts = distinct_texts(docs, text)
    occ = anchors_of(texts, "byte", n, gram)
    spans = spans_of(occ, suffix_runs(texts, occ, n, most_blocks), n)
    return texts.join(spans, KEY, "left").select(*KEY, "text_", "copies", "spans").mapInArrow(_remove(n), SCHEMA)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    done = remove_repeated_bytes(docs).select(*KEY, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return keyed(docs.select("doc_id", "text"), "text").select("doc_id", *KEY).join(done, KEY).drop(*KEY)
