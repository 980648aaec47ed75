"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into segments of two bits and mapped to the vector of their
bit counts. Flipping one bit moves the vector by one, so the Manhattan distance
of two vectors is never above the Hamming distance of their fingerprints. For
pairs within ``radius`` r, the segments are dealt into 2r groups: at most r
groups can differ, so r of them are equal. The grid has one cell for each choice
of r groups and their bit counts, and pairs within the radius share a cell.
Members of a cell are filtered by Manhattan distance, then verified exactly.

In a cell, members aren't paired with each other: a search from one member
finds those within the radius, continues from them over the members not yet
reached, and returns one link for each member reached. A component of a cell's
members so costs as many links as it has members, however dense it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, flat, materialize, read, slices, word_bounds
from .components import components
from .rolling import mix, prefix, stretch, word_values

EVEN = np.uint64(0x5555555555555555)
PAIRS = np.uint64(0x3333333333333333)
#: Sets of fewer shingles are compared without a look at their signatures, which say little of them.
FEW = 64


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included; of all words if they are fewer."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends[: len(words) - size + 1] - [len(w) + 1 for w in words[: len(words) - size + 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the highest bit first."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        out += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes."""
    return int.from_bytes(np.packbits(ones(hashes) * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprints(rows: DataFrame, text: str, shingle: int) -> DataFrame:
    """``rows`` without ``text``, and with ``fp`` (64 bits as a signed long)."""
    keep = [c for c in rows.columns if c != text]
    schema = rows.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column(batch.schema.names.index(text)))
            raw = LOWER[buf].tobytes()
            fp = np.array([fingerprint(shingle_hashes(raw[a:b], shingle)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    return rows.select(*keep, text).mapInArrow(run, schema)


def counts_of(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in its own two bits."""
    return fp - ((fp >> np.uint64(1)) & EVEN)


def groups_of(radius: int) -> list[np.ndarray]:
    """Masks of the 2r groups of segments; neighbouring segments go to different groups."""
    n = 2 * radius
    masks = [0] * n
    for segment in range(32):
        masks[segment % n] |= 3 << (2 * segment)
    return [np.uint64(m) for m in masks]


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of bit-count vectors."""
    total = np.zeros(np.broadcast(a, b).shape, np.int64)
    for shift in range(0, 64, 2):
        s = np.uint64(shift)
        total += np.abs(((a >> s) & np.uint64(3)).astype(np.int8) - ((b >> s) & np.uint64(3)).astype(np.int8))
    return total


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def _cells(radius: int):
    masks = groups_of(radius)
    faces = [(i, np.bitwise_or.reduce(c)) for i, c in enumerate(combinations(masks, radius))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            counts = counts_of(fp.view(np.uint64))
            for i, mask in faces:
                cell = mix((counts & mask) ^ mix(np.full(len(fp), i + 1, np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp)], ["cell", "node"])

    return run


def search(n: int, near) -> list[tuple[int, int]]:
    """One link (member, root) for each member reached; ``near(i, rest)`` says which of ``rest`` are within the radius of i."""
    rest, out = np.arange(n), []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            hit = near(front.pop(), rest)
            reached, rest = rest[hit], rest[~hit]
            front.extend(reached.tolist())
            out.extend((m, int(root)) for m in reached.tolist())
    return out


def _whole_cells(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work`` on tables that end with a cell, of rows that come sorted by cell."""
    held = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, more]) if held is not None else more
        cell = held.column("cell")
        last = cell[-1].as_py()
        if cell[0].as_py() != last:
            keys = cell.to_numpy()
            cut = int(np.flatnonzero(keys != last)[-1]) + 1
            yield work(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield work(held)


def _in_cells(radius: int, width: int):
    """Links within cells. Rows come sorted by cell; ``width`` 8-byte words of ``sig`` are compared, or the node itself."""

    def link(node: np.ndarray, sig: np.ndarray) -> list[tuple[int, int]]:
        if width:
            return search(len(node), lambda i, rest: np.bitwise_count(sig[rest] ^ sig[i]).sum(axis=1, dtype=np.int64) <= radius)
        counts = counts_of(node.view(np.uint64))

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            bits = node.view(np.uint64)
            hit = manhattan(counts[rest], counts[i]) <= radius
            hit[hit] = hamming(bits[rest[hit]], bits[i]) <= radius
            return hit

        return search(len(node), near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> pa.RecordBatch:
            cell, node = (table.column(c).to_numpy() for c in ("cell", "node"))
            sig = flat(table.column("sig"))[0].view(np.uint64).reshape(-1, width) if width else node
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            size = np.diff(np.append(first, len(cell)))
            a, b = [], []
            two = first[size == 2]
            if len(two):
                if width:
                    ok = np.bitwise_count(sig[two] ^ sig[two + 1]).sum(axis=1, dtype=np.int64) <= radius
                else:
                    x, y = node[two].view(np.uint64), node[two + 1].view(np.uint64)
                    ok = manhattan(counts_of(x), counts_of(y)) <= radius
                    ok[ok] = hamming(x[ok], y[ok]) <= radius
                a.append(node[two[ok]])
                b.append(node[two[ok] + 1])
            for f, s in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                found = link(node[f : f + s], sig[f : f + s])
                if found:
                    pair = np.array(found) + f
                    a.append(node[pair[:, 0]])
                    b.append(node[pair[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], ["a", "b"])

        yield from _whole_cells(batches, work)

    return run


def links_in_cells(cells: DataFrame, radius: int, width: int = 0) -> DataFrame:
    """Links (a, b) of rows (cell, node[, sig]); cells are sorted and streamed, many to a task."""
    return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_in_cells(radius, width), "a long, b long").distinct()


def near_fingerprints(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links that join distinct fingerprints ``fp`` as chains of at most ``radius`` differing bits do: each to the first of its chain in a cell."""
    return links_in_cells(distinct.select("fp").mapInArrow(_cells(radius), "cell long, node long"), radius)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fp, component_id): fingerprints and the least key reachable over links of at most ``radius`` bits.

    A null or empty text has fingerprint zero and is linked like any other;
    equal texts have equal fingerprints; a component whose keys are all null has
    a null component_id.
    """
    fps = materialize(fingerprints(docs.select(key, text), text, shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(near_fingerprints(distinct, radius)).withColumnRenamed("node", "fp")
    group = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = group.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(group.join(best, "root").select("fp", "component_id"), "fp")


# --- similarity of shingle sets, for stages that ask for one -----------------------------------


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row, its set of 64-bit shingle hashes, ascending; A-Z lower-cased. The one shingle of a shorter text is all of it."""
    low = LOWER[buf]
    starts, ends, rows = word_bounds(low, offsets)
    h = prefix(word_values(low, starts, ends))
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        first = np.arange(a, max(b - size, a) + 1) if b > a else np.zeros(0, np.int64)
        yield np.unique(mix(stretch(h, first, np.minimum(first + size, b)) + np.uint64(min(size, b - a))))


def _sample(h: np.ndarray, order: int, size: int) -> int:
    """The SimHash fingerprint of the ``size`` least of some hashes under one order."""
    least = mix(h ^ mix(np.array([order + 1], np.uint64)))
    return fingerprint(mix((np.partition(least, size - 1)[:size] if len(least) > size else least) ^ np.uint64(order)))


def _samples(h: np.ndarray, samples: int, size: int) -> np.ndarray:
    """Cells of one set: the fingerprints of its samples, each with its order's number mixed in."""
    if len(h) <= size or len(h) > 1 << 15 or size != 3:
        found = np.array([_sample(h, i, size) for i in range(samples)], np.uint64)
    else:  # all orders at once; of three hashes, a bit is set in over half if in two
        order = np.arange(samples, dtype=np.uint64)
        least = np.partition(mix(h[None, :] ^ mix(order + np.uint64(1))[:, None]), 2, axis=1)[:, :3]
        x, y, z = mix(least ^ order[:, None]).T
        found = x & y | x & z | y & z
    return mix(found ^ mix(np.arange(samples, dtype=np.uint64) + np.uint64(7)))


def _sketches(shingle: int, samples: int, size: int, words: int, whole: int):
    """Per text: its cells, a fingerprint of ``words`` x 64 bits over all shingles, their number, and op5's fingerprint over shingles of ``whole`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column("text_"))
            node = batch.column("node").to_numpy()
            for lo, hi in slices(offsets, 4 << 20):
                cells, sig, count = [], [], []
                raw, ends = LOWER[buf[offsets[lo] : offsets[hi]]].tobytes(), (offsets[lo : hi + 1] - offsets[lo]).tolist()
                fp = np.array([fingerprint(shingle_hashes(raw[a:b], whole)) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.uint64).view(np.int64)
                for h in shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle):
                    cells.append(_samples(h, samples, size).view(np.int64))
                    sig.append(np.array([fingerprint(mix(h + np.uint64(i * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))) for i in range(words)], np.uint64).tobytes())
                    count.append(len(h))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.list_(pa.int64())), pa.array(node[lo:hi]), pa.array(sig, pa.binary()), pa.array(count, pa.int64()), pa.array(fp)], ["cells", "node", "sig", "size", "fp"])

    return run


def _sets(shingle: int):
    """Per text: its shingles' hashes, ascending, as packed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column("text_"))
            for lo, hi in slices(offsets, 4 << 20):
                got = [h.tobytes() for h in shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)]
                yield pa.RecordBatch.from_arrays([batch.column("node")[lo:hi], pa.array(got, pa.binary())], ["node", "set"])

    return run


def _candidates(similarity: float, limit: int, width: int, labelled: bool):
    """Pairs within cells that may be similar: those by which a search reaches each member; if ``labelled``, all whose labels differ."""

    def work(table: pa.Table) -> pa.RecordBatch:
        cell, node, size = (table.column(c).to_numpy() for c in ("cell", "node", "size"))
        label = table.column("label").to_numpy() if labelled else node
        sig = flat(table.column("sig"))[0].view(np.uint64).reshape(-1, width)

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            few, many = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
            bits = np.bitwise_count(sig[rest] ^ sig[i]).sum(axis=1, dtype=np.int64)
            return (few + 1e-9 >= similarity * many) & ((bits <= limit) | (few < FEW))

        a, b = [], []
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        for f, n in zip(first.tolist(), np.diff(np.append(first, len(cell))).tolist(), strict=True):
            if n == 1:
                continue
            rest = np.arange(f, f + n)
            if labelled:  # every pair of two labels has a member outside the most common one
                names, which = np.unique(label[rest], return_inverse=True)
                for i in rest[which != np.argmax(np.bincount(which))].tolist() if len(names) > 1 else []:
                    hit = rest[label[rest] != label[i]]
                    hit = hit[near(i, hit)]
                    a.append(np.full(len(hit), node[i]))
                    b.append(node[hit])
                continue
            while len(rest) > 1:
                front, rest = [int(rest[0])], rest[1:]
                while front and len(rest):
                    i = front.pop()
                    hit = near(i, rest)
                    a.append(np.full(int(hit.sum()), node[i]))
                    b.append(node[rest[hit]])
                    front.extend(rest[hit].tolist())
                    rest = rest[~hit]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], ["a", "b"])

    return lambda batches: _whole_cells(batches, work)


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both + 1e-9 >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, the number of the first set that it is linked to by a chain of similar sets.

    Intersections with all other sets come from the sets that each element is in;
    a search goes on from those reached, over those not yet reached.
    """
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    names, element = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(element, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[order]
    first = np.searchsorted(element[order], np.arange(len(names) + 1))
    label = np.full(len(sets), -1)
    for start in range(len(sets)):
        if label[start] >= 0:
            continue
        label[start], front = start, [start]
        while front and (label < 0).any():
            i = front.pop()
            both = np.zeros(len(sets), np.int64)
            own = element[ends[i] - sizes[i] : ends[i]]
            for j in range(0, len(own), 4096):
                n = first[own[j : j + 4096] + 1] - first[own[j : j + 4096]]
                at = np.repeat(first[own[j : j + 4096]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                both += np.bincount(holder[at], minlength=len(sets))
            hit = (label < 0) & (both + 1e-9 >= similarity * (sizes[i] + sizes - both))
            label[hit] = start
            front.extend(np.flatnonzero(hit).tolist())
    return label


def _in_groups(similarity: float):
    """(node, root) of the members of whole groups, which come sorted by group, that are linked to another member."""

    def work(table: pa.Table) -> pa.RecordBatch:
        group, node = (table.column(c).to_numpy() for c in ("cell", "node"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        out: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        for f, n in zip(first.tolist(), np.diff(np.append(first, len(group))).tolist(), strict=True):
            label, own = linked(sets[f : f + n], similarity), node[f : f + n]
            root = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(root, label, own)
            many = np.bincount(label, minlength=n)[label] > 1
            out.append(np.stack([own[many], root[label[many]]]))
        a, b = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["node", "root"])

    return lambda batches: _whole_cells(batches, work)


def similar_texts(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8, samples: int = 12, size: int = 3, words: int = 8, group_shingles: int = 1 << 25, whole: int = 3, radius: int = 3) -> DataFrame:
    """(node, root): texts (by 64-bit hash) whose shingle sets have a Jaccard similarity of ``similarity`` or more, as components.

    Candidates are the links of op5's method: fingerprints of whole texts over
    shingles of ``whole`` words, segment bit counts, the grid, the Manhattan bound
    and ``radius`` differing bits. These find near copies. At similarity 0.8,
    however, two texts differ in about 10 of 64 bits, so candidates also meet by
    SimHash fingerprints of small samples (the ``size`` least shingles under each
    of ``samples`` orders). Of these, a fingerprint of ``words`` x 64 bits leaves out those far
    below: at similarity s, shingle vectors have cosine 2s / (1 + s), the share of
    differing bits is the angle over pi, and five deviations more are let pass, as
    are sets of fewer than ``FEW`` shingles.

    A search in each cell gives one candidate link for each member that it reaches,
    so links grow with the texts and not with their pairs. Texts that these links
    join are a group; similar texts are in one group, and a task searches a whole
    group by the exact similarity of its sets. Groups of more than
    ``group_shingles`` shingles (eight bytes each) don't fit a task; there, the
    pairs by which a search reaches a cell's members are compared first, and then
    all pairs of a cell that these comparisons left in different components.

    A null text is empty; texts without words have empty sets and are similar to
    each other. Other columns of ``docs`` aren't read; an empty table gives none.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = words * 64
    limit = int(bits * share + 5 * np.sqrt(bits * share * (1 - share)))
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.xxhash64(t).alias("node"), t.alias("text_"))
    sketches = materialize(keyed.dropDuplicates(["node"]).mapInArrow(_sketches(shingle, samples, size, words, whole), "cells array<long>, node long, sig binary, size long, fp long"), "sketches")

    def sets_of(nodes: DataFrame) -> DataFrame:
        # the nodes grow with the documents, so they are never broadcast
        return keyed.join(nodes.hint("merge"), "node").dropDuplicates(["node"]).select("text_", "node").mapInArrow(_sets(shingle), "node long, set binary")

    def candidates(rows: DataFrame, labelled: bool) -> DataFrame:
        cells = rows.withColumn("cell", F.explode("cells")).drop("cells", "fp")
        return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_candidates(similarity, limit, words, labelled), "a long, b long")

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
        sets = materialize(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
        met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        return materialize(met.mapInArrow(_similar(similarity), "a long, b long"), "similar")

    def in_grid(rows: DataFrame) -> DataFrame:
        # texts of one fingerprint are linked to the first of them, which stands for them in the grid
        prints = materialize(rows.groupBy("fp").agg(F.min("node").alias("first")), "prints")
        same = rows.select("node", "fp").join(prints, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
        ends = [prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_")) for c in ("a", "b")]
        near = near_fingerprints(prints, radius).join(ends[0], "a").join(ends[1], "b")
        return same.unionByName(near.select(F.col("a_").alias("a"), F.col("b_").alias("b")))

    def by_pairs(rows: DataFrame) -> DataFrame:
        links = similar(candidates(rows, False).unionByName(in_grid(rows)))
        labels = components(links).withColumnRenamed("root", "label")
        more = similar(candidates(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), True))
        return components(links.unionByName(more))

    groups = components(candidates(sketches, False).unionByName(in_grid(sketches))).withColumnRenamed("root", "cell")
    large = materialize(groups.join(sketches.select("node", "size"), "node").groupBy("cell").agg(F.sum("size").alias("n")).filter(F.col("n") > group_shingles).select("cell"), "large")
    some = not large.isEmpty()
    members = groups.join(large, "cell", "left_anti") if some else groups
    sets = sets_of(members.select("node")).join(members, "node")
    done = sets.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_in_groups(similarity), "node long, root long")
    return done.unionByName(by_pairs(sketches.join(groups.join(large, "cell").select("node"), "node"))) if some else done


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    done = near_duplicates(read(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
