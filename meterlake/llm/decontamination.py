"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a few consecutive tokens; positions where the mask is 0
are ignored, so two passages that differ there still have equal seed hashes.
Seeds of the benchmark's items are looked up at every token of every document.
A hit lines an item up with a document; the longest stretch so lined up of which
enough tokens match is the overlap, and counts if it is long enough. The masks
hit every such stretch: with at most one token in five substituted, there are
four equal tokens in a row, or else three on either side of a substitution, or
3 + 2 + 3 around two in a stretch of ten.

Items of fewer tokens than ``SHORTEST`` would match by chance inside any text.
They are found where they are the whole of a line: lines that short are hashed
under a mask of all ones of their own length and looked up among the items.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. The
benchmark is counted first and cut into blocks of bounded size; each block's
index is broadcast and all documents pass it, so documents are never shuffled
and a benchmark of any size can be searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, aside, flat, materialize, read, slices, word_bounds
from .rolling import mix, word_values

MASKS = ("1111", "1110111", "1110110111")
#: Items of fewer tokens can't be told from chance within a line; they are found as whole lines.
SHORTEST = 8
LEAK = "array<struct<item_id:bigint,overlap:int,matched:int,item_tokens:int,start:int>>"

_letters = np.frombuffer(bytes(range(256)), np.uint8)
TOKEN = np.where((_letters >= 128) | ((_letters >= 48) & (_letters <= 57)) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 32).astype(np.uint8)
_factor = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, where each row's begin, and where each token starts."""
    plain = TOKEN[buf]
    starts, ends, rows = word_bounds(plain, offsets)
    return word_values(plain, starts, ends), rows, starts


def lines(buf: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where each line's tokens begin, and their number last; lines end at newlines, returns and the ends of rows. Lines without tokens are left out."""
    if not len(starts):
        return np.zeros(1, np.int64)
    line = np.searchsorted(np.flatnonzero((buf == 10) | (buf == 13)), starts)
    new = np.concatenate(([True], line[1:] != line[:-1]))
    new[rows[:-1][rows[:-1] < len(starts)]] = True
    return np.append(np.flatnonzero(new), len(starts))


def seeds(values: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash under a mask at every token that has enough tokens from it on (rows are not minded)."""
    n = len(values) - len(mask) + 1
    total = np.full(max(n, 0), number, np.uint64)
    if n > 0:
        for j, bit in enumerate(mask):
            if bit == "1":
                total += values[j : j + n] * _factor[j]
    return mix(total)


class Index:
    """Seeds of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS, identity: float = 0.8, least: int = 13) -> None:
        self.masks, self.identity, self.least = masks, identity, least
        self.ids = [i for i, _ in items]
        buf, offsets = flat(pa.array([t or "" for _, t in items], pa.string()))
        self.values, self.offsets, _ = tokens(buf, offsets)
        hashes, places = [], []
        for k, mask in enumerate(masks):
            h = seeds(self.values, mask, k)
            at = np.arange(len(h))
            row = np.searchsorted(self.offsets, at, side="right") - 1
            inside = (at + len(mask) <= self.offsets[row + 1]) & (np.diff(self.offsets)[row] >= SHORTEST)
            hashes.append(h[inside])
            places.append(at[inside])
        h, p = np.concatenate(hashes), np.concatenate(places)
        by = np.argsort(h, kind="stable")
        self.hashes, self.places = h[by], p[by]
        self.bits = np.uint64((1 << max(16, int(max(1, len(h))).bit_length() + 5)) - 1)
        seen = np.zeros(int(self.bits) + 1, bool)
        seen[h & self.bits] = True
        self.maybe = np.packbits(seen, bitorder="little")
        self.short: dict[int, list[int]] = {}
        for i in np.flatnonzero((np.diff(self.offsets) > 0) & (np.diff(self.offsets) < SHORTEST)).tolist():
            n = int(self.offsets[i + 1] - self.offsets[i])
            self.short.setdefault(int(self._whole(self.values[self.offsets[i] :], n)[0]), []).append(i)
        self.lengths = sorted({int(self.offsets[i + 1] - self.offsets[i]) for items in self.short.values() for i in items})

    def _whole(self, values: np.ndarray, n: int) -> np.ndarray:
        """Hash of the ``n`` tokens from each token on, none ignored."""
        return seeds(values, "1" * n, len(self.masks) + n)

    def _short_lines(self, buf: np.ndarray, values: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, tokens, token) of each line that is an item of few tokens, in the order of lines for each length."""
        cut = lines(buf, starts, rows)
        size, known = np.diff(cut), np.array(sorted(self.short), np.uint64)
        for n in self.lengths:
            at = cut[:-1][size == n]
            h = self._whole(values, n)[at]
            hit = np.isin(h, known)
            for a, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
                for i in self.short[x]:
                    if np.array_equal(self.values[self.offsets[i] : self.offsets[i + 1]], values[a : a + n]):
                        yield int(np.searchsorted(rows, a, side="right")) - 1, i, n, a

    def search(self, buf: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, int, int]]]:
        """For each row, one (item, overlap, matched, item tokens, start) for each item found: its longest overlap."""
        values, rows, starts = tokens(buf, offsets)
        lined_up = []
        for k, mask in enumerate(self.masks):
            h = seeds(values, mask, k)
            slot = h & self.bits
            at = np.flatnonzero((self.maybe[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            row = np.searchsorted(rows, at, side="right") - 1
            at = at[at + len(mask) <= rows[row + 1]]
            low = np.searchsorted(self.hashes, h[at], side="left")
            n = np.searchsorted(self.hashes, h[at], side="right") - low
            hit = np.repeat(np.arange(len(at)), n)
            place = self.places[np.repeat(low, n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)]
            lined_up.append(np.stack([at[hit], place], axis=1))
        pairs = np.concatenate(lined_up)
        row = np.searchsorted(rows, pairs[:, 0], side="right") - 1
        item = np.searchsorted(self.offsets, pairs[:, 1], side="right") - 1
        lined = np.unique(np.stack([row, item, pairs[:, 0] - pairs[:, 1]], axis=1), axis=0)
        found: list[dict[int, tuple[int, int, int, int, int]]] = [{} for _ in range(len(offsets) - 1)]
        for r, i, s in lined[self._enough(lined, values, rows)].tolist():
            a, b = int(self.offsets[i]), int(self.offsets[i + 1])
            lo, hi = max(a, int(rows[r]) - s), min(b, int(rows[r + 1]) - s)
            x, y, m = longest(self.values[lo:hi] == values[lo + s : hi + s], self.identity)
            if y - x >= self._need(b - a) and (i not in found[r] or y - x > found[r][i][1]):
                found[r][i] = (self.ids[i], y - x, m, b - a, lo + s + x - int(rows[r]))
        for r, i, n, a in self._short_lines(buf, values, rows, starts):
            found[r].setdefault(i, (self.ids[i], n, n, n, a - int(rows[r])))
        return [list(f.values()) for f in found]

    def _need(self, size):
        """Tokens that an overlap with an item of ``size`` tokens must have."""
        return np.minimum(self.least, -(-4 * size // 5))

    def _enough(self, lined: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which (row, item, shift) have as many matches in all as an overlap must have; most chance hits end here."""
        row, item, shift = lined.T
        need = self._need(np.diff(self.offsets)[item])
        lo = np.maximum(self.offsets[item], rows[row] - shift)
        size = np.minimum(self.offsets[item + 1], rows[row + 1] - shift) - lo
        out = np.zeros(len(lined), bool)
        for p, q in slices(np.concatenate(([0], np.cumsum(size)))):
            n, first = size[p:q], np.cumsum(size[p:q]) - size[p:q]
            at = np.repeat(lo[p:q] - first, n) + np.arange(int(n.sum()))
            same = self.values[at] == values[at + np.repeat(shift[p:q], n)]
            out[p:q] = np.add.reduceat(same.astype(np.int64), first) + 1e-9 >= self.identity * need[p:q]
        return out


def longest(same: np.ndarray, identity: float) -> tuple[int, int, int]:
    """(start, end, matches) of the longest stretch of which at least ``identity`` match, the first of those with most matches."""
    part = Fraction(identity).limit_denominator(1_000_000)
    matches = np.concatenate(([0], np.cumsum(same)))
    total = part.denominator * matches - part.numerator * np.arange(len(matches))
    later = np.maximum.accumulate(total[::-1])[::-1]  # the most from here on, which never rises
    end = np.searchsorted(-later, -total, side="right") - 1
    size = end - np.arange(len(end))
    start = int(np.lexsort((np.arange(len(end)), matches[np.arange(len(end))] - matches[end], -size))[0])
    return start, int(end[start]), int(matches[end[start]] - matches[start])


def flag_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", identity: float = 0.8, least: int = 13, block_chars: int = 16_000_000) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items found in each text.

    An item is found if a stretch lined up with it has at least ``least`` tokens
    (or four fifths of a shorter item) of which ``identity`` match; the masks hit
    all of these for the given ``least`` and an ``identity`` of 0.8 or more.
    Items of fewer than ``SHORTEST`` tokens, which any text may hold by chance, are
    found where they are all tokens of a line, the first such line. Null items and
    items without tokens are never found; null and empty texts hold none; an empty benchmark
    leaves all lists empty; of items with one id, each is found by itself. A column
    of ``docs`` named ``leaks`` is returned with ``_in`` after its name.
    ``block_chars`` bounds the characters of the benchmark in one index: where
    there are more, the documents found so far are written after each block, and
    its index is freed before the next one is built.
    """
    was = docs.columns.index(text)
    docs = aside(docs, "leaks")
    text = docs.columns[was]
    asked = benchmark.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    chars = asked.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    out = docs.withColumn("leaks", F.array().cast(LEAK))
    names = out.columns
    for block in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        index = Index([(r.i, r.t) for r in part.toLocalIterator()], identity=identity, least=least)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buf, offsets = flat(batch.column(names.index(text)))
                got = [x for lo, hi in slices(offsets, 4 << 20) for x in shared.value.search(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
                before = batch.column(names.index("leaks"))
                fields = [f.name for f in before.type.value_type]
                found = pa.array([[dict(zip(fields, x, strict=True)) for x in g] + (b.as_py() or []) for g, b in zip(got, before, strict=True)], before.type)
                yield pa.RecordBatch.from_arrays([found if n == "leaks" else batch.column(i) for i, n in enumerate(names)], names)

        out = out.mapInArrow(run, out.schema)
        if blocks > 1:
            out = materialize(out, "leaks")
            shared.unpersist()
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each benchmark item that a document holds; clean documents have none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = flag_leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("x"))
    return done.select("doc_id", "x.*")
