"""Language-model scoring with a probabilistic suffix tree over words.

The root gives every word its smoothed share of the training tokens. Longer
contexts are added depth by depth: all that occur at least ``least`` times are
candidates, and a candidate is kept if its next words diverge from what its
suffix predicts by more than the description length of its parameters. A kept
context's distribution is discounted and smoothed with its suffix's; a token is
scored in the longest kept suffix of what precedes it.

Counts grow with the input and stay in Spark. Texts aren't shuffled: each task
turns its rows into pieces of tokens, which are written once. In each round a
piece asks buckets of hashes: how often its grams occur in the training texts,
and what its contexts leave to their suffixes. A gram is asked for only if both
of its parts occur often enough. Of a gram that several pieces hold, one tells
the context's bucket. Questions are sorted hashes as packed differences, answers
come in their order; nothing but sums of one row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, clustered, flat, materialize, pieces, read, slices, word_bounds
from .langid import held_out
from .rolling import mix, word_values

#: Stands for the end of a text, and as a context for its beginning.
END = np.uint64(0x0E0D0E0D0E0D0E0D)
PIECE_BYTES = 8 << 20
#: Tokens of pieces for which there is one bucket.
BUCKET_TOKENS = 4 << 20
COUNT, FIT = 0, 1
ASKED = "what int, level int, bucket int, pid long, keys binary, counts binary, contexts binary, c binary, total binary, p binary"
ANSWERS = "what int, level int, bucket int, pid long, data binary, n long, v long"


def token_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' tokens, each row closed by END, and where rows begin."""
    low = LOWER[buf]
    starts, ends, rows = word_bounds(low, offsets)
    at = rows + np.arange(len(rows))
    out = np.empty(len(starts) + len(rows) - 1, np.uint64)
    last = np.zeros(len(out), bool)
    last[at[1:] - 1] = True
    out[last] = END
    out[~last] = word_values(low, starts, ends)
    return out, at


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the gram whose first words are gram ``a`` and whose last words are gram ``b``."""
    return mix(mix(a) + b)


def packed(values: np.ndarray) -> bytes:
    """Numbers of eight bytes, all their lowest bytes first, compressed."""
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], 8 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def _tokenize(key: str):
    def piece(seq: int, kept: list) -> pa.RecordBatch:
        ids, held, values, lengths = zip(*kept, strict=True)
        words, places = np.unique(np.concatenate(values), return_inverse=True)
        numbers = [pa.array([(TaskContext.get().partitionId() << 32) + seq]), pa.array([len(places)])]
        data = [pa.array([x], pa.binary()) for x in (packed(np.concatenate(lengths)), packed_keys(words), packed(places.astype(np.int64)))]
        return pa.RecordBatch.from_arrays([*numbers, _listed(ids), _listed(held), *data], ["pid", "tokens", "ids", "held", "lengths", "words", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, seq = [], 0, 0
        for batch in batches:
            buf, offsets = flat(batch.column("text"))
            for lo, hi in slices(offsets + 8 * np.arange(len(offsets)), PIECE_BYTES):
                more = int(offsets[hi] - offsets[lo]) + 8 * (hi - lo)
                if kept and size + more > PIECE_BYTES:
                    yield piece(seq, kept)
                    kept, size, seq = [], 0, seq + 1
                values, rows = token_hashes(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                kept.append((*(batch.column(x).slice(lo, hi - lo) for x in (key, "held_out")), values, np.diff(rows)))
                size += more
        if kept:
            yield piece(seq, kept)

    return run


def _listed(parts: tuple) -> pa.ListArray:
    whole = pa.concat_arrays(parts)
    return pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)


def _cut(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys; a bucket is a key's highest bits."""
    which, first = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    return list(zip(which.tolist(), first.tolist(), np.append(first, len(keys))[1:].tolist(), strict=True))


class _Piece:
    """A piece followed as far as ``answers`` go: ``asked`` has what it asks next, ``p`` the tokens' probabilities."""

    def __init__(self, piece: pa.Table, answers: pa.Table, bits: int, depth: int, n: int, v: int, discount: float, least: int):
        self.pid, self.bits, self.asked = piece.column("pid")[0].as_py(), bits, []
        self.lengths, index = (unpacked(piece.column(x)[0].as_py()) for x in ("lengths", "places"))
        keys = unpacked_keys(piece.column("words")[0].as_py())
        known = self._known(answers)
        self.first = np.cumsum(self.lengths) - self.lengths
        held = np.array(piece.column("held")[0].as_py(), object)
        train = np.repeat(held == False, self.lengths)  # noqa: E712
        place = np.arange(len(index)) - np.repeat(self.first, self.lengths)
        begin = int(np.searchsorted(keys, END))
        count = None
        if (COUNT, 0) in known:
            count = known[COUNT, 0] >> 1
            self.c = count[index]
            self.base = (self.c + 0.5) / (n + 0.5 * (v + 1))
            self.p = self.base.copy()
        else:
            self._ask_counts(0, keys, index[train])
        for d in range(1, depth + 1):
            at = np.flatnonzero(place >= d - 1)
            context = np.where(place[at] == 0, begin, index[at - 1])
            if d > 1:  # a gram occurs no more often than its parts
                ok = (context >= 0) & (index[at] >= 0)
                at, context = at[ok], context[ok]
                ok = (count[context] >= least) & (count[index[at]] >= least)
                at, context = at[ok], context[ok]
            grams, inverse = np.unique(pair(keys[context], keys[index[at]]), return_inverse=True)
            if (COUNT, d) not in known:
                self._ask_counts(d, grams, inverse[train[at]])
                return
            total, own = known[COUNT, d] >> 1, (known[COUNT, d] & 1).astype(bool)
            asks = count >= least
            if (FIT, d) in known:
                back = np.full(len(keys), np.nan)
                back[asks] = known[FIT, d].view(np.float64)
                # all that follow a kept context, also those whose gram occurs once
                after = np.flatnonzero(place >= d - 1)
                before = np.where(place[after] == 0, begin, index[after - 1])
                left = np.where(before >= 0, back[before], np.nan)
                share = np.zeros(len(index))
                c = total[inverse]
                share[at] = np.where(c >= least, (c - discount) / np.maximum(count[context], 1), 0.0)
                kept = ~np.isnan(left)
                after, left = after[kept], left[kept]
                self.p[after] = share[after] + left * self.p[after]
            else:
                some = np.zeros(len(grams), np.int64)
                some[inverse] = np.arange(len(at))
                mine = np.flatnonzero(own & (total >= least))
                some = some[mine]
                self._ask_back(d, keys[asks], keys[context[some]], total[mine], count[context[some]], self.p[at[some]])
            index = np.full(len(index), -1)
            index[at], keys, count = inverse, grams, total

    def _known(self, answers: pa.Table) -> dict[tuple[int, int], np.ndarray]:
        rows = sorted(zip(*(answers.column(x).to_pylist() for x in ("what", "level", "bucket", "data")), strict=True), key=lambda r: r[:3])
        parts: dict[tuple[int, int], list] = {}
        for what, level, _, data in rows:
            parts.setdefault((what, level), []).append(unpacked(data))
        return {k: np.concatenate(x) for k, x in parts.items()}

    def _ask_counts(self, level: int, keys: np.ndarray, trained: np.ndarray) -> None:
        counts = np.bincount(trained, minlength=len(keys))
        for bucket, a, b in _cut(keys, self.bits):
            self.asked.append((COUNT, level, bucket, self.pid, packed_keys(keys[a:b]), packed(counts[a:b]), None, None, None, None))

    def _ask_back(self, level: int, keys: np.ndarray, contexts: np.ndarray, *columns: np.ndarray) -> None:
        order = np.argsort(contexts, kind="stable")
        contexts, columns = contexts[order], [x[order] for x in columns]
        cut = {bucket: (a, b) for bucket, a, b in _cut(contexts, self.bits)}
        for bucket, a, b in _cut(keys, self.bits):  # each context is asked for, so each one's bucket comes up
            lo, hi = cut.get(bucket, (0, 0))
            self.asked.append((FIT, level, bucket, self.pid, packed_keys(keys[a:b]), None, packed_keys(contexts[lo:hi]), *(packed(x[lo:hi]) for x in columns)))


def _ask(*args):
    names = [x.split()[0] for x in ASKED.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 6

    def run(piece: pa.Table, answers: pa.Table) -> pa.Table:
        asked = _Piece(piece, answers, *args).asked
        return pa.table({x: pa.array(column, kind) for x, kind, column in zip(names, kinds, zip(*asked, strict=True) if asked else [[]] * 10, strict=True)})

    return run


def _begins(keys: np.ndarray) -> np.ndarray:
    """Which of sorted keys differ from the one before."""
    return np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))


def _sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys (of equal ones the earlier first) and where each one begins in it."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.flatnonzero(_begins(keys))


def _count(asked: pa.Table) -> tuple[list[np.ndarray], list[int], list[int]]:
    """For each question the training counts of its keys, doubled, and 1 for those keys that it is to tell of."""
    keys, counts = [unpacked_keys(x.as_py()) for x in asked.column("keys")], [unpacked(x.as_py()) for x in asked.column("counts")]
    ends = np.cumsum([len(x) for x in keys])[:-1]
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order, first = _sums(keys)
    totals = np.add.reduceat(counts[order], first)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(totals * 2, np.diff(np.append(first, len(keys))))
    trained = order[counts[order] > 0]
    own = trained[_begins(keys[trained])]
    told = np.zeros(len(keys), bool)
    told[own] = True
    parts = np.split(out + told, ends)
    return parts, [int((x[x & 1 == 1] >> 1).sum()) for x in parts], [int((x & 1).sum()) for x in parts]


def _fit(asked: pa.Table, discount: float) -> list[np.ndarray]:
    """For each question what its contexts leave to their suffixes; NaN for those that aren't kept."""
    keys = np.concatenate([unpacked_keys(x.as_py()) for x in asked.column("contexts")])
    c, total, p = (np.concatenate([unpacked(x.as_py(), kind) for x in asked.column(name)]) for name, kind in (("c", np.int64), ("total", np.int64), ("p", np.float64)))
    order, first = _sums(keys)
    wanted = [unpacked_keys(x.as_py()) for x in asked.column("keys")]
    if not len(keys):
        return [np.full(len(w), np.nan) for w in wanted]
    keys, c, total, p = keys[order][first], c[order], total[order], p[order]
    kinds = np.diff(np.append(first, len(c)))
    gain = (c - discount) / total
    back = np.maximum(1 - np.add.reduceat(gain, first), 1e-12)
    # log-likelihood gained on the training tokens, the rest falling back by back
    gained = np.add.reduceat(c * np.log((gain + np.repeat(back, kinds) * p) / p), first) + np.maximum(total[first] - np.add.reduceat(c, first), 0) * np.log(back)
    back[~(gained > 0.5 * (kinds + 1) * np.log(np.maximum(total[first], 2)))] = np.nan
    out = []
    for w in wanted:
        at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
        out.append(np.where(keys[at] == w, back[at], np.nan))
    return out


def _answer(discount: float):
    def run(asked: pa.Table) -> pa.Table:
        what = asked.column("what")[0].as_py()
        asked = asked.sort_by("pid")
        parts, n, v = _count(asked) if what == COUNT else (_fit(asked, discount), [0] * len(asked), [0] * len(asked))
        return pa.table({**{x: asked.column(x) for x in ("what", "level", "bucket", "pid")}, "data": pa.array([packed(x) for x in parts], pa.binary()), "n": pa.array(n, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _score(key: str, *args):
    def run(piece: pa.Table, answers: pa.Table) -> pa.Table:
        done = _Piece(piece, answers, *args)
        known, base, score = (np.add.reduceat(x, done.first) for x in ((done.c > 0).astype(np.int64), np.log10(done.base), np.log10(done.p)))
        ids, held = (piece.column(x).combine_chunks().flatten() for x in ("ids", "held"))
        return pa.table({key: ids, "held_out": held, "n_tokens": pa.array(done.lengths), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", held: str = "held_out", depth: int = 2, discount: float = 0.75, least: int = 2) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows not ``held``.

    A null or empty text is its end alone. Contexts and events that occur fewer
    than ``least`` times are left to their suffixes. Without training rows every
    token has probability 1 under the root of an empty vocabulary.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(held).alias("held_out"))
    dealt = rows.mapInArrow(_tokenize(key), f"pid long, tokens long, ids array<{kind}>, held array<boolean>, lengths binary, words binary, places binary")
    dealt = clustered(dealt, ["pid"], "pieces")
    bits = max(1, (pieces(dealt.agg(F.sum("tokens")).first()[0], BUCKET_TOKENS) - 1).bit_length())
    answers, n, v = spark.createDataFrame([], ANSWERS), 0, 0
    for d in range(depth + 1):
        asked = dealt.drop("ids").groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(_ask(bits, depth, n, v, discount, least), ASKED)
        told = materialize(asked.groupBy("what", "level", "bucket").applyInArrow(_answer(discount), ANSWERS), "answers")
        if d == 0:
            n, v = (int(x or 0) for x in told.filter("level = 0").agg(F.sum("n"), F.sum("v")).first())
        answers = answers.unionByName(told) if d else told
    done = dealt.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(_score(key, bits, depth, n, v, discount, least), f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(n).cast("long"))


def op7_language_model(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held_out(parts=5).alias("held_out"))
    return score_texts(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
