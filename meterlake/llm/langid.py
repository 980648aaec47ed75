"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text recognises exactly the
substrings of that text. A document is parsed greedily from left to right into
phrases, each the longest match at its place. A text parses into few, long
phrases under the automaton of its own language; phrases are normalised by the
length of the document and of the training text into bits a byte, and the
language that needs the fewest wins.

Case is folded and runs of anything but letters become one space, so digits and
marks play no part. The blocks of ``BLOCK`` bytes of a batch are parsed side by
side, each as if a phrase began there; then each is parsed again from the state in
which the block before it ended, until both parses are in the same state, and the
phrases counted so far are exchanged. So a text's phrases are those of one parse
from its beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import aside, flat, fresh, materialize, read, slices, small_join

BLOCK = 1024
#: One phrase, in the high bits of a table entry.
STEP_BIT = 28
STEP = np.int32(1 << STEP_BIT)


def fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


class SuffixAutomaton:
    """Forward links of the least automaton that recognises the substrings of some byte strings."""

    def __init__(self, texts: list[bytes]) -> None:
        link, length, move = [-1], [0], [{}]
        for text in texts:
            last = 0
            for byte in text:
                if byte in move[last] and length[move[last][byte]] == length[last] + 1:
                    last = move[last][byte]  # a string seen before
                    continue
                now = len(link)
                link.append(0)
                length.append(length[last] + 1)
                move.append({})
                at = last
                while at >= 0 and byte not in move[at]:
                    move[at][byte] = now
                    at = link[at]
                if at >= 0:
                    to = move[at][byte]
                    if length[at] + 1 == length[to]:
                        link[now] = to
                    else:
                        copy = len(link)
                        link.append(link[to])
                        length.append(length[at] + 1)
                        move.append(dict(move[to]))
                        while at >= 0 and move[at].get(byte) == to:
                            move[at][byte] = copy
                            at = link[at]
                        link[to] = link[now] = copy
                last = now
        self.move = move
        self.size = sum(map(len, texts))

    def table(self, symbols: np.ndarray) -> np.ndarray:
        """Parsing table for symbol numbers ``symbols[byte]`` (0: in no training text).

        An entry holds the next state times the number of symbols, plus STEP if a
        phrase begins with this byte. In state 0 no phrase is open; a byte that
        never occurred is a phrase of its own.
        """
        k = int(symbols.max()) + 1
        out = np.empty((len(self.move), k), np.int32)
        root = np.zeros(k, np.int32)
        for byte, to in self.move[0].items():
            root[symbols[byte]] = to * k
        out[:] = root | STEP
        for state, links in enumerate(self.move[1:], 1):
            for byte, to in links.items():
                out[state, symbols[byte]] = to * k
        return out.ravel()


def _join(table: np.ndarray, coded: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray, end: np.ndarray, count: np.ndarray) -> None:
    """Correct ``count`` and ``end`` of blocks that were parsed from state 0 for the states in which the blocks before them ended."""
    begin = np.zeros_like(end)
    todo = np.flatnonzero(number > 0)
    while True:
        todo = todo[begin[todo] != end[todo - 1]]
        if not len(todo):
            return
        old, new, which, i = begin[todo], end[todo - 1], todo, 0
        begin[todo] = new
        while True:
            stay = (old != new) & (length[which] > i)
            stopped = ~stay & (old != new)
            end[which[stopped]] = new[stopped]
            old, new, which = old[stay], new[stay], which[stay]
            if not len(which):
                break
            symbol = coded[start[which] + i]
            x, y = table[old + symbol], table[new + symbol]
            count[which] += (y >> STEP_BIT) - (x >> STEP_BIT)
            old, new, i = x & (STEP - 1), y & (STEP - 1), i + 1
        todo = todo + 1  # their blocks may have ended in another state
        todo = todo[todo < len(number)]
        todo = todo[number[todo] > 0]


class Model:
    """Parsing tables of all languages."""

    def __init__(self, samples: dict[str, list[bytes]]) -> None:
        self.languages = sorted(samples)
        used = sorted({b for texts in samples.values() for t in texts for b in t})
        self.symbols = np.zeros(256, np.int32)
        self.symbols[used] = np.arange(1, len(used) + 1)
        automata = [SuffixAutomaton(samples[x]) for x in self.languages]
        self.tables = [a.table(self.symbols) for a in automata]
        self.bits = np.array([np.log2(max(a.size, 2)) for a in automata])

    def phrases(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of phrases of each row under each language. A byte outside the training text is a phrase."""
        rows = len(offsets) - 1
        size = np.diff(offsets)
        out = np.zeros((rows, len(self.languages)), np.int64)
        blocks = -(-size // BLOCK)
        row = np.repeat(np.arange(rows), blocks)
        if not len(row):
            return out
        number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[row] + number * BLOCK
        length = np.minimum(offsets[row + 1] - start, BLOCK)
        by = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[by], -np.arange(1, length[by[0]] + 1), side="right")
        coded = self.symbols[buf]
        steps = [coded[start[by[:n]] + i] for i, n in enumerate(live.tolist())]
        for j, table in enumerate(self.tables):
            state, count = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
            for n, symbol in zip(live.tolist(), steps, strict=True):
                got = table[state[:n] + symbol]
                count[:n] += got >> STEP_BIT
                state[:n] = got & (STEP - 1)
            end, found = np.empty_like(state), np.empty_like(count)
            end[by], found[by] = state, count
            _join(table, coded, start, length, number, end, found)
            np.add.at(out[:, j], row, found)
        return out

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, least bits a byte) of each row; the score is the relative lead over the next language."""
        size = np.maximum(np.diff(offsets), 1)
        cost = self.phrases(buf, offsets) * self.bits / size[:, None]
        best = np.argmin(cost, axis=1)
        least = cost[np.arange(len(best)), best]
        rest = cost.copy()
        rest[np.arange(len(best)), best] = np.inf
        second = rest.min(axis=1) if len(self.languages) > 1 else np.full(len(best), np.inf)
        score = np.where(np.isfinite(second) & (second > 0), 1 - least / np.where(second > 0, second, 1), 1.0)
        return [self.languages[i] for i in best], score, least


def learn(labelled: DataFrame, text: str, lang: str, texts: int = 100, pieces: int = 100, chars: int = 300) -> Model:
    """Fit on a bounded sample: up to ``texts`` labelled rows a language, and of these up to ``pieces`` pieces of about ``chars`` characters.

    Rows are chosen by a hash of their text: copies are merged first, then the
    ``texts`` least hashes of each language are kept, partially in each task, so
    that copies don't crowd out other texts and no language is left out. The
    whole chosen texts are folded and cut into pieces at spaces; the pieces are
    chosen by hash too, so that each part of a text is as likely as another. Rows
    whose text or label is null, or whose text has no letter, are no examples.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    least = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= texts)
    some = small_join(rows, materialize(least.drop("k"), "examples"), ["lang", "h"], "inner")
    cut = F.regexp_extract_all(fold(F.col("text")), F.lit(f".{{1,{chars}}}(?: |$)|.{{1,{chars}}}"), F.lit(0))
    parts = some.select("lang", F.explode(cut).alias("t")).select("lang", F.rtrim("t").alias("t")).distinct().withColumn("h", F.xxhash64("t"))
    first = parts.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))).filter(F.col("k") <= pieces)
    samples: dict[str, list[bytes]] = {}
    for r in first.orderBy("lang", "k").select("lang", "t").collect():  # languages x pieces x chars, whatever the input
        samples.setdefault(r.lang, []).append(r.t.encode())
    return Model(samples)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_bits (least bits a byte); ``und``, 0 and null if a text is null or has no letter.

    Ties go to the language that is first by name. A column of ``docs`` with one
    of these names is returned with ``_in`` after it. An empty table stays empty;
    a model without languages calls all ``und``.
    """
    docs = aside(docs, "lang_pred", "lang_score", "lang_bits")
    keep, folded = docs.columns, fresh(docs, "folded")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_bits", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column(len(keep)))
            lang: list[str] = []
            score, bits = [np.zeros(0)], [np.zeros(0)]
            for lo, hi in slices(offsets, 8 << 20):
                if shared.value.languages:
                    a, b, c = shared.value.predict(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                else:
                    a, b, c = ["und"] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo)
                lang += a
                score.append(b)
                bits.append(c)
            none = np.diff(offsets) == 0
            names = ["und" if n else x for n, x in zip(none.tolist(), lang, strict=True)]
            s, b = np.concatenate(score), np.concatenate(bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(np.where(none, 0.0, s)), pa.array(b, mask=none)], schema.names)

    has = F.when(F.col(f"`{text}`").rlike(r"\p{L}"), fold(F.col(f"`{text}`")))
    return docs.withColumn(folded, has).mapInArrow(run, schema)


def held_out(key: str = "doc_id", parts: int = 3) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == 1, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = learn(docs.filter(~F.col("held_out")), "text", "lang")
    done = identify(docs.select("doc_id", "text", "held_out"), model)
    return done.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
