"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest vocabulary entry at each point
of a word. The vocabulary is a trie; where a node has no child for the next
byte, its failure link leads to the node that is left after popping whole
tokens, and the number of popped tokens is known beforehand. Following links
ahead of time gives one table (node, byte) -> (node, popped), so counting takes
one look-up per byte and builds no pieces. A node without children pops its
token at once and is replaced by its failure target, which keeps the table to
inner nodes.

Words are runs of bytes other than space, tab, newline, vertical tab, form feed
and return, and are matched with one space before them, as the byte-level
vocabularies have it. White space ends a word, so a text can be cut at any white
space: a batch becomes many short lanes that advance together in numpy.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, flat, read, slices

POP_BITS = 6
#: The state in which a word can't be matched: it counts as one unknown token.
UNKNOWN = "unknown"
LANE = 512
#: Lanes of more bytes hold a very long word.
LONG = 1 << 13


class Automaton:
    """Tables of the longest-match automaton.

    ``table[node * 256 + byte]`` holds ``next node << POP_BITS | popped``;
    ``closing[node]`` the tokens popped at a word's end, -1 if none match;
    ``start`` the node after the space before a word.
    """

    def __init__(self, vocabulary: Iterable[bytes], first: bytes = b" ") -> None:
        child: list[dict[int, int]] = [{}]
        token = [False]
        for piece in vocabulary:
            if not piece:
                continue
            node = 0
            for byte in piece:
                node = child[node].setdefault(byte, len(child))
                if node == len(child):
                    child.append({})
                    token.append(False)
            token[node] = True
        fail, popped = [-1] * len(child), [0] * len(child)
        queue = [0]
        for node in queue:  # by depth: links of shorter strings are known
            for byte, to in child[node].items():
                queue.append(to)
                if token[to]:
                    fail[to], popped[to] = 0, 1
                    continue
                at, count = fail[node], popped[node]
                while at >= 0 and byte not in child[at]:
                    at, count = fail[at], count + popped[at]
                if at >= 0:
                    fail[to], popped[to] = child[at][byte], count
        inner = [n for n in queue if child[n] or n == 0]
        number = {n: i for i, n in enumerate(inner)}
        dead = len(inner)

        def settle(node: int, count: int) -> tuple[int, int]:
            while node >= 0 and node not in number:  # a leaf pops at once
                node, count = fail[node], count + popped[node]
            return (number[node], count) if node >= 0 else (dead, 0)

        self.table = np.full((dead + 1, 256), dead << POP_BITS, np.int32)
        self.closing = np.full(dead + 1, -1, np.int32)
        for i, n in enumerate(inner):
            if fail[n] >= 0:
                to, count = settle(fail[n], popped[n])
                row = self.table[to]
                alive = row >> POP_BITS != dead
                self.table[i] = np.where(alive, row + count, row)
            for byte, to in child[n].items():
                at, count = settle(to, 0)
                self.table[i, byte] = at << POP_BITS | count
            at, count = n, 0
            while at > 0:
                at, count = fail[at], count + popped[at]
            self.closing[i] = count if at == 0 else -1
        if int((self.table & ((1 << POP_BITS) - 1)).max()) >= (1 << POP_BITS) - 1:
            raise ValueError("too many tokens popped by one byte")
        state, count = 0, 0
        for byte in first:
            step = int(self.table[state, byte])
            state, count = step >> POP_BITS, count + (step & ((1 << POP_BITS) - 1))
        self.start, self.before = state, count
        self.table = self.table.ravel()

    def walk(self, raw: bytes) -> tuple[int, int]:
        """(tokens, words) of one stretch that begins and ends with a word's bounds, byte by byte."""
        total, words, mask = 0, 0, (1 << POP_BITS) - 1
        table, closing = memoryview(self.table), self.closing
        for word in raw.split():
            state, popped = self.start, self.before
            for byte in word:
                step = table[state << 8 | byte]
                state = step >> POP_BITS
                popped += step & mask
            end = int(closing[state])
            total += popped + end if end >= 0 else 1
            words += 1
        return total, words

    def count(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, words) of each row."""
        rows = len(offsets) - 1
        tokens, words = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        if not len(buf):
            return tokens, words
        starts = lanes(buf, offsets)
        ends = np.append(starts[1:], len(buf))
        row = np.searchsorted(offsets, starts, side="right") - 1
        length = ends - starts
        for i in np.flatnonzero(length > LONG).tolist():  # an unbroken word: one after the other is faster
            n, m = self.walk(buf[starts[i] : ends[i]].tobytes())
            tokens[row[i]] += n
            words[row[i]] += m
        rest = length <= LONG
        starts, length, row = starts[rest], length[rest], row[rest]
        if not len(starts):
            return tokens, words
        by = np.argsort(-length, kind="stable")
        starts, length, row = starts[by], length[by], row[by]
        state = np.full(len(starts), -1, np.int64)  # -1: between words
        seen, total, popped = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        dead = len(self.closing) - 1

        def close(which: np.ndarray) -> None:
            end = self.closing[state[which]]
            total[which] += np.where(end >= 0, popped[which] + end, 1)
            seen[which] += 1
            state[which] = -1

        live = len(starts)
        for step in range(int(length[0])):
            while live and length[live - 1] <= step:
                live -= 1
            byte = buf[starts[:live] + step]
            s = state[:live]
            space = SPACE[byte]
            over = np.flatnonzero(space & (s >= 0))
            if len(over):
                close(over)
            begin = np.flatnonzero(~space & (s < 0))
            s[begin] = self.start
            popped[begin] = self.before
            inside = np.flatnonzero(~space)
            move = self.table[s[inside] * 256 + byte[inside]]
            s[inside] = move >> POP_BITS
            popped[inside] += move & ((1 << POP_BITS) - 1)
        left = np.flatnonzero(state >= 0)
        close(left)
        assert dead >= 0
        np.add.at(tokens, row, total)
        np.add.at(words, row, seen)
        return tokens, words


def lanes(buf: np.ndarray, offsets: np.ndarray, least: int = LANE) -> np.ndarray:
    """Starts of lanes: the rows' starts, and about every ``least`` bytes the next white space."""
    gap = np.flatnonzero(SPACE[buf])
    marks = np.arange(0, len(buf), least)
    at = np.searchsorted(gap, marks)
    cuts = gap[at[at < len(gap)]]
    return np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], cuts)))


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file with one base64 string and rank a line."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_bytes, n_words, n_tokens) of every row.

    Null and empty texts have none; a word that the vocabulary can't spell is
    one token. Rows are counted one by one, so repeated rows and ties play no
    part; other columns of ``docs`` aren't read; an empty table gives none. The automaton (about 40 MB for 50,000 entries, whatever the
    input) is built once and broadcast.
    """
    automaton = Automaton(read_ranks(vocabulary or default_vocabulary()))
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column(1))
            out = [shared.value.count(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets, 4 << 20)]
            tokens, words = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(words), pa.array(tokens)], [key, "n_bytes", "n_words", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_words long, n_tokens long")


def op1_token_count(spark, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
