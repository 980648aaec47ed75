"""Token ids in binary files of compressed planes.

Ids are cut into blocks of a fixed number. A block is transposed: plane ``b``
holds bit (or byte) ``b`` of all its ids, so that what the high places of ids
share lies together. Each plane is compressed with zstandard on its own, and a
chunk index at the file's end says where each block begins, so that a reader can
decode the ids from any place on without the blocks before it.

A file is a sequence of records, each followed by a newline, because Spark's
text sink writes them: its commit protocol then holds for these files too, on any
file system that Spark writes to, and a task that is run again leaves one file.

    head     magic, version, bits or bytes, planes, ids a block
    block*   planes' sizes, then the planes
    keys     Arrow stream, zstandard: key and number of ids of each document
    index    for each block: offset, size, first id, ids, CRC-32 of its ids
    trailer  part number, number of ids, offset and size of keys and of index, magic
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, _scratch, flat, pieces, read, slices, small_join, word_bounds

MAGIC, END_MAGIC, VERSION = b"PLNF", b"FNLP", 1
HEAD = struct.Struct("<4sHBBI")
TRAILER = struct.Struct(">QQQQQQ4s")  # big-endian: column expressions read the first two numbers
INDEX = np.dtype([("offset", "<u8"), ("size", "<u4"), ("first", "<u8"), ("n", "<u4"), ("crc", "<u4")])
BLOCK_IDS = 1 << 16
FILE_BYTES = 32 << 20
#: Bytes of text that are encoded at once.
STEP_BYTES = 2 << 20
#: Spellings whose ids a worker remembers.
KNOWN = 400_000
#: Letters of ASCII and Latin-1, which composing leaves as they are and which lower-case one by one.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
PLANES = {"bit": 1, "byte": 0}


def to_planes(ids: np.ndarray, width: int, kind: str) -> list[bytes]:
    """The planes of a block of ids that take ``width`` bytes each, lowest place first."""
    raw = np.ascontiguousarray(ids, f"<u{width}").view(np.uint8).reshape(-1, width)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [x.tobytes() for x in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(x, np.uint8) for x in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little") for x in planes])
        raw = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").ravel().astype("<u4")


class Writer:
    """Records of one file: ``add`` takes documents' ids and yields full blocks, ``close`` the rest."""

    def __init__(self, part: int, width: int = 2, kind: str = "byte", block: int = BLOCK_IDS, level: int = 3):
        self.part, self.width, self.kind, self.block = part, width, kind, block
        self.pack = zstandard.ZstdCompressor(level=level)
        self.at, self.done, self.index = 0, 0, []
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.keys: list[pa.Array] = []
        self.counts: list[np.ndarray] = []

    def _put(self, record: bytes) -> bytes:
        self.at += len(record) + 1  # the newline that follows
        return record

    def head(self) -> bytes:
        planes = self.width * (8 if self.kind == "bit" else 1)
        return self._put(HEAD.pack(MAGIC, VERSION, PLANES[self.kind], planes, self.block))

    def _blocks(self, last: bool) -> Iterator[bytes]:
        if self.held < self.block and not (last and self.held):
            return
        ids = np.concatenate(self.pending)
        full = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, full, self.block):
            part = ids[a : min(a + self.block, full)]
            planes = [self.pack.compress(x) for x in to_planes(part, self.width, self.kind)]
            record = struct.pack(f"<{len(planes)}I", *map(len, planes)) + b"".join(planes)
            self.index.append((self.at, len(record), self.done, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            self.done += len(part)
            yield self._put(record)
        self.pending, self.held = [ids[full:]], len(ids) - full

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.pending.append(ids)
        self.held += len(ids)
        yield from self._blocks(last=False)

    def close(self) -> Iterator[bytes]:
        yield from self._blocks(last=True)
        sink = pa.BufferOutputStream()
        table = pa.table({"key": pa.chunked_array(self.keys), "n": np.concatenate(self.counts)})
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        keys_at, keys = self.at, self.pack.compress(sink.getvalue().to_pybytes())
        yield self._put(keys)
        index_at, index = self.at, np.array(self.index, INDEX).tobytes()
        yield self._put(index)
        yield self._put(TRAILER.pack(self.part, self.done, keys_at, len(keys), index_at, len(index), END_MAGIC))


@dataclass
class Reader:
    """One file's content: its documents, and ids from any place on."""

    content: memoryview

    def __post_init__(self) -> None:
        if len(self.content) < HEAD.size + TRAILER.size:
            raise ValueError("not a file of id planes: too short")
        magic, version, kind, self.planes, self.block = HEAD.unpack_from(self.content)
        self.part, self.total, keys_at, keys_n, index_at, index_n, end = TRAILER.unpack_from(self.content, len(self.content) - TRAILER.size - 1)
        if magic != MAGIC or end != END_MAGIC or version != VERSION:
            raise ValueError("not a file of id planes, or cut off")
        self.kind = "bit" if kind == PLANES["bit"] else "byte"
        self.width = self.planes // (8 if self.kind == "bit" else 1)
        self.index = np.frombuffer(self.content[index_at : index_at + index_n], INDEX)
        self.keys_at = (keys_at, keys_n)
        self.unpack = zstandard.ZstdDecompressor()
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def documents(self) -> pa.Table:
        at, n = self.keys_at
        return pa.ipc.open_stream(self.unpack.decompress(self.content[at : at + n])).read_all().combine_chunks()

    def block_ids(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            x = self.index[i]
            at = int(x["offset"])
            sizes = struct.unpack_from(f"<{self.planes}I", self.content, at)
            at += 4 * self.planes
            planes = []
            for size in sizes:
                planes.append(self.unpack.decompress(self.content[at : at + size]))
                at += size
            ids = from_planes(planes, int(x["n"]), self.width, self.kind)
            if zlib.crc32(ids.tobytes()) != int(x["crc"]):
                raise ValueError(f"block {i} of part {self.part} is damaged")
            self.last = (i, ids)
        return self.last[1]

    def between(self, a: int, b: int) -> np.ndarray:
        """Ids from place ``a`` up to ``b`` of this file; only the blocks that hold them are decoded."""
        if a >= b:
            return np.zeros(0, "<u4")
        lo, hi = (int(i) for i in np.searchsorted(self.index["first"], [a, b - 1], side="right") - 1)
        ids = np.concatenate([self.block_ids(i) for i in range(lo, hi + 1)])
        first = int(self.index["first"][lo])
        return ids[a - first : b - first]


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space.

    Such a tokenizer never joins what white space separates, so each distinct
    spelling between white space is encoded once and remembered. ``apart`` are
    ASCII characters that it doesn't join to a letter or digit before them: one
    at the end of a spelling is encoded on its own. Where a trial shows that the
    tokenizer makes one lower-case piece of a run of Latin letters, such spellings go
    to its model at once, without its normalizer and patterns.
    """

    def __init__(self, definition: str, apart: str = ""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = lambda text: byte_level.pre_tokenize_str(text)[0][0]
        self.between = self.mapped("\n")
        self.direct = False
        letters = [chr(i) for i in range(0x41, 0x100) if LETTERS.fullmatch(chr(i))]
        trial = [*letters, *("".join(letters[i : i + n]) for n in (2, 3, 7, 20) for i in range(0, len(letters), 3)), *("".join(letters[i::n]) for n in (5, 11, 50) for i in range(n))]
        self.direct = self._ids(trial, True) == self._ids(trial, False)
        self.apart = np.zeros(256, bool)
        self.apart[list(apart.encode("ascii"))] = True

    def _ids(self, spellings: list[str], direct: bool) -> list[list[int]]:
        if not direct:
            return [x.ids for lo in range(0, len(spellings), 4096) for x in self.tokenizer.encode_batch_fast(spellings[lo : lo + 4096], add_special_tokens=False)]
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(x)] for x in self.mapped("\n".join(spellings).lower()).split(self.between)] if spellings else []

    def _learn(self, spellings: list[str]) -> None:
        if len(self.known) + len(spellings) > KNOWN:
            self.known, self.ids, self.starts = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)
        plain, other = [], spellings
        if self.direct:
            other = []
            for x in spellings:
                (plain if LETTERS.fullmatch(x) else other).append(x)
        spellings, lists = plain + other, self._ids(plain, True) + self._ids(other, False)
        base = len(self.known)
        self.known.update(zip(spellings, range(base, base + len(spellings)), strict=True))
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(size)))

    def _cut(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spellings with their last character cut off where it stands apart."""
        if not len(starts):
            return starts, ends, rows
        last, before, lead = ends - 1, np.maximum(ends - 2, 0), np.maximum(ends - 3, 0)
        letter = ALNUM[buf[before]] | ((buf[lead] == 0xC3) & (lead >= starts) & ~np.isin(buf[before], (0x97, 0xB7)))
        cut = self.apart[buf[last]] & (before >= starts) & (last > starts) & letter
        n = 1 + cut
        where = np.concatenate(([0], np.cumsum(n)))
        new_starts, new_ends = np.repeat(starts, n), np.repeat(ends, n)
        new_starts[where[1:][cut] - 1] = last[cut]
        new_ends[where[:-1][cut]] = last[cut]
        return new_starts, new_ends, where[rows]

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another, each row closed by ``end``, and the number of each row's ids."""
        starts, ends, rows = self._cut(buf, *word_bounds(buf, offsets))
        where = np.concatenate(([0], np.cumsum(ends - starts)))
        letters = buf[~SPACE[buf]]  # the spellings without what is between them
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        spellings = words.dictionary.to_pylist()
        new = [x for x in spellings if x not in self.known]
        if new:
            before = len(self.known)
            self._learn(new)
            if len(self.known) < before + len(new):  # began anew
                self._learn([x for x in spellings if x not in self.known])
        # rows' ends are one more spelling, of one id
        ids, first = np.append(self.ids, np.uint32(end)), np.append(self.starts[:-1], self.starts[-1])
        size = np.append(np.diff(self.starts), 1)
        at = rows + np.arange(len(rows))
        number = np.full(len(starts) + len(rows) - 1, len(self.known))
        inner = np.ones(len(number), bool)
        inner[at[1:] - 1] = False
        if len(starts):
            number[inner] = np.fromiter((self.known[x] for x in spellings), np.int64, len(spellings))[words.indices.to_numpy()]
        n = size[number]
        cut = np.concatenate(([0], np.cumsum(n)))
        return ids[_ramps(first[number], n, cut)], np.diff(cut[at])


@lru_cache(maxsize=1)
def encoder_of(definition: str, apart: str) -> Encoder:
    """A worker's encoder, with what it has learned in tasks before."""
    return Encoder(definition, apart)


def _ramps(starts: np.ndarray, size: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """All places of the stretches of ``size`` from ``starts``, one after another."""
    where = np.concatenate(([0], np.cumsum(size))) if where is None else where
    return np.repeat(starts - where[:-1], size) + np.arange(where[-1])


def write_ids(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2, apart: str = "", planes: str = "byte", block: int = BLOCK_IDS, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all texts, each followed by ``end``, to ``path`` in ascending order of ``key``.

    ``tokenizer`` is a definition file of the tokenizers library that splits at
    white space and drops it; ``apart`` as in ``Encoder``. A null or empty text is ``end`` alone. Null keys come
    first; rows of one key are ordered by a hash of the text, and equal rows
    follow each other in any order, so a key that many rows share is cut over
    files. Other columns of ``docs`` aren't read; an empty table writes no file. Long texts
    are encoded whole. A file holds about ``file_bytes`` of text.
    """
    if planes not in PLANES:
        raise ValueError("planes must be 'bit' or 'byte'")
    spark = docs.sparkSession
    definition = Path(tokenizer).read_text()
    shared = spark.sparkContext.broadcast(definition)  # the vocabulary: grows with no table
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(definition).get_vocab_size(), end + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    files = pieces(rows.agg(F.sum(F.octet_length("text") + 8)).first()[0], file_bytes)
    order = ["key", "tie", "row"]
    placed = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    sorted_ = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = encoder = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer, encoder = Writer(TaskContext.get().partitionId(), width, planes, block), encoder_of(shared.value, apart)
                yield _records([writer.head()])
            buf, offsets = flat(batch.column(1))
            for lo, hi in slices(offsets, STEP_BYTES):
                ids, counts = encoder.encode(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end)
                records = list(writer.add(batch.column(0).slice(lo, hi - lo), ids, counts))
                if records:
                    yield _records(records)
        if writer is not None:
            yield from (_records([x]) for x in writer.close())

    sorted_.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").text(path)


def _records(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, ids, base) of each file: its number, how many ids it holds, and how many all files before it hold.

    The trailers tell. Files are summed by runs of 4096 and numbered within them,
    so no task sees more than a run of files, or one row a run.
    """
    number = lambda i: F.conv(F.hex(F.substring("content", -TRAILER.size - 1 + 8 * i, 8)), 16, 10).cast("long")
    each = _files(spark, path).select(number(0).alias("part"), number(1).alias("ids")).withColumn("run", F.shiftright("part", 12))
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = each.groupBy("run").agg(F.sum("ids").alias("ids")).select("run", before(W.orderBy("run")).alias("run_base"))
    return each.withColumn("base", before(W.partitionBy("run").orderBy("part"))).join(runs, "run").select("part", "ids", (F.col("base") + F.col("run_base")).alias("base"))


def read_ids(spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "long", step: int = 1 << 20) -> DataFrame:
    """(key, part, first, ids) of every document: its file's number, its first id's place in the file, and its ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = Reader(memoryview(content.as_buffer()))
                documents = file.documents()
                at = np.concatenate(([0], np.cumsum(documents.column("n").to_numpy())))
                for lo, hi in slices(at, step):
                    ids = file.between(int(at[lo]), int(at[hi]))
                    offsets = ((at[lo : hi + 1] - at[lo]) * 4).astype(np.int32)
                    packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
                    keys = documents.column("key").slice(lo, hi - lo).combine_chunks()
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(hi - lo, file.part)), pa.array(at[lo:hi]), packed], [key, "part", "first", "ids"])

    return _files(spark, path).select("content").mapInArrow(run, f"`{key}` {key_type}, part long, first long, ids binary")


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(start, ids) for the ids from place ``first`` up to ``last`` of the whole stream, by block; other blocks aren't decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                file = Reader(memoryview(content.as_buffer()))
                for x in file.index:
                    a, b = max(int(x["first"]), first - base), min(int(x["first"]) + int(x["n"]), last - base)
                    if a < b:
                        yield pa.RecordBatch.from_arrays([pa.array([a + base]), pa.array([file.between(a, b).tobytes()], pa.binary())], ["start", "ids"])

    part = F.conv(F.hex(F.substring("content", -TRAILER.size - 1, 8)), 16, 10).cast("long")
    wanted = file_starts(spark, path).filter((F.col("base") < last) & (F.col("base") + F.col("ids") > first)).select("part", "base")
    met = small_join(_files(spark, path).select("content", part.alias("part")), wanted, ["part"], "inner")
    return met.select("content", "base").mapInArrow(run, "start long, ids binary")


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = read(spark, sf_dir, "documents"), _scratch(spark, "ids")
    write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), apart=".,;:!?")
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = read_ids(spark, path, key_type=kind).select("doc_id", "part", "first", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    starts = file_starts(spark, path).select("part", "base")
    return small_join(digest, starts, ["part"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
