"""Token files: exact round trips against the tokenizer on whole texts."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.llm import token_files as t
from meterlake.llm.common import flat

tokenizers = pytest.importorskip("tokenizers")
DEFINITION = __import__("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(DEFINITION)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    letters = "aAbé ñ.,!?'’s<|>\n\t́​5٣ßΣς한글日😀×÷\x85 "
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    out += [None, "", "  \n", "<|endoftext|> end. <|startoftext|>.", "it's. IT'S, l'été. ×. ÷, a÷. …. é́. 5. ٣.", "x" * 50_000, "word. " * 40_000, out[0], out[0]]
    return out


def test_encoder_equals_whole_texts(tokenizer, texts):
    for apart in ("", ".,;:!?"):
        buf, offsets = flat(pa.array(texts))
        ids, counts = t.Encoder(open(DEFINITION).read(), apart).encode(buf, offsets, 2)
        want = [[*x.ids, 2] for x in tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_encoder_forgets_and_learns_again(tokenizer, texts, monkeypatch):
    monkeypatch.setattr(t, "KNOWN", 40)
    encoder = t.Encoder(open(DEFINITION).read())
    for text in texts[:20]:
        ids, _ = encoder.encode(*flat(pa.array([text])), 2)
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes(planes, width):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << (8 * width - 1), n).astype(np.uint32)
        assert (t.from_planes(t.to_planes(ids, width, planes), n, width, planes) == ids).all()


@pytest.mark.parametrize("planes,block,file_bytes", [("byte", t.BLOCK_IDS, t.FILE_BYTES), ("bit", 100, 20_000)])
def test_files(spark, tokenizer, texts, tmp_path, planes, block, file_bytes):
    rows = [(i if i % 50 else None, x, i) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, record long").repartition(4)
    path = str(tmp_path / "ids")
    t.write_ids(docs, path, DEFINITION, planes=planes, block=block, file_bytes=file_bytes)
    got = t.read_ids(spark, path).join(t.file_starts(spark, path), "part").withColumn("start", F.col("base") + F.col("first")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    want = {i: [*tokenizer.encode(x or "", add_special_tokens=False).ids, 2] for i, x, _ in rows if i is not None}
    assert {r.doc_id: i for r, i in zip(got, ids, strict=True) if r.doc_id is not None} == want
    if block == 100:
        assert len({r.part for r in got}) > 3
    stream = [i for x in ids for i in x]
    for a, b in ((0, 1), (95, 1205), (len(stream) - 3, len(stream) + 5)):
        part = t.read_range(spark, path, a, b).orderBy("start").collect()
        assert [i for r in part for i in np.frombuffer(r.ids, "<u4").tolist()] == stream[a:b]


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words to write " * 50)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    t.write_ids(docs, path, DEFINITION)
    (name,) = glob.glob(f"{path}/part-*")
    content = open(name, "rb").read()
    reader = t.Reader(memoryview(content))
    assert zlib.crc32(reader.between(0, reader.total).tobytes()) == int(reader.index["crc"][0])
    at = int(reader.index["offset"][0]) + int(reader.index["size"][0]) - 2
    with pytest.raises(Exception):
        t.Reader(memoryview(content[:at] + bytes([content[at] ^ 255]) + content[at + 1 :])).between(0, 5)
    with pytest.raises(ValueError):
        t.Reader(memoryview(content[:-1]))


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "ids")
    t.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, DEFINITION)
    assert t.read_ids(spark, path).collect() == [] and t.file_starts(spark, path).collect() == []
