"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from meterlake.llm import variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """One inserted, deleted or replaced code point apart, by the definition."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def grouped(counts, ratio=5):
    met = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, others in met.items():
        if others:
            best = min(others, key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(met[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def counted(rows, damage):
    out = Counter()
    for key, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if damage and h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                out[word] += 1
    return {w: n for w, n in out.items() if n >= 5}


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ééééééé", "strasse", "straße", "Ünicode×"]
    long_ = "".join(rng.choice("abcdefg") for _ in range(3000))
    base += [long_, long_[:1500] + long_[1501:], long_[:-1] + "z", "b" * 63, "b" * 64, "b" * 65, "b" * 66, "b" * 64 + "c"]
    return base


def test_counts_and_groups(spark, words):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    rows += [(rows[3][0], rows[3][1])] * 3 + [(None, rows[4][1]), (77, None), (78, ""), (79, "-- 12 \t"), (80, "Été,ÉTÉ;x" * 50)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, word string").repartition(3)
    counts = variants.count_words(docs, damage=7)
    want = counted(rows, 7)
    assert {r.word: r.n for r in counts.collect()} == want
    assert {tuple(r) for r in variants.variant_groups(counts).select("word", "form", "root", "n", "n_near", "form_n").collect()} == grouped(want)


def test_chains_ties_and_other_alphabets(spark):
    counts = {"kitten": 5, "kittens": 25, "kittenss": 125, "kittensss": 3125, "sitten": 25, "mitten": 25, "кириллица": 9, "кирилица": 45, "😀bcdefg": 7, "😀bcdefgh": 7, "alone_": 1}
    got = {tuple(r) for r in variants.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == grouped(counts)
    assert ("kitten", "kittens", "kittensss", 5, 3, 25) in got


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(variants, "deletion_keys", _colliding(variants.deletion_keys))
    words = ["abcdef", "abcdeg", "abcde", "uvwxyz", "uvwxy"]
    keys = next(variants._with_keys(iter([_batch(words)])))
    told = variants._answers(__import__("pyarrow").Table.from_batches([keys]))
    near_ = Counter()
    for w, n in zip(told.column("word").to_pylist(), told.column("near").to_pylist(), strict=True):
        near_[w] += n
    assert near_ == {w: n for w in words if (n := sum(near(w, x) for x in words))}


def _colliding(keys):
    def run(words):
        number, kind, place, key = keys(words)
        return number, kind, place, key & key.dtype.type(3)

    return run


def _batch(words):
    import pyarrow as pa

    return pa.record_batch({"word": words, "word_": words, "n": [1] * len(words)}).rename_columns(["spelled", "word", "n"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = variants.variant_groups(variants.count_words(docs, damage=199))
    assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
