"""The ten operators on small fixtures, against brute force, round trips or held-out rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from meterlake.llm import common, decontamination, langid, mixing, ogg, pst, rolling, sharding, simhash, suffix_dedup, token_count, window_dedup
from meterlake.llm.common import flat, word_bounds
from meterlake.llm.repeats import KEY, keyed

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ordinary texts, copies, shared passages, repeats within a text, empty and null ones, and a long one."""
    rng = random.Random(7)
    shared, long_ = prose(rng, 120), prose(rng, 3000)
    out = [prose(rng, rng.randint(1, 300)) for _ in range(30)]
    out += [prose(rng, 40) + " " + shared + " " + prose(rng, 30), shared + "\n" + prose(rng, 9), long_ + " " + shared, shared + " " + prose(rng, 50) + " " + shared]
    out += ["x" * 1000, "é ü " * 300, out[0], out[0], "", None, " \t ", "ab"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spans(units, n):
    """Removed places by brute force: covered by a window that starts anywhere else."""
    counts = Counter(tuple(u[i : i + n]) if isinstance(u, list) else u[i : i + n] for u in units for i in range(len(u) - n + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - n + 1):
            if counts[tuple(u[i : i + n]) if isinstance(u, list) else u[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("most", [1024, 2])
def test_suffix_dedup(spark, docs, texts, most):
    raw = [(t or "").encode() for t in texts]
    done = suffix_dedup.remove_repeated_bytes(docs, most_blocks=most)
    got = {r.doc_id: r for r in keyed(docs, "text").select("doc_id", *KEY).join(done, KEY).collect()}
    for i, (b, gone) in enumerate(zip(raw, spans(raw, 400), strict=True)):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(b) else 0
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), int(gone.sum()), runs, kept)
    assert suffix_dedup.remove_repeated_bytes(empty(spark)).count() == 0


def test_window_dedup(spark, docs, texts):
    units = [(t or "").split() for t in texts]
    done = window_dedup.remove_repeated_windows(docs)
    got = {r.doc_id: r for r in keyed(docs, "text").select("doc_id", *KEY).join(done, KEY).collect()}
    for i, (u, gone) in enumerate(zip(units, spans(units, 35), strict=True)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(u), int(gone.sum()), " ".join(w for w, g in zip(u, gone, strict=True) if not g))
    assert window_dedup.remove_repeated_windows(empty(spark)).count() == 0


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    rng = random.Random(3)
    base = [prose(rng, 200) for _ in range(12)]
    texts = base + [b + " More" for b in base] + [b.replace("w1 ", "w2 ", 1) for b in base] + [None, "", "A b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == fps
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(texts))]
    assert [got[i][1] for i in range(len(texts))] == root
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_near_fingerprints_against_all_pairs(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in fps for k in (1, 3, 4)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = {(max(a, b), min(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    df = spark.createDataFrame([(s,) for s in set(signed)], "fp long")
    of = {r.node: r.root for r in simhash.components(simhash.near_fingerprints(df)).collect()}
    root = {s: s for s in signed}
    for _ in signed:  # least fingerprint reachable, by brute force
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert of == {x: root[x] for p in pairs for x in p}


def test_similar_texts_against_all_pairs(spark):
    """Pairs just above and below 0.8, and chains of them, by exact Jaccard similarity of five-word shingles."""
    rng = random.Random(11)
    texts = ["", " "]
    for n in (20, 120, 300):
        for _ in range(12):
            base = prose(rng, n).split()
            cuts = [round(n * x) for x in (0.76, 0.79, 0.8, 0.81, 0.84)]
            texts += [" ".join(base), *(" ".join([*base[:k], *(["new"] if k % 2 else [])]) for k in cuts)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    root = list(range(len(texts)))
    close = [[j for j in range(len(texts)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(texts))]
    for _ in texts:
        root = [min(root[j] for j in close[i]) for i in range(len(texts))]
    for k in range(6):  # a part of the texts at a time, so that pairs aren't joined by their neighbours
        some = sorted({0, 1, *range(2, len(texts), 6), *range(2 + k, len(texts), 6)}) if k else list(range(len(texts)))
        df = spark.createDataFrame([(i, texts[i]) for i in some], "doc_id long, text string")
        of = {r.node: r.root for r in simhash.similar_texts(df, **({"group_shingles": 900} if k == 1 else {})).collect()}
        node = {r.doc_id: r.node for r in df.select("doc_id", F.xxhash64("text").alias("node")).collect()}
        got = {(i, j) for i in some for j in some if of.get(node[i], node[i]) == of.get(node[j], node[j])}
        if k:
            assert got == {(i, j) for i in some for j in some if j in close[i]}, k
        else:
            assert got == {(i, j) for i in some for j in some if root[i] == root[j]}


def test_similar_texts_meet_in_the_grid(spark):
    """Without samples, op5's fingerprints alone bring texts together, and the exact similarity decides."""
    rng = random.Random(29)
    base = [prose(rng, 400).split() for _ in range(8)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:k], "new", *b[k + 1 :]]) for b in base for k in (3, 200)]
    texts += ["a b c d e a b c", "a b c d e a b c a b c d e a b c d e a b c"]  # fingerprints may meet, sets of shingles differ
    fps = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 3)) for t in texts]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    close = {(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    near = {(i, j) for i, j in close if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert len(near) > 8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    node = {r.doc_id: r.node for r in df.select("doc_id", F.xxhash64("text").alias("node")).collect()}
    for more in ({}, {"group_shingles": 1}):
        of = {r.node: r.root for r in simhash.similar_texts(df, samples=0, **more).collect()}
        got = {(i, j) for i in range(len(texts)) for j in range(i) if of.get(node[i], node[i]) == of.get(node[j], node[j])}
        assert near <= got <= close


def test_sharding(spark, docs):
    rows = docs.select("doc_id", "text")
    a = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_shards(rows, F.col("doc_id"), [1.0] * 24, grown=1.0).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign_shards(rows, F.col("doc_id"), [1.0] * 25).collect()}
    assert all(g in (s, 24) and g == b[k] for k, (s, g) in a.items())
    many = sharding.assign_shards(spark.range(40_000).withColumnRenamed("id", "doc_id"), F.col("doc_id"), [1.0, 2.0, 1.0])
    n = {r.shard: r["count"] for r in many.groupBy("shard").count().collect()}
    assert abs(n[1] - 20_000) < 600
    slots = sharding.number_slots(many, ["doc_id"]).groupBy("shard").agg(F.min("slot"), F.max("slot"), F.count_distinct("slot")).collect()
    assert all(r[1] == 0 and r[2] + 1 == r[3] == n[r.shard] for r in slots)
    with pytest.raises(ValueError):
        sharding.assign_shards(rows, F.col("doc_id"), [0.0])


def mixed(docs):
    rows = mixing.one_by_one(mixing.mix(mixing.sizes_of(docs)), "place")
    return rows.withColumn("taken", F.col("size") * (F.col("times") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)))


def test_mixing(spark, docs):
    got = mixed(docs).collect()
    assert len(got) == docs.count()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.src, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
    assert mixed(docs.limit(0)).count() == 0


def test_mixing_meets_targets_with_null_and_repeated_keys(spark):
    """Rows without doc_id, and many equal rows, are told apart or counted: each source ends within one row of its target."""
    rows = [(None, f"a b c {i}" if i < 500 else "the same ten words are in each of these rows", "x", None) for i in range(900)]
    rows += [(1, "one two", "y", 7) for _ in range(300)] + [(i, "w " * (i % 9), None, None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mixed(df).collect()
    assert len(got) == len(rows)
    for src in ("x", "y", None):
        own = [r for r in got if r.src == src]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
    again = mixed(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.src), r.size, r.h, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    clash = mixing.mix(mixing.sizes_of(df).withColumns({"target": F.lit("mine"), "tag": F.lit(1)}))
    assert {"target_in", "tag", "target", "more"} <= set(clash.columns) and clash.first().target_in == "mine"
    spread = mixing.one_by_one(mixing.sizes_of(df), "place", step=64)
    assert sorted(r.place for r in spread.filter("doc_id = 1 and size = 2").collect() if r.src == "y") == list(range(1, 301))


def test_ogg(spark, docs, texts):
    back = {r.doc_id: r for r in ogg.from_ogg(ogg.to_ogg(docs.select("doc_id", "text"))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert bytes(back[i].payload) == raw + b" " * (-len(raw) % 192 or (0 if raw else 192)) and back[i].n_bytes == len(raw)
    media = bytearray(ogg.encode(b"z" * 70_000))
    whole = ogg.read_pages(bytes(media))
    assert b"".join(whole[ogg.AUDIO].packets[1:])[:70_000] == b"z" * 70_000
    media[40_000] ^= 1
    hurt = ogg.read_pages(bytes(media))[ogg.AUDIO]
    assert hurt.pages == whole[ogg.AUDIO].pages - 1 and len(hurt.packets) < len(whole[ogg.AUDIO].packets)
    # CRC-32 with polynomial 0x04C11DB7, bit by bit
    crc = 0
    for byte in b"OggS test":
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    assert ogg.checksum(b"OggS test") == crc
    bad = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "doc_id long, media binary")
    assert {r.feature for r in ogg.from_ogg(bad).collect()} == {"damaged"}


def test_token_count(spark, docs, texts):
    vocabulary = token_count.read_ranks(token_count.default_vocabulary())
    known, most = set(vocabulary), max(map(len, vocabulary))

    def brute(text):
        n = 0
        for word in (text or "").split():
            piece = b" " + word.encode()
            while piece:
                size = next((k for k in range(min(most, len(piece)), 0, -1) if piece[:k] in known), 1)
                piece, n = piece[size:], n + 1
        return n

    got = {r.doc_id: r for r in token_count.count_tokens(docs).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_words, got[i].n_bytes) == (brute(t), len((t or "").split()), len((t or "").encode()))


def test_language_model(spark):
    rng = random.Random(1)
    texts = [" ".join(f"{w} next{w}" for w in rng.choices(WORDS[:20], k=60)) for _ in range(60)] + [None, "", "Unseen w1"]
    df = spark.createDataFrame([(i, t, i % 5 == 1) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in pst.score_texts(df).collect()}
    tokens = lambda t: [*(t or "").lower().split(), "\0end"]
    counts = Counter(x for i, t in enumerate(texts) if i % 5 != 1 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(x in counts for x in tokens(t)), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)))
    held = [r for r in got.values() if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + len(held)
    assert pst.score_texts(df.limit(0)).count() == 0


def brute_scores(train, texts, discount=0.75):
    """log10 probabilities of texts (lists of words) by contexts of up to two words in plain dicts."""
    grams = [Counter(), Counter(), Counter()]
    for t in train:
        t = [*t, "/"]
        grams[0].update((w,) for w in t)
        for d in (1, 2):
            grams[d].update(tuple(["/", *t][i : i + d + 1]) for i in range(len(t) + 1 - d))
    n, v = sum(grams[0].values()), len(grams[0])
    root = lambda w: (grams[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))
    kept = [{}, {}]

    def p(context, w):
        if not context:
            return root(w)
        q = p(context[1:], w)
        if context not in kept[len(context) - 1]:
            return q
        total, back = kept[len(context) - 1][context]
        c = grams[len(context)][(*context, w)]
        return ((c - discount) / total if c >= 2 else 0) + back * q

    for d in (1, 2):
        by = {}
        for g, c in grams[d].items():
            if c >= 2:
                by.setdefault(g[:-1], {})[g[-1]] = c
        for context, nexts in by.items():
            total = grams[d - 1][context]
            back = 1 - sum((c - discount) / total for c in nexts.values())
            gained = sum(c * np.log(((c - discount) / total + back * p(context[1:], w)) / p(context[1:], w)) for w, c in nexts.items())
            if gained + (total - sum(nexts.values())) * np.log(back) > 0.5 * (len(nexts) + 1) * np.log(total):
                kept[d - 1][context] = total, back
    return [sum(np.log10(p(tuple(["/", *t][max(0, i - 1) : i + 1]), w)) for i, w in enumerate([*t, "/"])) for t in texts]


def test_language_model_keeps_contexts_of_small_share(spark):
    """A context seen 6 times in over 100,000 tokens counts, whatever its share; all scores as by brute force."""
    rng = random.Random(2)
    texts = [[rng.choice(WORDS) for _ in range(200)] for _ in range(520)]
    for t in texts[:6]:
        t[50:53] = ["rare", "pair", "here"]
    texts += [["rare", "pair", "here"], ["w1", "rare", "w2"]]
    held = [i >= 518 for i in range(len(texts))]
    df = spark.createDataFrame([(i, " ".join(t), h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in pst.score_texts(df).collect()}
    want = brute_scores([t for t, h in zip(texts, held, strict=True) if not h], texts)
    assert [got[i].score for i in range(len(texts))] == pytest.approx(want)
    assert got[520].score > got[520].base_score + 5


def test_language_model_over_pieces(spark):
    """Grams that several tasks hold, some twice in one and some once in two; texts without a training row; scores as by brute force."""
    rng = random.Random(3)
    texts = [[rng.choice(WORDS[:40]) for _ in range(rng.randrange(1, 30))] for _ in range(300)]
    held = [i % 4 == 1 or i >= 290 for i in range(len(texts))]
    df = spark.createDataFrame([(str(i), " ".join(t), h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id string, text string, held_out boolean").repartition(7)
    got = {r.doc_id: r for r in pst.score_texts(df).collect()}
    want = brute_scores([t for t, h in zip(texts, held, strict=True) if not h], texts)
    assert [got[str(i)].score for i in range(len(texts))] == pytest.approx(want)
    none = pst.score_texts(df.withColumn("held_out", F.lit(True))).collect()
    assert len(none) == 300 and all(r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0) for r in none)


def test_language_model_asks_little():
    """A pair is asked for by under six bytes, of words that no text repeats none is; a triple only if both of its pairs are repeated."""
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 60, 100_000, dtype=np.uint64))
    assert np.array_equal(pst.unpacked_keys(pst.packed_keys(keys)), keys) and len(pst.packed_keys(keys)) < 6 * len(keys)
    words = np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    places = np.array([*range(50), 0, 1, 2, 3])
    piece = pa.table({"pid": [0], "held": pa.array([[False]]), **{n: pa.array([x], pa.binary()) for n, x in (("lengths", pst.packed(np.array([54]))), ("words", pst.packed_keys(words)), ("places", pst.packed(places)))}})
    answers = {"what": [], "level": [], "bucket": [], "data": []}
    asks = lambda: pst._Piece(piece, pa.table(answers), 1, 2, 54, 50, 0.75, 2).asked
    first = asks()
    assert {(a[0], a[1]) for a in first} == {(pst.COUNT, 0), (pst.COUNT, 1)}
    for what, level, bucket, *_, counts in (a[:6] for a in first):
        for name, x in zip(answers, (what, level, bucket, pst.packed(pst.unpacked(counts) * 2 + 1)), strict=True):
            answers[name].append(x)
    triples = [a for a in asks() if a[:2] == (pst.COUNT, 2)]
    assert sum(len(pst.unpacked_keys(a[4])) for a in triples) == 2 and sum(int(pst.unpacked(a[5]).sum()) for a in triples) == 4


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labelled = docs.withColumn("held", langid.held_out())
    done = langid.identify(labelled, langid.learn(labelled.filter("not held"), "text", "lang")).filter("held and lang is not null and text is not null").select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in done if r.lang_pred != "und"]) > 0.95
    model = langid.Model({"a": [b"abcabc"], "b": [b"xyz"]})
    assert model.phrases(np.frombuffer(b"abcabcxyz", np.uint8), np.array([0, 6, 9])).tolist() == [[1, 6], [3, 1]]  # each of the bytes never seen is one phrase
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?")], "doc_id long, text string")
    assert {r.lang_pred for r in langid.identify(odd, model).collect()} == {"und"}


def test_language_examples_beside_many_copies(spark):
    few = [(f"{a}{b} {b}{a} wort", "de") for a in "abcde" for b in "qrst"]
    copies = spark.range(400_000).select(F.lit("same old words").alias("text"), F.lit("de").alias("lang"))
    other = spark.createDataFrame([*few, ("zwei drei", "xx")], "text string, lang string")
    model = langid.learn(copies.unionByName(other), "text", "lang")
    assert model.languages == ["de", "xx"]
    assert model.bits.tolist() == pytest.approx([np.log2(sum(len(t) for t, _ in few) + 14), np.log2(9)])


def test_decontamination(spark):
    rng = random.Random(9)
    item = prose(rng, 30)
    changed = item.split()
    changed[10] = changed[20] = "other"
    rows = [(1, prose(rng, 50) + " " + item.upper() + ". " + prose(rng, 20)), (2, prose(rng, 30) + " " + " ".join(changed)), (3, prose(rng, 200)), (4, None), (5, ""), (6, " ".join(item.split()[:8]))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, leaks string").drop("leaks")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontamination.flag_leaks(docs, bench).collect()}
    assert got == {1: [7], 2: [7], 3: [], 4: [], 5: [], 6: []}
    assert decontamination.flag_leaks(docs, bench.limit(0)).filter("size(leaks) > 0").count() == 0


def test_short_benchmark_items_are_found_as_whole_lines(spark):
    """Items of one to seven tokens against every line of texts, by comparing lists of tokens."""
    rng = random.Random(11)

    def words_of(t):
        return "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in t or "").split()

    items = [(1, "same"), (2, "Two words"), (3, "a b, c d e f g"), (4, "a b c d e f g h"), (5, "two  WORDS!"), (6, "..."), (7, None), (8, "é ü")]
    parts = ["same", "SAME.", "same same", "two words", "two words more", "a b c d e f g", "a b c d e f g h", "é-ü", "", "..", "two", "words"]
    texts = ["".join(rng.choice(parts) + rng.choice(["\n", "\r\n", " ", "\n\n"]) for _ in range(rng.randint(0, 6))) for _ in range(300)] + ["same", "\nsame", "same\n", "not the same", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        found = [words_of(x) for x in (t or "").replace("\r", "\n").split("\n")]
        want[i] = {k for k, x in items if 0 < len(words_of(x)) < decontamination.SHORTEST and words_of(x) in found}
    for block in (16_000_000, 10):
        got = {r.doc_id: [x.item_id for x in r.leaks if x.item_tokens < decontamination.SHORTEST] for r in decontamination.flag_leaks(docs, bench, block_chars=block).collect()}
        assert {i: set(x) for i, x in got.items()} == want and all(len(x) == len(set(x)) for x in got.values())
    one = decontamination.flag_leaks(docs.filter("doc_id = 300"), bench.filter("item_id = 1")).first().leaks[0]
    assert (one.overlap, one.matched, one.item_tokens, one.start) == (1, 1, 1, 0)


def test_decontamination_finds_all_that_qualifies():
    """All places of substitutions in whole items, with unrelated tokens around, against all stretches of the line."""

    def qualifies(same, need):
        return any(5 * sum(same[x:y]) >= 4 * (y - x) for x in range(len(same)) for y in range(x + need, len(same) + 1))

    for n, k in [(8, 1), (9, 2), (10, 2), (12, 2), (12, 3), (13, 3), (15, 3), (16, 1), (16, 2), (16, 4), (20, 3), (20, 4)]:
        index = decontamination.Index([(1, " ".join(f"t{i}" for i in range(n)))])
        places = list(combinations(range(n), k))
        texts = [f"y{j} z{j} " + " ".join(f"x{j}" if i in p else f"t{i}" for i in range(n)) + f" v{j}" for j, p in enumerate(places)]
        ends = np.cumsum([0, *(len(t) for t in texts)])
        got = index.search(np.frombuffer("".join(texts).encode(), np.uint8), ends)
        want = [qualifies([i not in p for i in range(n)], min(13, -(-4 * n // 5))) for p in places]
        assert [bool(g) for g in got] == want, (n, k)
    assert decontamination.longest(np.array([1, 0, 1, 1, 1, 1, 0, 0], bool), 0.8) == (0, 6, 5)


def test_language_phrases_are_those_of_one_parse(spark):
    """Phrases against a greedy parse by substring search, in texts of many blocks."""
    rng = random.Random(2)
    samples = {"a": ["".join(rng.choice("abc ") for _ in range(90)) for _ in range(3)], "b": ["".join(rng.choice("bcde ") for _ in range(200))]}
    model = langid.Model({k: [t.encode() for t in v] for k, v in samples.items()})
    texts = ["".join(rng.choice("abcdeéf ") for _ in range(n)) for n in (1, 5, 1023, 1024, 1025, 3000, 5000)] + ["", samples["a"][0] * 40, "a" * 4000]

    def phrases(raw, known):
        n, i = 0, 0
        while i < len(raw):
            j = i
            while j < len(raw) and any(raw[i : j + 1] in k for k in known):
                j += 1
            n, i = n + 1, max(j, i + 1)
        return n

    got = model.phrases(*flat(pa.array(texts)))
    for j, name in enumerate(model.languages):
        known = [t.encode() for t in samples[name]]
        assert got[:, j].tolist() == [phrases(t.encode(), known) for t in texts]


def test_language_learns_from_all_of_a_text(spark):
    """Only the ends of long texts tell these languages apart."""
    same = "zz " * 3000
    rows = [(f"{same} {x * 200}{i}", lang) for i in range(40) for lang, x in (("p", "abab baba "), ("q", "cdcd dcdc "))]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", pieces=400)
    docs = spark.createDataFrame([("abab baba abab", "mine", 1), ("dcdc cdcd cdcd", None, None), (None, "", 2)], "text string, lang_pred string, folded int")
    got = langid.identify(docs, model)
    assert [r.lang_pred for r in got.collect()] == ["p", "q", "und"]
    assert got.columns == ["text", "lang_pred_in", "folded", "lang_pred", "lang_score", "lang_bits"] and got.first().lang_pred_in == "mine"
    assert langid.identify(docs, model).count() == 3 and langid.identify(docs.limit(0), model).count() == 0


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", "mine"), (2, None, "yours")], "doc_id long, text string, media string")
    back = ogg.from_ogg(ogg.to_ogg(docs).withColumnsRenamed({"doc_id": "n_bytes"}))
    assert {r.n_bytes_in: (bytes(r.payload)[:9], r.media_in, r.n_bytes) for r in back.collect()} == {1: (b"some text", "mine", 9), 2: (b" " * 9, "yours", 0)}
    assert ogg.from_ogg(ogg.to_ogg(docs.limit(0))).count() == 0
    keyed_ = docs.withColumnsRenamed({"media": "shard"}).withColumns({"slot": F.lit("s"), "best": F.lit(1), "bucket": F.lit(2)})
    placed = sharding.number_slots(sharding.assign_shards(keyed_, F.col("doc_id"), [1.0, 1.0], grown=1.0), ["doc_id"])
    assert {"shard_in", "slot_in", "best", "bucket", "shard", "slot"} <= set(placed.columns) and placed.count() == 2
    assert sharding.number_slots(sharding.assign_shards(keyed_.limit(0), F.col("doc_id"), [1.0]), ["doc_id"]).count() == 0
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    benchmark = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    leaky = spark.createDataFrame([(f"x {item} y", "mine"), ("clean", None), (None, None)], "text string, leaks string")
    for block in (16_000_000, 20):
        got = decontamination.flag_leaks(leaky, benchmark, block_chars=block).collect()
        assert [(len(r.leaks), r.leaks_in) for r in got] == [(1, "mine"), (0, None), (0, None)]
    assert decontamination.flag_leaks(leaky.limit(0), benchmark).count() == 0 and decontamination.flag_leaks(leaky, benchmark.limit(0)).count() == 3
    assert token_count.count_tokens(docs.limit(0)).count() == 0 and token_count.count_tokens(docs.unionByName(docs)).count() == 4


def test_token_count_of_very_long_words(spark):
    """Long unbroken words are counted one by one: as much as by the tables in step."""
    rng = random.Random(4)
    automaton = token_count.Automaton(token_count.read_ranks(token_count.default_vocabulary()))
    long_ = "".join(rng.choice("abcdefgé") for _ in range(6000))
    texts = [f"a {long_} b", long_[:3000], f"{long_}{long_} {long_} x", "short words"]
    columns = flat(pa.array(texts))
    at_once, token_count.LONG, kept = automaton.count(*columns), 1 << 40, token_count.LONG
    try:
        in_step = automaton.count(*columns)
    finally:
        token_count.LONG = kept
    assert [x.tolist() for x in at_once] == [x.tolist() for x in in_step]


def test_scratch_tables(spark):
    kept = common.materialize(spark.range(5), "t")
    assert kept.count() == 5 and common.clustered(spark.range(9).withColumnRenamed("id", "k1"), ["k1"], "t").count() == 9
    common.drop_scratch(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("meterlake_")]


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, pipeline):
    done = pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(done) and set(done["shard"]) <= set(range(24)) and done["text"].notna().all()
    digests = {hashlib.sha256(t.encode()).hexdigest() for t in done["text"]}
    assert len(digests) == done["doc_id"].nunique()


def test_pipeline_stages_one_by_one(spark, pipeline, docs):
    """Each stage alone: nulls, empty and repeated rows, columns with clashing names, and an empty table."""
    sf = "/root/testdata/sf0.001"
    extra = docs.withColumns({"node": F.lit("n"), "shard": F.lit("s"), "lang_pred": F.lit("l"), "h_": F.lit(1), "leaks": F.lit("k")})
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        out = stage(spark, extra, sf)
        added = ["shard_in"] if name == "sharding" else []
        assert set(extra.columns) | set(added) == set(out.columns)
        rows = out.collect()
        assert {r["node"] for r in rows} <= {"n"} and {r["shard_in" if added else "shard"] for r in rows} <= {"s"}
    by = dict(pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = by["language_id"](spark, docs, sf).collect()
    assert all(r.text and any(c.isalpha() for c in r.text) for r in kept)
    assert {"ab"} <= {r.text for r in kept}  # too short to tell
    unlabelled = by["language_id"](spark, docs.withColumn("lang", F.lit(None).cast("string")), sf).collect()
    assert {r.doc_id for r in unlabelled} == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    once = by["near_dedup"](spark, docs, sf).collect()
    wordless = [i for i, t in texts.items() if not (t or "").split()]
    assert [r.doc_id for r in once if not (r.text or "").split()] == [min(wordless)]
    assert Counter(r.text for r in once).most_common(1)[0][1] == 1 and 0 in {r.doc_id for r in once}
    shards = by["sharding"](spark, docs, sf).collect()
    assert len(shards) == len(texts) and all(0 <= r.shard < 24 for r in shards)
    many = docs.unionByName(docs).unionByName(docs)
    taken = Counter(r.doc_id for r in by["mixing"](spark, many, sf).collect())
    want = Counter()
    for r in mixed(many).collect():
        want[r.doc_id] += r.taken // max(r.size, 1)
    assert taken == +want


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 else b for i in range(n))


def test_words_whose_polynomial_hashes_collide(spark):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2**64; they are different words."""
    for n, a, b in ((1024, "a", "b"), (2048, "a", "b"), (512, "i", "y"), (512, "L", "Z")):
        buf, offsets = flat(pa.array([thue_morse(n, a, b), thue_morse(n, b, a)]))
        starts, ends, _ = word_bounds(buf, offsets)
        assert len(set(rolling.word_values(buf, starts, ends).tolist())) == 2
        h = rolling.prefix(rolling.byte_values(buf))
        assert rolling.stretch(h, np.array([0]), np.array([n - 7])) != rolling.stretch(h, np.array([n]), np.array([2 * n - 7]))
    common = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{common} {thue_morse(1024, 'a', 'b')}"), (2, f"{common} {thue_morse(1024, 'b', 'a')}")]
    done = window_dedup.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_removed for r in done.collect()] == [0, 0]
    done = suffix_dedup.remove_repeated_bytes(spark.createDataFrame([(i, thue_morse(4096, *x)) for i, x in enumerate((("a", "b"), ("b", "a")))], "doc_id long, text string"))
    texts = [thue_morse(4096, "a", "b").encode(), thue_morse(4096, "b", "a").encode()]
    assert sorted(r.n_removed for r in done.collect()) == sorted(int(g.sum()) for g in spans(texts, 400))


def test_repeats_in_very_long_texts(spark):
    """Texts beyond the bytes worked on at once: a passage in two of them, and twice in one, goes and nothing else does."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    passage = " ".join(word() for _ in range(200))
    fill = [" ".join(word() for _ in range(150_000)) for _ in range(4)]
    texts = [f"{fill[0]} {passage} {fill[1]}", f"{fill[2]} {passage} 1 {passage} {fill[3]}"]
    assert all(len(t) > 2 * (1 << 20) for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bytes_ = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(docs).collect())
    for (n, gone), t, times in zip(bytes_, sorted(texts, key=len), (1, 2), strict=True):
        assert n == len(t) and times * len(passage) <= gone <= times * (len(passage) + 6)  # spaces and chance letters beside it may repeat too
    words = sorted((r.n_words, r.n_removed) for r in window_dedup.remove_repeated_windows(docs).collect())
    assert words == [(300_200, 200), (300_401, 400)]


def test_many_blocks_of_one_gram(spark):
    """A passage that many texts share in different surroundings: its blocks are cut into parts and windows, and nothing is lost."""
    rng = random.Random(5)
    passage = prose(rng, 90)
    texts = [prose(rng, rng.randint(1, 40)) + " " + passage[rng.randint(0, 40) :] + " " + prose(rng, rng.randint(1, 40)) for _ in range(60)]
    texts += texts[:3] + [texts[5][:700] + "!" + texts[6][3:]]
    raw = [t.encode() for t in texts]
    want = sorted((t, int(g.sum())) for t, g in zip(texts, spans(raw, 400), strict=True))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (2, 8, 64):
        done = suffix_dedup.remove_repeated_bytes(docs, most_blocks=most)
        got = keyed(docs, "text").join(done, KEY).select("text", "n_removed").collect()
        assert sorted((r.text, r.n_removed) for r in got) == want
