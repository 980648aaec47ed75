"""Spelling variants: words one inserted, deleted or replaced code point apart, found by rolling-hash deletions.

Two words are near if one is the other without one code point, or if both are the
same without the code point at one place. The hash of a word without its place i
follows from a prefix and a suffix polynomial hash, so numpy makes all deletion
keys of many words at once. Keys are integers; Spark deals their top bits (radix
partitions) and each partition sorts its keys. A group of equal keys is checked on
the strings themselves, so a collision of hashes links nothing.

A group is answered in one pass, without its pairs: words that are the same
without place i are near each other, so each has all the others and needs to know
only the most frequent of them; a word that is another one without a place meets
exactly those longer ones.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, flat, materialize, read, slices
from .rolling import BASE, mix, prefix

#: Kinds of keys: a whole word or a word without one place; words without place i, keyed with i.
WHOLE, LESS, SAME = 0, 1, 2
KEYS = "bucket int, key long, kind byte, place int"
RADIX_BITS = 12
#: Code points of words for which numpy makes keys at once.
STEP_POINTS = 1 << 17
#: Words of more code points have their keys counted before strings are joined to those that meet.
LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()


def crc_on(seeds: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of ``buf``, each continued from the checksum of what stands before it; short ones byte by byte, all at once."""
    long_ = ends - starts > LONG
    state = seeds ^ np.uint32(0xFFFFFFFF)
    left = np.flatnonzero(~long_)
    at = starts.copy()
    while len(left := left[at[left] < ends[left]]):
        state[left] = CRC_TABLE[(state[left] ^ buf[at[left]]) & np.uint32(0xFF)] ^ (state[left] >> np.uint32(8))
        at[left] += 1
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(long_).tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(seeds[i]))
    return out


def runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ASCII letters and of U+00C0 to U+00FF in UTF-8: starts, ends and rows."""
    lead = buf == 0xC3
    on = lead | ((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122))
    on[1:] |= lead[:-1]
    before = np.concatenate(([False], on[:-1]))
    before[offsets[:-1][offsets[:-1] < len(buf)]] = False
    after = np.concatenate((on[1:], [False]))
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(on & ~before)
    return starts, np.flatnonzero(on & ~after) + 1, np.searchsorted(offsets, starts, side="right") - 1


def words_of(buf: np.ndarray, offsets: np.ndarray, keys: list, damage: int, least: int) -> pa.Table:
    """(word, n): the rows' runs of at least ``least`` code points after damage, counted."""
    low = LOWER[buf]
    starts, ends, rows = runs(low, offsets)
    low = np.append(low, np.uint8(32))
    continued = np.concatenate(([0], np.cumsum((low & 0xC0) == 0x80)))
    length = ends - starts - (continued[ends] - continued[starts])
    hurt = np.zeros(0, np.int64)
    if damage:
        seeds = np.fromiter((zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys), np.uint32, len(keys))
        h = crc_on(seeds[rows], low, starts, ends)
        hurt = np.flatnonzero(h % np.uint32(damage) == 0)
    whole = np.ones(len(starts), bool)
    whole[hurt] = False
    keep = np.flatnonzero(whole & (length >= least))
    size = ends[keep] - starts[keep]
    where = np.concatenate(([0], np.cumsum(size)))
    letters = low[np.repeat(starts[keep] - where[:-1], size) + np.arange(where[-1])]
    words = pa.Array.from_buffers(pa.large_string(), len(keep), [None, pa.py_buffer(where), pa.py_buffer(letters)])
    broken = []
    for i in hurt[length[hurt] > least].tolist():
        word, cut = low[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(length[i])
        broken.append(word[:cut] + word[cut + 1 :])
    counts = pa.chunked_array([words, pa.array(broken, pa.large_string())]).value_counts()
    return pa.table({"word": counts.field(0).cast(pa.string()), "n": counts.field(1)})


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int = 0, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lowered) of whole texts.

    Words of at least ``least_length`` code points that occur at least
    ``least_count`` times. With ``damage``, a run loses one code point where
    ``damage`` divides the CRC-32 of its key and itself. Null and empty texts have
    no words, a null key is an empty one, repeated rows count each time, long texts
    are read whole, other columns aren't read, and an empty table gives no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column(1))
            for lo, hi in slices(offsets, 8 << 20):
                keys = batch.column(0).slice(lo, hi - lo).to_pylist() if damage else []
                yield from words_of(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], keys, damage, least_length).to_batches()

    rows = docs.select(F.col(key).cast("string"), F.col(text))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's number, kind, place, 64-bit key) of all keys of some words."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate(([0], np.cumsum(size)))
    whose = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - first[whose]
    # sum of value * BASE ** place over the places before and after, the latter moved one place to the front
    values = mix(points + np.uint64(1))
    h = prefix(values)  # over all words at once; BASE is odd, so powers have inverses
    inverse = _inverse_powers(len(points) + 1)
    start = inverse[first[whose]]
    before = (h[np.arange(len(points))] - h[first[whose]]) * start
    after = (h[first[whose + 1]] - h[np.arange(len(points)) + 1]) * start * inverse[1]
    less = mix(before + after + size[whose].astype(np.uint64))  # of one code point less than size
    whole = mix((h[first[1:]] - h[first[:-1]]) * inverse[first[:-1]] + (size + 1).astype(np.uint64))
    same = mix(less ^ (np.uint64(BASE) * (place + 1).astype(np.uint64)))
    # of equal code points in a row any may go: only the first one's deletion is a key
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == points[:-1]) & (place[1:] > 0)
    number = np.concatenate((np.arange(len(words)), whose[~again], whose))
    kind = np.repeat(np.array([WHOLE, LESS, SAME], np.int8), [len(words), int((~again).sum()), len(points)])
    at = np.concatenate((np.full(len(words), -1), place[~again], place)).astype(np.int32)
    return number, kind, at, np.concatenate((whole, less[~again], same))


def _inverse_powers(n: int) -> np.ndarray:
    steps = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _keys_of(words: DataFrame, *told: str) -> DataFrame:
    """Keys of words, with the columns ``told`` of their words."""
    kinds = [f"`{c}` {words.schema[c].dataType.simpleString()}" for c in told]
    return words.select(F.col("word").alias("spelled"), *told).mapInArrow(_with_keys, ", ".join([KEYS, *kinds]))


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(flat(batch.column(0))[1], STEP_POINTS):
            number, kind, place, key = deletion_keys(batch.column(0).slice(lo, hi - lo).to_pylist())
            which = pa.array(number + lo)
            for a in range(0, len(which), 1 << 20):  # a very long word has as many keys
                part = slice(a, a + (1 << 20))
                bucket = (key[part] >> np.uint64(64 - RADIX_BITS)).astype(np.int32)
                told = [c.take(which[part]) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key[part].view(np.int64)), pa.array(kind[part]), pa.array(place[part]), *told], ["bucket", "key", "kind", "place", *batch.schema.names[1:]])


def _rest(word: str, place: int) -> str:
    return word if place < 0 else word[:place] + word[place + 1 :]


def _answers(table: pa.Table) -> pa.Table:
    """For each word of some groups of equal keys: how many near words it meets there, and the most frequent one (ties: the least)."""
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1], [True])) if len(key) else np.ones(1, bool)
    edge = np.flatnonzero(new)
    busy = np.flatnonzero(np.diff(edge) > 1)
    rows = order[np.concatenate([np.arange(edge[i], edge[i + 1]) for i in busy])] if len(busy) else order[:0]
    group = np.repeat(np.arange(len(busy)), np.diff(edge)[busy])
    met = table.select(["kind", "place", "word", "n"]).take(pa.array(rows))
    kinds, places, words, counts = (met.column(c).to_pylist() for c in ("kind", "place", "word", "n"))
    groups: dict[tuple, list[tuple[int, str]]] = {}
    # equal keys may still be of different strings: the string without its place decides
    for g, kind, place, word, n in zip(group.tolist(), kinds, places, words, counts, strict=True):
        where = (g, SAME, place, _rest(word, place)) if kind == SAME else (g, kind, _rest(word, place))
        groups.setdefault(where, []).append((-n, word))
    out: tuple[list, list, list, list] = ([], [], [], [])

    def tell(word: str, near: int, best: tuple[int, str]) -> None:
        for column, x in zip(out, (word, near, -best[0], best[1]), strict=True):
            column.append(x)

    for where, members in groups.items():
        if where[1] == SAME and len(members) > 1:
            best, second = sorted(members)[:2] if len(members) < 8 else _two_least(members)
            for x in members:
                tell(x[1], len(members) - 1, second if x == best else best)
        elif where[1] == WHOLE and (longer := groups.get((where[0], LESS, where[2]))):
            tell(members[0][1], len(longer), min(longer))
            for x in longer:
                tell(x[1], 1, members[0])
    return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.int64()), "best_n": pa.array(out[2], pa.int64()), "best": pa.array(out[3], pa.string())})


def _two_least(members: list[tuple[int, str]]) -> tuple[tuple[int, str], tuple[int, str]]:
    best = min(members)
    return best, min(x for x in members if x != best)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near ones; ``best`` is the one of largest n, of ties the least.

    Words are distinct and not null. A group of equal keys has at most as many
    words as there are code points that can stand at one place. A word of L code
    points has about 2 L keys; those of long words travel without the word until
    it is known which of them meet another.
    """
    words = words.select("word", F.col("n").cast("long").alias("n"))
    length = F.char_length("word")
    keys = _keys_of(words.filter(length <= LONG), "word", "n")
    long_ = words.filter(length > LONG).withColumns({"w1": F.xxhash64("word"), "w2": F.hash("word")})
    if not long_.isEmpty():
        slim = _keys_of(long_, "w1", "w2", "n")
        meeting = slim.select("key").unionByName(_keys_of(words.filter(length == LONG)).select("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key")
        met = slim.join(meeting, "key").join(long_.select("w1", "w2", "word"), ["w1", "w2"])
        keys = keys.unionByName(met.select(*keys.columns))
    found = keys.groupBy("bucket").applyInArrow(_answers, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of (word, n).

    ``form`` is the near word of largest n if that is at least ``ratio`` times the
    word's own; ``root`` is where forms lead. Counts grow by ``ratio`` at each step,
    so no form leads back, and halving the way takes rounds by the logarithm of
    the logarithm of the largest count.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    far = F.col("best_n") >= ratio * F.col("n")
    known = words.join(near_words(words), "word", "left")
    known = materialize(known.select("word", F.when(far, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best_n")).alias("form_n")), "forms")
    ways = known.filter("form is not null").select("word", F.col("form").alias("root"))
    largest = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(largest + 1, ratio)))
    for _ in range(math.ceil(math.log2(steps + 1))):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = materialize(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return known.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variant_groups(count_words(read(spark, sf_dir, "documents"), damage=199))


#: The same by joining words without each of their places; the checksum is worked out bit by bit.
SQL = r"""WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '') AS cs FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(cs, lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS h FROM each),
hurt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM hurt WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM less d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM less d JOIN w ON d.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -m, 'other': other}) AS b FROM near GROUP BY 1),
told AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN b.other END AS form, CASE WHEN -b.m >= 5 * n THEN -b.m END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
way AS (SELECT word, word AS root, 0 AS step FROM told UNION ALL SELECT way.word, told.form, step + 1 FROM way JOIN told ON told.word = way.root WHERE told.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY 1)
SELECT told.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM told JOIN roots ON told.word = roots.word"""
