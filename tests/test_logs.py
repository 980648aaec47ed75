"""Counters, binary numbers and snapshots against brute force."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from meterlake.operators import sequences
from meterlake.schema import USAGE, conform
from meterlake.sources import binary


def expected(log):
    """Usage of one log, row by row: (kind, counters) -> counters."""
    base, out = None, []
    for kind, now in log:
        now = [x or 0 for x in now]
        if base is None and "token" in (kind or "") and (now[0] or now[1]):
            base = [0] * 4
        if base is None or (now[0] < base[0] and now[1] < base[1]):
            out.append(now)
        else:
            out.append([max(0, b - a) for a, b in zip(base, now, strict=True)])
            base = now
    return out


def test_counter_deltas(spark):
    rng = random.Random(9)
    logs = {"none": [("message", [3, 4, None, 0])] * 3, "reset": [("token", [9, 9, 9, 9]), (None, [10, 12, 9, 9]), ("x", [1, 1, 1, 1]), ("x", [2, 2, 2, 2]), ("x", [11, 2, 0, 0]), ("x", [12, 3, 1, 0])]}
    for i in range(40):
        now, log = [0, 0, 0, 0], []
        for _ in range(rng.randint(1, 30)):
            now = [max(0, x + rng.choice([0, 0, 1, 5, 30, -3])) for x in now] if rng.random() > 0.15 else [rng.randint(0, 9) for _ in now]
            log.append((rng.choice(["message", "token_count", None]), [x if rng.random() > 0.05 else None for x in now]))
        logs[f"log{i}"] = log
    rows = [(name, i, kind, *values, "kept") for name, log in logs.items() for i, (kind, values) in enumerate(log)]
    df = spark.createDataFrame(rows, "path string, line_no long, kind string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, more string").repartition(3)
    done = sequences.counter_deltas(df, "path", "line_no")
    assert done.columns == df.columns
    got = {(r.path, r.line_no): [r[c] for c in sequences.COUNTERS] for r in done.collect()}
    assert got == {(name, i): v for name, log in logs.items() for i, v in enumerate(expected(log))}
    assert sequences.counter_deltas(df.limit(0), "path", "line_no").count() == 0


def test_numbers_after_labels(spark):
    label = binary.LABELS["input_tokens"][0]
    f = lambda x: b"\x15" + struct.pack("<f", x)
    cases = [b"", label.encode(), label.encode() + f(12.0), label.encode() + b"abcdef" + f(1500.5), label.encode() + b"abcdefg" + f(3.0), label.encode() + f(-4.0) + f(2.25), label.encode() + f(-0.0), label.encode() + f(6e7) + b"\x00", label.encode() + f(1e-42), (label.encode() + f(7.0)) * 3, label.encode() + f(float("inf")), label.encode() + f(9.0)[:4], b"\xff\x00" + label.encode() + b"\x15" + f(5.0)]

    def brute(data):
        found, at = [], -1
        while (at := data.find(label.encode(), at + 1)) >= 0:
            near = data[at + len(label) :][:11]
            values = [struct.unpack("<f", near[i + 1 : i + 5])[0] for i in range(7) if near[i : i + 1] == b"\x15" and len(near) >= i + 5]
            found += [v for v in values if 0 <= v < 5e7][:1]
        return found

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, content binary")
    got = {r.i: r for r in df.select("i", binary.numbers_after(F.col("content"), label).alias("v"), binary.labelled_total(F.col("content"), "input_tokens").alias("t")).collect()}
    for i, c in enumerate(cases):
        assert got[i].v == pytest.approx(brute(c)) and got[i].t == sum(int(v + 0.5) for v in brute(c)), c


def test_snapshot_survives_a_writer_that_stops(spark, tmp_path):
    from meterlake import store

    def rows(*ids):
        made = spark.createDataFrame([(i, "amp", 5) for i in ids], "id string, agent string, input_tokens long")
        return conform(made.withColumns({c.name: F.lit(None).cast(c.dataType) for c in USAGE if c.name not in made.columns}))

    path = str(tmp_path / "deep" / "snap")
    assert store.read_snapshot(spark, path).count() == 0
    store.write_snapshot(rows("a"), path)
    store.write_snapshot(rows("a", "b"), path)
    real, calls = store._rename, []

    def stops(fs, a, b):
        calls.append(1)
        if len(calls) == 2:  # between the two renames
            raise KeyboardInterrupt
        real(fs, a, b)

    store._rename = stops
    try:
        with pytest.raises(KeyboardInterrupt):
            store.write_snapshot(rows("a", "b", "c"), path)
    finally:
        store._rename = real
    assert {r.id for r in store.read_snapshot(spark, path).collect()} == {"a", "b"}
    kept = store.read_snapshot(spark, path)
    store.write_snapshot(kept.unionByName(rows("d")), path)
    assert {r.id for r in store.read_snapshot(spark, path).collect()} == {"a", "b", "d"}
    assert {r.id for r in store.read_snapshot(spark, f"{path}.bak").collect()} == {"a", "b"}


def test_dominant_token_stays_in_its_row(spark):
    """Matches are exploded and dealt only where several rows share a key; of equals the first wins, by rows of a key their sum."""
    texts = [("a", "xx yy yy xx zz"), ("b", "zz yy zz"), ("c", "1 2"), ("d", None), ("e", "xx yy yy"), ("e", "xx xx"), (None, "yy"), (None, "zz zz"), ("f", "bb aa"), ("e", "")]
    rows = spark.createDataFrame(texts, "id string, text string")
    got = lambda r: {(x.id, x.token, x.n) for x in sequences.dominant_token(r, "id", "text", "[a-z]+").collect()}
    assert got(rows) == {("a", "xx", 2), ("b", "zz", 2), ("e", "xx", 3), (None, "zz", 2), ("f", "bb", 1)}
    alone = rows.filter("id < 'e' or id = 'f'")
    assert got(alone) == {("a", "xx", 2), ("b", "zz", 2), ("f", "bb", 1)}
    plan = sequences.dominant_token(alone, "id", "text", "[a-z]+")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
