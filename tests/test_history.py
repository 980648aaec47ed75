"""The history by days, its writers, counters on a stream, and progress."""

from __future__ import annotations

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from meterlake import days, store
from meterlake.operators.merge import finalize
from meterlake.operators.sequences import COUNTERS, counter_deltas
from meterlake.plans.adapter import usage
from meterlake.streaming import counters, ingest, progress
from meterlake.tables import cut, cut_tables, shared_dir


@pytest.fixture(scope="module")
def rows(spark):
    return usage(spark, "/root/testdata/sf0.001").cache()


def files_of(path, version):
    return {d: sorted(os.listdir(os.path.join(path, f))) for d, f in version.days.items()}


def test_a_merge_touches_only_its_days(spark, rows, tmp_path):
    path = str(tmp_path / "history")
    # rows of whole session files lie on all days, so a batch of other agents
    first, more = rows.filter("seq % 3 <> 0"), rows.filter("agent not in ('grok', 'windsurf') and (day(ts) = 7 or seq % 50 = 0 and day(ts) < 10)").withColumn("input_tokens", F.col("input_tokens") + 5)
    folder = f"{shared_dir(spark)}/cut".removeprefix("file:")
    had = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    one = ingest.merge_batch(first, path, "m")
    assert set(os.listdir(folder)) == had  # the merge's own tables are gone
    before = files_of(path, one)
    two = ingest.merge_batch(more, path, "m")
    kept = [d for d in one.days if two.days[d] == one.days[d]]
    assert two.number == 2 and kept and len(kept) < len(one.days) and all(files_of(path, two)[d] == before[d] for d in kept)
    old = days.read(spark, path, one)
    priced = ingest.conform(ingest.price_events(more.withColumn("router_cost", F.col("estimated_cost")), ingest.R.rates(spark)))
    whole = finalize(old.unionByName(priced), old, None, "m")
    shown = lambda r: sorted((x.id, str(x.ts), x.total_tokens, x.input_tokens) for x in r.select("id", "ts", "total_tokens", "input_tokens").collect())
    assert shown(store.read_snapshot(spark, path)) == shown(whole)


def test_two_writers_lose_no_row(spark, tmp_path):
    path = str(tmp_path / "history")
    row = lambda i, day: (i, f"id{i}", "amp", "kimi-k3", f"2026-07-{day:02d} 10:00:0{i}", 10 + i, 1, 0, 0)
    make = lambda *r: spark.createDataFrame(list(r), "seq long, id string, agent string, model string, ts string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = lambda *r: days.conform(make(*r))
    base = days.commit(batch(row(0, 1)), path, days.current(spark, path), ["2026-07-01"])
    days.commit(batch(row(1, 2)), path, base, ["2026-07-02"])
    with pytest.raises(days.Conflict):
        days.commit(batch(row(2, 2)), path, base, ["2026-07-02"])
    assert {r.id for r in days.read(spark, path).collect()} == {"id0", "id1"}
    with pytest.raises(ValueError):
        days.commit(batch(row(2, 2)), path, days.current(spark, path), ["2026-07-09"])
    failed = []

    def write(i):
        try:
            days.update(spark, path, lambda _: ["2026-07-02"], lambda old: old.unionByName(batch(row(i, 2))), tries=20)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in (3, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and {r.id for r in days.read(spark, path).collect()} == {"id0", "id1", "id3", "id4"}
    seen = days.current(spark, path)
    (tmp_path / "history/_versions" / f"{seen.number + 1:012d}.json").write_text('{"da')  # a writer that stopped
    assert days.current(spark, path) == days.Version(seen.number + 1, seen.days)
    days.commit(batch(row(6, 3)), path, days.current(spark, path), ["2026-07-03"])
    assert days.clean(spark, path, keep=1) > 0 and days.read(spark, path).count() == 5
    assert days.commit(batch(row(6, 3)).limit(0), path, days.current(spark, path), ["2026-07-03"]).days.keys() == {"2026-07-01", "2026-07-02"}


def test_cut_tables_go(spark):
    folder = f"{shared_dir(spark)}/cut".removeprefix("file:")
    had = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with pytest.raises(ZeroDivisionError), cut_tables():
        cut(spark.range(1))
        raise ZeroDivisionError
    assert set(os.listdir(folder)) == had


def log(n, seed):
    import random

    rng, out = random.Random(seed), []
    into = outof = 0
    for i in range(n):
        into, outof = (into + rng.randint(0, 9), outof + rng.randint(0, 5)) if rng.random() < 0.8 else (rng.randint(0, 5), rng.randint(0, 3))
        out.append((f"s{seed}", i, rng.choice(["message", "token_count", None]), into if rng.random() < 0.95 else None, outof, into // 2, rng.randint(0, 2), "x"))
    return out


def test_counters_on_a_stream_equal_those_of_the_whole(spark, tmp_path):
    schema = "path string, at long, kind string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", other string"
    sessions = [log(40, s) for s in range(6)]
    folder = tmp_path / "in"
    folder.mkdir()
    columns = [c.split()[0] for c in schema.split(", ")]
    for part, (a, b) in enumerate(((0, 13), (10, 14), (14, 40))):  # the second batch brings some rows again
        (folder / f"{part}.json").write_text("".join(json.dumps(dict(zip(columns, r, strict=True))) + "\n" for s in sessions for r in s[a:b]))
        stream = counters.stream_deltas(spark.readStream.schema(schema).json(str(folder)), "path", "at")
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        assert writer.trigger(availableNow=True).start().awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = counter_deltas(spark.createDataFrame([r for s in sessions for r in s], schema), "path", "at")
    plain = lambda d: sorted(tuple(r) for r in d.select(*columns).fillna("", ["kind"]).collect())
    assert plain(got) == plain(want)
    both = counters.stream_deltas(spark.createDataFrame([r for s in sessions for r in s], schema), "path", "at", idle_hours=1)
    assert plain(both) == plain(want)


def test_a_log_is_followed_without_gathering_it(spark):
    """Also one without a name, and one that falls in every row."""
    schema = "path string, at long, kind string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", other string"
    falling = [("f", i, "token_count", 9000 - i, 9000 - i, 1, 1, "x") for i in range(3000)]
    rows = [*log(40, 1), *falling]
    told = counter_deltas(spark.createDataFrame([(None if r[0] == "s1" else r[0], *r[1:]) for r in rows], schema), "path", "at")
    assert "collect_list" not in told._jdf.queryExecution().toString()
    got = {(r.path or "s1", r.at): tuple(r) for r in told.collect()}
    want = {(r.path, r.at): tuple(r) for r in counter_deltas(spark.createDataFrame(rows, schema), "path", "at").collect()}
    assert len(got) == 3040 and {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    assert [got["f", i][3] for i in (0, 1, 2999)] == [9000, 8999, 6001]


def test_revisions_rise_by_one_a_batch(spark, tmp_path):
    told = []
    listener = progress.watch(spark, lambda p: told.append((p.name, p.revision)))
    folder = tmp_path / "in"
    folder.mkdir()
    try:
        for i in range(3):
            (folder / f"{i}.json").write_text('{"a": 1}\n' * (i + 1))
            stream = spark.readStream.schema("a int").json(str(folder)).writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "c"))
            stream.trigger(availableNow=True).start().awaitTermination(60)
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            for _ in range(100):
                if (p := listener.of("watched")) and p.revision == i + 1 and not p.running:
                    break
                threading.Event().wait(0.1)
            assert (p.revision, p.rows, p.running, p.error) == (i + 1, sum(range(1, i + 2)), False, None)
        watched = [r for name, r in told if name == "watched"]
        assert watched == sorted(watched) and watched[-1] == 3
    finally:
        spark.streams.removeListener(listener)
