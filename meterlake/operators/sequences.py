"""Operators over ordered records of files and conversations: carried values, turns, counters, contexts, claims and gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens_of_chars
from ..tables import cut
from .dedup import running_window
from .pricing import first_by


def carry_forward(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``rows`` with the last known value of each column, up to and with their own."""
    w = running_window(keys, order)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def turn_segments(rows: DataFrame, keys: list[str], order: str, starts: Column, ends: Column, chars: dict[str, Column], ts: str = "ts", last: dict[str, Column] | None = None) -> DataFrame:
    """(keys, turn, start_ts, end_ts, sums): turns from a start mark to the first end mark after it; turns without an end are left out.

    ``chars`` names what is summed over the rows of a turn, ``last`` what is taken from its last row.
    """
    w = running_window(keys, order)
    cut = rows.withColumns({"turn": F.sum(F.when(starts, 1).otherwise(0)).over(w), "_end": F.when(ends, 1).otherwise(0)}).filter("turn > 0")
    ended = F.sum("_end").over(running_window([*keys, "turn"], order)) - F.col("_end")
    inside = cut.withColumn("_before", ended).filter("_before = 0")
    out = inside.groupBy(*keys, "turn").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), *[F.sum(c).cast("long").alias(n) for n, c in chars.items()], *[F.max_by(c, order).alias(n) for n, c in (last or {}).items()], F.max("_end").alias("_closed"))
    return out.filter("_closed = 1").drop("_closed")


def cumulative_delta(rows: DataFrame, keys: list[str], order: str, counters: list[str]) -> DataFrame:
    """``rows`` with counters that only grow as differences to the row before; after a fall the difference is 0."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumns({c: F.greatest(F.lit(0), F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).cast("long") for c in counters})


COUNTERS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]


def _own_counts(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by key and order: counters become counts. What is kept between rows is a log's last totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, running, last = (), False, (0, 0, 0, 0)
        for batch in batches:
            own = []
            for k, begins, *c in zip(*(batch.column(x).to_pylist() for x in (key, "_begins", *COUNTERS)), strict=True):
                if k != log:
                    log, running, last = k, False, (0, 0, 0, 0)
                running = running or begins
                if running and not (c[0] < last[0] and c[1] < last[1]):
                    own.append([max(0, x - y) for x, y in zip(c, last, strict=True)])
                    last = c
                else:
                    own.append(c)
            told = dict(zip(COUNTERS, zip(*own, strict=True), strict=True)) if own else {}
            names = [n for n in batch.schema.names if n != "_begins"]
            yield pa.RecordBatch.from_arrays([pa.array(told[n], pa.int64()) if n in told else batch.column(n) for n in names], names)

    return run


def counter_deltas(rows: DataFrame, key: str, order: str, kind: str = "kind") -> DataFrame:
    """Token counters of a log whose mode must be guessed, as usage: input, output, cache_read and cache_write of each row.

    Up to the first row with tokens whose kind names tokens, counters are counts.
    From there on they are running totals: a row counts by what it has more than
    the last such row. A row in which input and output both fell is a count
    again, and the next row is compared with the one before it. ``order`` is
    unique within a file. A file's rows are followed in order, in one pass over
    sorted rows that holds a batch of them; files are dealt to tasks. Unknown
    counters are 0; an empty table stays empty.
    """
    known = rows.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in COUNTERS})
    schema = known.schema
    begins = F.coalesce(F.col(kind), F.lit("")).contains("token") & (F.greatest("input_tokens", "output_tokens") > 0) & F.col(order).isNotNull()
    return known.withColumn("_begins", begins).repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(_own_counts(key), schema)


def context_estimate(rows: DataFrame, keys: list[str], order: str, text: str = "text", speaker: str = "role", answers: str = "assistant") -> DataFrame:
    """(keys, order, input_tokens, output_tokens) of each answer: all that came before it is its input, itself its output."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    size = F.coalesce(F.length(text), F.lit(0))
    seen = rows.withColumns({"_size": size, "_before": F.coalesce(F.sum(size).over(w), F.lit(0))}).filter(F.col(speaker) == answers)
    return seen.select(*keys, order, tokens_of_chars(F.col("_before")).alias("input_tokens"), tokens_of_chars(F.col("_size")).alias("output_tokens"))


def prompt_peaks(rows: DataFrame, keys: list[str], order: str, done: Column, total: str, cached: str, chars: str) -> DataFrame:
    """Greatest total and cached tokens and summed output of each prompt, over its rows up to its completion (all of them if there is none)."""
    end = F.min(F.when(done, F.col(order))).over(W.partitionBy(*keys))
    upto = rows.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    return upto.groupBy(*keys).agg(F.max(total).alias("peak_total"), F.max(cached).alias("peak_cached"), F.sum(chars).cast("long").alias("output_chars"))


def compact_name(model: Column) -> Column:
    """A model's name without its provider, lower-cased and dashed."""
    return F.regexp_replace(F.element_at(F.split(F.lower(F.trim(model)), "/"), -1), r"[_\s]+", "-")


def models_fit(a: Column, b: Column) -> Column:
    """Whether two compact names may be one model: one is unknown, they are equal, one is within the other, or they differ in effort only."""
    base = lambda c: F.regexp_replace(F.regexp_replace(c, r"-\(x?high\)$", ""), r"-x?high$", "")
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return ~known | (a == b) | a.contains(b) | b.contains(a) | (base(a) == base(b))


def interval_claims(calls: DataFrame, windows: DataFrame, slack_s: int = 2, bin_s: int = 300) -> DataFrame:
    """Calls (call_id, ts, model) with the first window (seq, start_ts, end_ts, model) that holds them; a call is claimed once.

    Windows are dealt to the time bins they touch, so that the join has an equal
    key; the exact condition follows.
    """
    end = F.col("end_ts") + F.expr(f"INTERVAL {slack_s} SECONDS")
    to_bin = lambda c: F.floor(F.unix_micros(c) / (bin_s * 1_000_000))
    wide = windows.withColumn("_end", end).withColumn("_bin", F.explode(F.sequence(to_bin(F.col("start_ts")), to_bin(F.col("_end")))))
    wide = wide.select("_bin", F.col("seq").alias("window_seq"), "start_ts", "_end", compact_name(F.col("model")).alias("_wm"))
    met = calls.withColumns({"_bin": to_bin(F.col("ts")), "_cm": compact_name(F.col("model"))}).join(wide, "_bin").filter((F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= F.col("_end")) & models_fit(F.col("_wm"), F.col("_cm")))
    best = met.groupBy("call_id").agg(F.min("window_seq").alias("window_seq"))
    return calls.join(best, "call_id")


def unclaimed(windows: DataFrame, claims: DataFrame) -> DataFrame:
    """Windows that no call fell into."""
    return windows.join(claims.select(F.col("window_seq").alias("seq")).distinct(), "seq", "left_anti")


def uncovered(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key hasn't been seen elsewhere."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def session_gaps(sessions: DataFrame, parts: DataFrame, key: str = "session_id") -> DataFrame:
    """What sessions count beyond the sum of their parts: input, output, cache_read, cache_write and calls, where tokens are left.

    Both have reasoning tokens, which are output. ``cost`` is the session's only where its parts have none.
    """
    names = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = lambda c: z(c) + z("reasoning_tokens") if c == "output_tokens" else z(c)
    had = parts.groupBy(key).agg(*[F.sum(whole(c)).alias(f"_{c}") for c in names], F.sum(z("api_calls")).alias("_calls"))
    met = sessions.join(had, key, "left")
    gap = {c: F.greatest(F.lit(0), whole(c) - z(f"_{c}")).cast("long") for c in names}
    free = z("_input_tokens") + z("_output_tokens") == 0
    out = met.select(key, "model", "ts", "workspace", *[gap[c].alias(c) for c in names], F.greatest(F.lit(0), z("api_calls") - z("_calls")).cast("long").alias("api_calls"), F.when(free, F.col("cost")).alias("router_cost"))
    return out.filter(" + ".join(names) + " > 0").withColumn("estimated", F.lit(True))


def argmax_model(rows: DataFrame, keys: list[str], model: str = "model", tokens: str = "tokens", order: str = "seq") -> DataFrame:
    """The model with most tokens of each key; the first of equals."""
    sums = rows.groupBy(*keys, model).agg(F.sum(tokens).alias("_t"), F.min(order).alias("_o"))
    return sums.groupBy(*keys).agg(F.max_by(model, F.struct("_t", -F.col("_o"))).alias(model), F.max("_t").cast("long").alias(tokens))


def dominant_token(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """The most frequent match of a pattern in each text; of equals the one that comes first.

    A text's matches are counted in its row. Only texts of keys that several rows
    share are dealt by match.
    """
    zero = F.lit(0).cast("long")
    none = F.struct(F.lit("").alias("run"), zero.alias("k"), zero.alias("at"), F.lit("").alias("token"), zero.alias("n"), zero.alias("first"))

    def longer(acc: Column, x: Column) -> Column:
        same = (acc["k"] > 0) & (acc["run"] == x["token"])
        k, at = F.when(same, acc["k"] + 1).otherwise(F.lit(1).cast("long")), F.when(same, acc["at"]).otherwise(x["at"])
        more = (k > acc["n"]) | ((k == acc["n"]) & (at < acc["first"]))
        return F.struct(x["token"].alias("run"), k.alias("k"), at.alias("at"), *[F.when(more, new).otherwise(acc[c]).alias(c) for c, new in (("token", x["token"]), ("n", k), ("first", at))])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ordered = F.sort_array(F.transform(found, lambda t, i: F.struct(t.alias("token"), i.cast("long").alias("at"))))
    own = rows.select(key, F.aggregate(ordered, none, longer).alias("_own")).filter("_own.n > 0")
    own = cut(own.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.first("_own.token").alias("token"), F.first("_own.n").alias("n")))
    once, several = own.filter("_rows = 1").select(key, "token", "n"), own.filter("_rows > 1").select(F.col(key).alias("_key"))
    if several.isEmpty():
        return once
    shared = rows.join(several, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(key, F.posexplode(found).alias("at", "token"))
    counts = shared.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    return once.unionByName(counts.groupBy(key).agg(F.max_by("token", F.struct("n", -F.col("at"))).alias("token"), F.max("n").alias("n")))


def newest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).filter(F.col("_n") <= n).drop("_n")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return first_by(rows, [key], [F.col(order)])


def uncached(full: Column, cached: Column) -> Column:
    """Input that wasn't in the cache."""
    return F.greatest(F.lit(0), full - cached)


def output_with_reasoning(output: Column, reasoning: Column, agent: Column) -> Column:
    """grok counts reasoning within the output, hermes beside it; others have none."""
    r = F.coalesce(reasoning, F.lit(0))
    return F.when(agent == "grok", F.greatest(output, r)).when(agent == "hermes", output + r).otherwise(output)


def of_ticks(ticks: Column) -> Column:
    """USD of a cost in ten-billionths."""
    return ticks / F.lit(1e10)


def size_estimate(n_bytes: Column) -> dict[str, Column]:
    """Tokens of a log that can't be read, from its size: eight bytes each, twelve in large ones; 65 % input."""
    n = n_bytes.cast("double")
    total = F.greatest(F.lit(1), F.floor(n / F.when(n < 50_000, 8.0).otherwise(12.0) + 0.5)).cast("long")
    into = F.floor(total * 0.65 + 0.5).cast("long")
    return {"input_tokens": into, "output_tokens": F.greatest(F.lit(1), total - into).cast("long")}
