"""Router days: request rows against day rollups, without losing or double counting usage.

A day has rollups (estimated rows) and requests. Sums for each agent and day
decide by an ordered chain of conditions which of them count; the decision is
joined back. Days are never gathered: every step is an aggregation with partial
sums or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import time
from ..functions.text import normalize_model, stable_id
from ..schema import conform, cost, day, is_estimated, is_router, requests, weight
from ..tables import cut
from .dedup import dedupe_mixed, richest

ROLLUPS, REQUESTS, BOTH, FILLED = "rollups", "requests", "both", "filled"


def _name() -> Column:
    return F.coalesce(F.nullif(F.trim("model"), F.lit("")), F.lit("mixed"))


def _workspace() -> Column:
    return F.coalesce(F.trim("workspace"), F.lit(""))


def day_choice() -> Column:
    """Which rows of a day count, from its sums: d_* of rollups, q_* of requests (n rows, tok, cost, req). The first condition that holds decides."""
    dn, dt, dc, dr = (F.col(f"d_{x}") for x in ("n", "tok", "cost", "req"))
    qn, qt, qc, qr = (F.col(f"q_{x}") for x in ("n", "tok", "cost", "req"))
    sure = (dr >= 10) | (dt >= 100_000) | ((dc > 0) & (dt >= 10_000))
    over = sure & (((dt > 0) & (qt > dt * 1.05)) | ((dc > 0) & (qc > dc * 1.15) & (qt >= dt * 0.9)))
    probes = (dr > 0) & (dt > 0) & (qr > F.greatest(dr * 1.5, dr + 5)) & (qt <= dt * 1.05) & (qt >= dt * 0.5)
    near = (qn >= 20) & (dt > 0) & (qt >= dt * 0.9) & (qt <= dt * 1.35) & ((dr <= 0) | ((qr >= dr * 0.75) & (qr <= F.greatest(dr * 1.25, dr + 10))))
    match = (dt > 0) & (qt >= dt * 0.95) & (qt <= dt * 1.05) & ((dr <= 0) | (qr <= F.greatest(dr * 1.25, dr + 3)))
    sample = (qn >= 2) & ((qn >= 20) | (qt >= dt * 0.15) | ((dr > 0) & (qr >= dr * 0.15)) | (qn > dn))
    return (
        F.when(dn == 0, REQUESTS)
        .when(qn == 0, ROLLUPS)
        .when((qn >= 20) & (dt > 0) & (qt >= F.greatest(dt * 2, dt + 50_000)), BOTH)
        .when(near, F.when(qt < dt * 0.98, FILLED).otherwise(REQUESTS))
        .when(probes | over, ROLLUPS)
        .when(~sure & (qt > dt), REQUESTS)
        .when(match, REQUESTS)
        .when(sample & (qt < dt * 0.98), FILLED)
        .otherwise(ROLLUPS)
    )


def day_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of rollups and requests for each day, in one pass."""
    kind = {"d": is_estimated(), "q": ~is_estimated()}
    sums = []
    for k, which in kind.items():
        put = lambda c, zero, which=which: F.sum(F.when(which, c).otherwise(zero))
        sums += [F.count(F.when(which, 1)).alias(f"{k}_n"), put(weight(), 0).alias(f"{k}_tok"), put(cost(), 0.0).alias(f"{k}_cost"), put(requests(), 0).alias(f"{k}_req")]
    return rows.groupBy(*keys).agg(*sums)


def day_gaps(rollups: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """What rollups hold beyond the requests of their model (and workspace, if any match): rows whose tokens sum to the remainder exactly."""
    calls = calls.withColumns({"_m": _name(), "_w": _workspace()})
    sums = lambda by, tag: calls.groupBy(*keys, *by).agg(F.sum(requests()).alias(f"{tag}_n"), F.sum(weight()).alias(f"{tag}_tok"), F.sum(cost()).alias(f"{tag}_cost"))
    fine, coarse = sums(["_m", "_w"], "f"), sums(["_m"], "g")
    met = rollups.withColumns({"_m": _name(), "_w": _workspace()}).join(fine, [*keys, "_m", "_w"], "left").join(coarse, [*keys, "_m"], "left")
    had = lambda c: F.when(F.col("f_n").isNotNull(), F.col(f"f_{c}")).otherwise(F.coalesce(f"g_{c}", F.lit(0)))
    zero = F.lit(0)
    met = met.withColumns({"rt": F.greatest(zero, weight() - had("tok")), "rc": F.greatest(F.lit(0.0), cost() - had("cost")), "rr": F.greatest(zero, requests() - had("n")), "h_n": had("n"), "h_tok": had("tok")})
    covered = ((F.col("rt") <= 0) & (F.col("rc") <= 0) & (F.col("rr") <= 0)) | ((F.col("h_tok") >= weight()) & (F.col("h_n") >= requests()) & (weight() > 0))
    ratio = F.when(weight() > 0, F.col("rt") / weight()).otherwise(0.0)
    part = lambda c: F.greatest(zero, F.floor(F.coalesce(F.col(c), zero) * ratio)).cast("long")
    met = met.filter(~covered).withColumns({"p_in": part("input_tokens"), "p_out": part("output_tokens"), "p_cr": part("cache_read_tokens"), "p_cw": part("cache_write_tokens")})
    rest = F.col("p_out") + F.col("p_cr") + F.col("p_cw")
    over = (F.col("rt") > 0) & (F.col("p_in") + rest > F.col("rt"))
    none = lambda c: F.when(over, 0).otherwise(F.col(c))
    into = F.when(F.col("rt") <= 0, F.col("p_in")).when(over, F.col("rt")).otherwise(F.col("rt") - rest)
    out = met.select(*rollups.columns, "_m", "_w", "rt", "rc", "rr", into.cast("long").alias("n_in"), *[none(c).cast("long").alias(f"n{c[1:]}") for c in ("p_out", "p_cr", "p_cw")])
    total = F.col("n_in") + F.col("n_out") + F.col("n_cr") + F.col("n_cw")
    out = out.withColumn("n_total", total).filter("n_total > 0 or rc > 0 or rr > 0")
    return out.withColumns(
        {
            "id": F.concat_ws(":", F.lit("gapfill"), "agent", day(), "_m", F.coalesce(F.nullif("_w", F.lit("")), F.lit("nows"))),
            "estimated": F.lit(True),
            "input_tokens": F.col("n_in"),
            "output_tokens": F.col("n_out"),
            "cache_read_tokens": F.col("n_cr"),
            "cache_write_tokens": F.col("n_cw"),
            "total_tokens": F.when(F.col("n_total") > 0, F.col("n_total")).otherwise(F.col("rt")),
            "estimated_cost": F.col("rc"),
            "request_count": F.when(F.col("rr") > 0, F.col("rr")).when(F.col("n_total") > 0, 1).otherwise(0).cast("long"),
            "source_path": F.coalesce(F.nullif("source_path", F.lit("")), F.lit("gapfill-daily")),
        }
    ).select(rollups.columns)


def collapse_router_days(rows: DataFrame) -> DataFrame:
    """Rows with each router day collapsed: rollups once for each model and workspace, and those rows of the day that ``day_choice`` says."""
    keys = ["agent", "_day"]
    dated = rows.withColumn("_day", F.when(is_router(F.col("agent")), day()))
    others, routed = dated.filter("_day is null").drop("_day"), dated.filter("_day is not null")
    rollups, calls = routed.filter(is_estimated()), routed.filter(~is_estimated())
    own = F.when(_workspace() == "", F.concat(F.lit("id:"), "id")).otherwise(F.concat(F.lit("mw:"), _name(), F.lit("|"), _workspace()))
    rollups = cut(dedupe_mixed(richest(rollups, F.col("agent"), F.col("_day"), own), keys))
    clean = rollups.unionByName(calls)  # read for the sums, the choice and the gaps; requests, which are many, from where they are
    choice = cut(day_sums(clean, keys).select(*keys, day_choice().alias("_choice")))
    chosen = clean.join(choice, keys)
    keep = F.when(is_estimated(), F.col("_choice").isin(ROLLUPS, BOTH)).otherwise(F.col("_choice").isin(REQUESTS, BOTH, FILLED))
    filled = chosen.filter(F.col("_choice") == FILLED).drop("_choice")
    gaps = day_gaps(filled.filter(is_estimated()), filled.filter(~is_estimated()), keys)
    kept = chosen.filter(keep).drop("_choice").select(gaps.columns).unionByName(gaps)
    return others.unionByName(kept.drop("_day"))


# --- at the time of reading: requests against the router's own day documents --------------------------


def prefer_requests() -> Column:
    """Whether a day's requests come before its document, from rows, req, tok (of requests) and target, day_tok, day_cost (of the document)."""
    n, req, tok, target, dt, dc = (F.col(c) for c in ("rows", "req", "tok", "target", "day_tok", "day_cost"))
    near = (dt > 0) & (tok >= dt * 0.95) & (tok <= dt * 1.08)
    return (
        F.when(n < 2, False)
        .when(near & (req >= 2) & ((target <= 0) | (req >= target * 0.75)), True)
        .when(near & (target >= 2) & (req >= target * 0.95) & (req <= target * 1.08), True)
        .when((target >= 20) & (dt >= 10_000), False)
        .when((dt > 0) & (tok > dt * 1.05), False)
        .when((target > 0) & (n > F.greatest(target * 1.5, target + 5)) & ((dt <= 0) | (tok <= dt * 1.05)), False)
        .when((target >= 1) & ((dc > 0) | (dt > 0)) & (n > target * 1.25), False)
        .otherwise((F.when(target > 0, n / target).otherwise(1.0) >= 0.15) | (F.when(dt > 0, tok / dt).otherwise(1.0) >= 0.15))
    )


def merge_days(days: DataFrame) -> DataFrame:
    """Of several documents of a day (agent, day, requests, seq, ...) the one with most requests; of equals the last."""
    whole = F.struct(*[F.col(c) for c in days.columns])
    return days.groupBy(F.col("agent").alias("_a"), F.col("day").alias("_d")).agg(F.max_by(whole, F.struct(F.coalesce("requests", F.lit(0.0)).alias("r"), F.col("seq").alias("s"))).alias("_r")).select("_r.*")


def model_rows(days: DataFrame) -> DataFrame:
    """The models of day documents: (agent, day, key, model, provider, requests, input, output, cache, cost)."""
    one = days.select("agent", "day", F.explode("models").alias("key", "m"))
    model = F.coalesce(normalize_model(F.coalesce(F.nullif("m.raw_model", F.lit("")), F.nullif(F.split_part("key", F.lit("|"), F.lit(1)), F.lit("")), "key")), F.lit("mixed"))
    z = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(0.0)).alias(c)
    return one.select("agent", "day", "key", model.alias("model"), F.col("m.provider").alias("provider"), *[z(c) for c in ("requests", "input", "output", "cache", "cost")])


def call_sums(calls: DataFrame) -> DataFrame:
    """Requests by agent, day and model as written: their last time, rows, requests and counts. Names repeat, so these are few, and names are normalised on them."""
    counts = {"h_in": "input_tokens", "h_out": "output_tokens", "h_cache": "cache_read_tokens"}
    return calls.groupBy("agent", day().alias("day"), "model").agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("rows"), F.sum(requests()).alias("h_n"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(h) for h, c in counts.items()], F.sum(cost()).alias("h_cost")
    )


def expand_days(days: DataFrame, calls: DataFrame, now: Column) -> DataFrame:
    """Rollup rows of day documents: one for each model if these cover 98 % of the day's cost and tokens, else one for the day.

    ``days``: agent, day, requests, input, output, cache, cost, models (map of
    structs), source. Ids don't depend on counts, so that a growing day replaces
    itself.
    """
    return _expand(days, call_sums(calls), now)


def _expand(days: DataFrame, summed: DataFrame, now: Column) -> DataFrame:
    latest = summed.withColumn("_m", normalize_model(F.col("model")))
    by_day = latest.groupBy("agent", "day").agg(F.max("ts").alias("day_ts"))
    by_model = latest.groupBy("agent", "day", F.col("_m").alias("model")).agg(F.max("ts").alias("model_ts"))
    models = model_rows(days).filter("input + output + cache > 0 or cost > 0 or requests > 0")
    sums = models.groupBy("agent", "day").agg(F.sum("cost").alias("m_cost"), F.sum(F.col("input") + F.col("output") + F.col("cache")).alias("m_tok"), F.count(F.lit(1)).alias("m_n"))
    base = days.drop("models").join(sums, ["agent", "day"], "left").join(by_day, ["agent", "day"], "left")
    tok = F.col("input") + F.col("output") + F.col("cache")
    covers = (F.coalesce("m_n", F.lit(0)) > 0) & ((F.col("cost") <= 0) | (F.col("m_cost") >= F.col("cost") * 0.98)) & ((tok <= 0) | (F.col("m_tok") >= tok * 0.98))
    base = base.withColumn("covers", F.coalesce(covers, F.lit(False)))
    head = base.select("agent", "day", "covers", "day_ts", "source")
    fine = models.join(head.filter("covers"), ["agent", "day"]).join(by_model, ["agent", "day", "model"], "left").withColumn("preferred", F.coalesce("model_ts", time.rollup_moment(F.col("day"), F.col("day_ts"), now)))
    fine = fine.select("agent", "day", "key", "model", "provider", "requests", "input", "output", "cache", "cost", "preferred", "source")
    whole = base.filter(~F.col("covers") & ((tok > 0) | (F.col("cost") > 0))).select("agent", "day", F.lit("all").alias("key"), F.lit("mixed").alias("model"), F.lit(None).cast("string").alias("provider"), "requests", "input", "output", "cache", "cost", F.col("day_ts").alias("preferred"), "source")
    # a model's rollup without tokens or cost says nothing
    rows = fine.unionByName(whole).filter("input + output + cache > 0 or cost > 0")
    out = rows.select(
        F.lit(None).cast("long").alias("seq"), stable_id(F.col("agent"), F.lit("daily-rollup"), F.col("day"), F.col("key")).alias("id"), "agent", "model", time.rollup_moment(F.col("day"), F.col("preferred"), now).alias("ts"),
        F.col("input").cast("long").alias("input_tokens"), F.col("output").cast("long").alias("output_tokens"), F.col("cache").cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"),
        (F.col("input") + F.col("output") + F.col("cache")).cast("long").alias("total_tokens"), F.nullif("cost", F.lit(0.0)).alias("estimated_cost"), F.lit("USD").alias("currency"), F.lit("estimated").alias("pricing_status"),
        F.concat(F.lit("provider:"), "provider").alias("workspace"), F.col("source").alias("source_path"), F.lit(True).alias("estimated"), F.greatest(F.lit(1), F.floor("requests")).cast("long").alias("request_count"),
    )
    return conform(out)


def model_deficits(days: DataFrame, calls: DataFrame) -> DataFrame:
    """Day documents of what their models have beyond the requests of that model; days without a deficit are left out."""
    return _deficits(days, call_sums(calls))


def _deficits(days: DataFrame, summed: DataFrame) -> DataFrame:
    had = summed.withColumn("model", F.coalesce(normalize_model(F.col("model")), "model")).filter("model <> ''").groupBy("agent", "day", "model")
    had = had.agg(*[F.sum(h).alias(h) for h in ("h_n", "h_in", "h_out", "h_cache", "h_cost")])
    met = model_rows(days).join(had, ["agent", "day", "model"], "left").fillna(0, ["h_n", "h_in", "h_out", "h_cache", "h_cost"])
    left = lambda c, h: F.greatest(F.lit(0.0), F.col(c) - F.col(h))
    met = met.withColumns({"r_req": left("requests", "h_n"), "r_in": left("input", "h_in"), "r_out": left("output", "h_out"), "r_cache": left("cache", "h_cache"), "r_cost": left("cost", "h_cost")})
    nothing = "r_req <= 0 and r_in + r_out + r_cache <= 0 and r_cost <= 0"
    had_all = "h_n >= requests and h_in + h_out >= input + output and r_cache <= 0 and r_cost <= 0 and requests > 0"
    met = met.filter(f"not ({nothing}) and not ({had_all})")
    n = F.when(F.col("r_req") > 0, F.col("r_req")).when(F.col("h_n") == 0, F.greatest(F.lit(1.0), F.col("requests"))).otherwise(0.0)
    entry = F.struct(n.alias("requests"), F.col("r_in").alias("input"), F.col("r_out").alias("output"), F.col("r_cache").alias("cache"), F.col("r_cost").alias("cost"), F.col("model").alias("raw_model"), "provider")
    # a day has as many entries as its document has models
    out = met.groupBy("agent", "day").agg(F.map_from_entries(F.collect_list(F.struct("key", entry.alias("m")))).alias("models"), F.sum("r_req").alias("requests"), F.sum("r_in").alias("input"), F.sum("r_out").alias("output"), F.lit(0.0).alias("cache"), F.sum("r_cost").alias("cost"))
    return out.join(days.select("agent", "day", "source", "seq"), ["agent", "day"])


def reconcile_days(calls: DataFrame, days: DataFrame, now: Column) -> DataFrame:
    """Requests and day documents (several versions) as rows: documents alone, requests alone, or requests and what they lack."""
    merged, calls = cut(merge_days(days)), cut(calls)
    summed = cut(call_sums(calls))  # one pass over the requests for all that is asked of their sums
    dated = calls.withColumn("day", day())
    sums = summed.filter("day is not null").groupBy("agent", "day").agg(F.sum("rows").alias("rows"), F.sum("h_n").alias("req"), F.sum(F.col("h_in") + F.col("h_out")).alias("tok"))
    both = merged.select("agent", "day", F.coalesce("requests", F.lit(0.0)).alias("target"), (F.col("input") + F.col("output")).alias("day_tok"), F.col("cost").alias("day_cost"))
    both = both.join(sums, ["agent", "day"], "left").fillna(0, ["rows", "req", "tok"])
    choice = both.select("agent", "day", prefer_requests().alias("prefer"))
    kept = dated.join(choice, ["agent", "day"], "left").filter(F.coalesce("prefer", F.lit(True))).select(calls.columns)
    named = merged.join(choice, ["agent", "day"])
    lacking = cut(_deficits(named.filter("prefer").drop("prefer"), summed))
    rollups = _expand(named.filter("not prefer").drop("prefer"), summed, now).unionByName(_expand(lacking, summed, now))
    return conform(kept).unionByName(rollups)


def lift_days(old: DataFrame, new: DataFrame, keys: list[str], measures: list[str], grown: tuple[str, str] = ("tokens", "cost")) -> DataFrame:
    """Rebuilt day totals over old ones: where tokens or cost grew, the greater of each measure; else the old row."""
    n = new.select(*keys, *[F.col(m).alias(f"n_{m}") for m in measures])
    met = old.join(n, keys, "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    more = F.lit(False)
    for g in grown:
        more = more | (z(f"n_{g}") > z(g))
    return met.select(*keys, *[F.when(more, F.greatest(z(m), z(f"n_{m}"))).otherwise(z(m)).alias(m) for m in measures])
