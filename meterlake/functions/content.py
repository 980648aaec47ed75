"""Message contents of any JSON shape, models and workspaces that logs name indirectly, and estimates from sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, tokens_of_chars
from .time import start_of_day
from .usage import get, is_object, kind_of

# Names that a gateway gives instead of a model.
GATEWAY_ALIASES = ["xlab", "hermes", "default", "auto", "custom"]


def _is(v: Column, kind: str, path: str | None = None) -> Column:
    return F.coalesce(kind_of(v, path).startswith(kind), F.lit(False))


def _whole(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _parts(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def message_text(v: Column) -> Column:
    """A message's text: a string, an object's ``text``, or those of an array's elements joined; else empty."""
    one = lambda x: F.coalesce(F.when(_is(x, "STRING"), _whole(x)).when(_is(x, "STRING", "text"), get(x, "text")), F.lit(""))
    return F.when(_is(v, "ARRAY"), F.array_join(F.transform(_parts(v), one), "")).otherwise(one(v))


def message_chars(v: Column) -> Column:
    """Characters of a message: of strings, and of ``text``, ``input_text`` or ``content`` of objects, an array's elements summed; other values as they are written."""
    named = lambda x: F.length(F.coalesce(*[get(x, n) for n in ("text", "input_text", "content")], F.lit("")))
    part = lambda x: F.when(_is(x, "STRING"), F.length(_whole(x))).when(is_object(x), named(x)).otherwise(0)
    total = F.aggregate(F.transform(_parts(v), part), F.lit(0), lambda a, b: a + b)
    return F.coalesce(F.when(_is(v, "ARRAY"), total).when(is_object(v), named(v)).otherwise(F.length(_whole(v))), F.lit(0)).cast("long")


def render(v: Column, depth: int = 6) -> Column:
    """Any JSON value as text: scalars as written, arrays line by line, objects by their ``text`` or ``content``, else as JSON with sorted keys.

    Arrays nested deeper than ``depth`` stay JSON.
    """
    scalar = F.when(_is(v, "STRING", "text"), get(v, "text")).when(_is(v, "STRING", "content"), get(v, "content")).when(is_object(v), F.to_json(v)).otherwise(_whole(v))
    if depth == 0:
        return F.coalesce(scalar, F.lit(""))
    lines = F.array_join(F.transform(_parts(v), lambda x: render(x, depth - 1)), "\n")
    return F.coalesce(F.when(_is(v, "ARRAY"), lines).otherwise(scalar), F.lit(""))


def pick_model(model: Column, resolved: Column) -> Column:
    """The resolved name if it looks like an id (a point, slash or dash, or over eight characters), else the given one, else the resolved one."""
    m, r = (F.nullif(strip(c), F.lit("")) for c in (model, resolved))
    return F.coalesce(F.when(r.rlike("[./-]") | (F.length(r) > 8), r), m, r)


def concrete_model(model: Column, config: Column) -> Column:
    """A model's name; the configured one (``model`` of a JSON object) where there is none or only a gateway's alias."""
    c = F.try_parse_json(config)
    named = F.when(_is(c, "STRING", "model"), F.nullif(get(c, "model"), F.lit("")))
    m = F.nullif(strip(model), F.lit(""))
    return F.when(m.isNull() | F.lower(m).isin(GATEWAY_ALIASES), F.coalesce(named, m)).otherwise(m)


def workspace_of(folder: Column) -> Column:
    """The workspace that a session folder's parent names percent-encoded; null if that is no path."""
    parent = F.nullif(F.regexp_extract(folder, r"([^/\\]+)[/\\][^/\\]+[/\\]*$", 1), F.lit(""))
    decoded = F.try_url_decode(F.replace(parent, F.lit("+"), F.lit("%2B")))
    return F.when((parent != "sessions") & decoded.rlike(r":|^[/\\]"), decoded)


def conversation_estimate(payload_bytes: Column, generated_bytes: Column, generations: Column, steps: Column) -> dict[str, Column]:
    """Tokens and requests of a stored conversation from its sizes; a conversation without generations and steps has none."""
    some = generations + steps > 0
    output = tokens_of_chars(F.greatest(generated_bytes, F.floor(payload_bytes * 0.25)))
    count = F.when(generations > 0, generations).otherwise(F.ceil(steps / 4))
    return {
        "input_tokens": F.when(some, tokens_of_chars(F.greatest(payload_bytes, generated_bytes))).otherwise(0).cast("long"),
        "output_tokens": F.when(some, output).otherwise(0).cast("long"),
        "request_count": F.when(some, F.greatest(F.lit(1), count)).otherwise(0).cast("long"),
    }


def done_today(last: Column, now: Column, tz: str = "UTC") -> Column:
    """Whether ``last`` is on the day of ``now`` in a zone, or later."""
    return F.coalesce(last >= start_of_day(now, tz), F.lit(False))
