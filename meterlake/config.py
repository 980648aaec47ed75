"""Settings as one JSON document, with defaults for whatever it leaves out."""

from __future__ import annotations

import json
from math import isfinite
from pathlib import Path

DEFAULTS = {"timezone": "UTC", "agents": {}, "pricing": {"customRates": {}}, "backup": {}}


def merge(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, sections and custom rates key by key."""
    out = {**base, **over}
    for section in ("agents", "pricing", "backup"):
        out[section] = {**(base.get(section) or {}), **(over.get(section) or {})}
    out["pricing"]["customRates"] = {**((base.get("pricing") or {}).get("customRates") or {}), **((over.get("pricing") or {}).get("customRates") or {})}
    return out


def load(path: str) -> dict:
    """The settings; the defaults if there are none or they can't be read."""
    try:
        found = json.loads(Path(path).read_text("utf8"))
    except (OSError, ValueError):
        found = {}
    return merge(DEFAULTS, found if isinstance(found, dict) else {})


def save(path: str, settings: dict) -> dict:
    whole = merge(DEFAULTS, settings)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staging = target.with_name(f"{target.name}.new")
    staging.write_text(json.dumps(whole, indent=2), "utf8")
    staging.replace(target)
    return whole


def valid_rates(rates: dict) -> dict:
    """Custom rates that have a name and numbers for input and output."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and isfinite(x)
    return {k: v for k, v in rates.items() if k.strip() and isinstance(v, dict) and number(v.get("inputPer1M")) and number(v.get("outputPer1M"))}


def set_custom_rates(path: str, rates: dict, replace: bool = False) -> dict:
    settings = load(path)
    settings["pricing"]["customRates"] = valid_rates({**({} if replace else settings["pricing"]["customRates"]), **rates})
    return save(path, settings)


def rate_tuples(settings: dict) -> dict[str, tuple]:
    """Custom rates as ``functions.rates.rates`` takes them."""
    names = ("inputPer1M", "outputPer1M", "cacheReadPer1M", "cacheWritePer1M")
    return {k: tuple(v.get(n) for n in names) for k, v in valid_rates(settings["pricing"]["customRates"]).items()}
