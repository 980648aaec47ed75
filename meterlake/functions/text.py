"""Text and number functions: coercion, stable ids, model and agent names, formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
HEX = r"^0[xX][0-9a-fA-F]{1,15}$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def num(c: Column) -> Column:
    """A finite number from text, else 0. Decimal and exponent forms and 0x numbers count; blanks around are ignored."""
    t = strip(c.cast("string"))
    value = F.when(t.rlike(NUMBER), t.try_cast("double")).when(t.rlike(HEX), F.conv(F.substring(t, 3, 99), 16, 10).cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(0.0))


def stable_id(*parts: Column) -> Column:
    """24 hex digits of SHA-256 over the parts joined by ``|``; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once a row, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: Names that ``normalize_model`` leaves as they are: nothing but letters, digits, points and inner dashes.
PLAIN_MODEL = r"^(?!(?i:deep-seek|digigo$))[A-Za-z0-9.](?:[A-Za-z0-9.-]*[A-Za-z0-9.])?\z"


def normalize_model(c: Column) -> Column:
    """One name for a model's variants: without connection suffixes in brackets, provider paths and trailing marks; null if nothing is left."""
    m = strip(c)
    for _ in range(3):
        m = strip(F.regexp_replace(m, r"\s*\([^)]*\)\s*$", ""))
    m = strip(F.regexp_replace(m, r"\s*\[[^\]]*\]\s*$", ""))
    m = strip(F.split_part(m, F.lit("|"), F.lit(1)))

    def of_path(m: Column) -> Column:
        last = F.try_element_at(F.filter(F.transform(F.split(m, "/"), strip), lambda p: p != ""), F.lit(-1))
        named = lambda p: (F.length(p) >= 2) & ~p.rlike(r"(?i)^(models?|v\d+)$")
        return F.when(m.contains("/") & ~m.startswith("http"), let(last, lambda p: F.when(named(p), p).otherwise(m))).otherwise(m)

    m = strip(F.regexp_replace(strip(F.regexp_replace(let(m, of_path), r"\s+", " ")), r"[-_:|]+$", ""))
    m = F.regexp_replace(m, r"(?i)^deep[-_]seek", "deepseek")
    m = let(m, lambda m: F.when(F.lower(m) == "digigo", "Digigo").when(m != "", m))
    return F.when(c.rlike(PLAIN_MODEL), c).otherwise(m)


def model_key(model: Column, agent: Column) -> Column:
    """Group key of a model: normalised and lower-cased; a missing one names its agent."""
    return F.lower(F.coalesce(normalize_model(model), F.concat(F.lit("unknown ("), agent, F.lit(")"))))


# Other names of an agent.
AGENT_ALIASES = {"xlabrouter": "routerlab", "xlrouter": "routerlab", "xlab-router": "routerlab", "xlab_router": "routerlab"}
# Names for display.
AGENT_LABELS = {
    "routerlab": "RouterLab",
    "9router": "9Router",
    "litellm": "LiteLLM",
    "claude-code": "Claude Code",
    "codex": "OpenAI Codex (App)",
    "cursor": "Cursor",
    "windsurf": "Windsurf",
    "grok": "Grok (xAI)",
    "hermes": "Hermes Agent",
    "qwencoder": "QwenCoder Cloud",
    "copilot": "GitHub Copilot",
    "devin": "Devin",
    "opencode": "OpenCode",
    "antigravity": "Antigravity",
}


def lookup(table: dict[str, str], c: Column) -> Column:
    """The table's entry for ``c``, null if there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def normalize_agent(c: Column) -> Column:
    a = F.lower(strip(c))
    return F.when(F.coalesce(a, F.lit("")) == "", "custom").otherwise(F.coalesce(lookup(AGENT_ALIASES, a), a))


def agent_label(c: Column) -> Column:
    return F.coalesce(lookup(AGENT_LABELS, normalize_agent(c)), F.nullif(c, F.lit("")), F.lit("unknown"))


# Providers by the beginning of a model's name, in order of trial; then by a part of it.
PROVIDER_PREFIXES = [
    ("claude", "anthropic"), ("gpt", "openai"), ("o1", "openai"), ("o3", "openai"), ("o4", "openai"), ("chatgpt", "openai"), ("gp-gpt", "openai"),
    ("gemini", "google"), ("grok", "x-ai"), ("deepseek", "deepseek"), ("glm", "z-ai"), ("chatglm", "z-ai"), ("kimi", "moonshotai"), ("moonshot", "moonshotai"),
    ("qwen", "qwen"), ("minimax", "minimax"), ("step-", "stepfun"), ("stepfun", "stepfun"), ("laguna", "poolside"), ("poolside", "poolside"),
    ("mistral", "mistralai"), ("mixtral", "mistralai"), ("codestral", "mistralai"), ("llama", "meta-llama"), ("meta-", "meta-llama"), ("command", "cohere"), ("cohere", "cohere"),
]


def guess_provider(c: Column) -> Column:
    """Provider of a model id: the part before a slash, else by known names."""
    raw = F.lower(strip(c))
    head = F.split_part(raw, F.lit("/"), F.lit(1))
    out = F.when(F.coalesce(raw, F.lit("")) == "", "other").when(raw.contains("/"), F.when(head == "", "other").otherwise(head))
    for prefix, provider in PROVIDER_PREFIXES:
        out = out.when(raw.startswith(prefix), provider)
    out = out.when(raw.contains("nemotron"), "nvidia").when(raw.startswith("mimo"), "xiaomi")
    out = out.when(raw.contains("windsurf") | raw.startswith("swe-") | (raw == "cascade"), "windsurf").when(raw.contains("cursor"), "cursor")
    return out.otherwise("other")


def format_usd(c: Column, digits: int = 4) -> Column:
    """$1.234,5000: points between thousands and a decimal comma."""
    v = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.concat(F.when(v < 0, "-$").otherwise("$"), F.translate(F.format_number(F.abs(v), digits), ",.", ".,"))


def format_tokens(c: Column) -> Column:
    """12.34M, 5.6K, or the plain number."""
    scaled = lambda by, digits, unit: F.format_string(f"%.{digits}f{unit}", c / F.lit(float(by)))
    return F.when(c >= 1_000_000_000, scaled(1e9, 2, "B")).when(c >= 1_000_000, scaled(1e6, 2, "M")).when(c >= 1_000, scaled(1e3, 1, "K")).otherwise(c.cast("string"))


def tokens_of_chars(chars: Column) -> Column:
    """About four characters a token, at least one for any."""
    n = F.coalesce(chars, F.lit(0)).cast("long")
    return F.when(n <= 0, 0).otherwise(F.ceil(n / F.lit(4.0))).cast("long")


def sanitize_machine(c: Column) -> Column:
    """Letters, digits, points, lines and dashes of a host's name, 64 at most."""
    t = F.regexp_replace(F.regexp_replace(strip(c), r"[^a-zA-Z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(t, 1, 64), F.lit("")), F.lit("unknown"))


# --- models named in free text -------------------------------------------------------------------

# Patterns of vendor ids; placeholders of local databases and what they stand for.
VENDOR_IDS = r"(?i)\b((?:gemini-|claude-|gpt-|kimi-|qwen)[\w.-]+)\b"
PLACEHOLDERS = {"71": "gemini-3.6-flash-high", "196": "gemini-3.6-flash-tiered"}
LABELS = [
    r"(?i)Model\s*Selection[`'\"]?\s*from\s+[^\n]{0,40}?\s+to\s+([^\n.<]{3,80})",
    r"(?i)\b(Gemini\s*3\.?\d*\s*Flash\s*\(\s*(?:High|Tiered)\s*\))",
    r"(?i)\b(Gemini\s*3\.?\d*\s*Flash\s+(?:High|Tiered))\b",
    r"(?i)\b(Gemini\s*3\.?\d*\s*(?:Flash|Pro))\b",
]


def _label_model(label: Column) -> Column:
    c = F.lower(F.regexp_replace(strip(label), r"\s+", "-"))
    has = c.contains
    return (
        F.when((has("flash") | has("gemini")) & has("high"), "gemini-3.6-flash-high")
        .when((has("gemini") | has("flash") | has("pro")) & has("tiered"), "gemini-3.6-flash-tiered")
        .when(has("flash"), "gemini-3.6-flash")
        .when(has("pro"), "gemini-3.6-pro")
        .when(has("claude") & has("sonnet"), "claude-sonnet")
        .when(has("claude") & has("opus"), "claude-opus")
    )


def model_specificity(c: Column) -> Column:
    """How much a model id says: flash tiers most, bare family names least."""
    has, starts = c.contains, c.startswith
    return (
        F.when((c == "") | (c == "gemini") | (c == "gemini-api"), 1)
        .when(has("flash-high") | has("flash_high"), 100)
        .when(has("flash-tiered") | has("flash_tiered"), 90)
        .when(has("flash"), 80)
        .when(has("pro"), 70)
        .when(starts("gemini-"), 60)
        .when(starts("claude-"), 55)
        .when(starts("gpt-") | starts("kimi-") | starts("qwen"), 50)
        .otherwise(10)
    )


def model_from_text(text: Column) -> Column:
    """The most specific model id in a text: vendor ids, placeholders and display labels; of equals the longest, then the first."""
    found = F.regexp_extract_all(text, F.lit(VENDOR_IDS), F.lit(1))
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"\bMODEL_PLACEHOLDER_M(\d+)\b"), F.lit(1)), lambda n: lookup(PLACEHOLDERS, n))
    labels = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), _label_model) for p in LABELS]
    ids = F.transform(F.concat(found, marks, *labels), lambda c: F.lower(strip(c)))
    bad = lambda c: (F.length(c) < 3) | c.rlike(r"[\\/ ]") | c.contains("placeholder") | c.contains("used_") | (c == "gemini-api")
    ranked = F.transform(F.filter(ids, lambda c: c.isNotNull() & ~bad(c)), lambda c, i: F.struct(model_specificity(c).alias("score"), F.length(c).alias("size"), (-i).alias("place"), c.alias("id")))
    return F.array_max(ranked)["id"]
