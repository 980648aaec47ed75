"""Binary session files: encrypted trajectories, labelled numbers in them, and printable strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of counts, by family in order of trial; model names in plain bytes.
LABELS = {
    "input_tokens": ["Input tokens", "input tokens", "Prompt tokens"],
    "output_tokens": ["Output tokens", "output tokens", "Completion tokens"],
    "cache_read_tokens": ["Cached input tokens", "Cached tokens", "Cache read tokens", "cached input tokens"],
}
SLUG = r"(?i)\b(?:claude|gpt|gemini|swe|glm|kimi|deepseek|minimax|qwen|o[1-9]|cascade)[-a-z0-9]{2,40}\b"
FLOAT_MARK, FLOAT_LIMIT, FLOAT_WITHIN = 0x15, 5e7, 7


def decrypt(content: Column, key: Column) -> Column:
    """AES-GCM content (12-byte nonce, ciphertext, 16-byte tag) in plain; null if the key or the content is wrong."""
    return F.try_aes_decrypt(content, key, F.lit("GCM"))


def small_float(four: Column) -> Column:
    """The number of four little-endian bytes (as ISO-8859-1 text) read as a float, if it is from 0 to below ``FLOAT_LIMIT``; else null."""
    byte = [F.ascii(F.substr(four, F.lit(i), F.lit(1))) for i in (1, 2, 3, 4)]
    exponent = (byte[3] % 128) * 2 + F.floor(byte[2] / 128)
    fraction = (byte[0] + byte[1] * 256 + (byte[2] % 128) * 65536) / F.lit(float(1 << 23))
    size = F.when(exponent == 0, fraction * F.lit(2.0**-126)).when(exponent < 255, (1 + fraction) * F.pow(F.lit(2.0), exponent - 127))
    return F.when((size == 0) | ((byte[3] < 128) & (size < FLOAT_LIMIT)), size)


def numbers_after(content: Column, label: str) -> Column:
    """The floats behind the occurrences of a label: of each, the first that stands within a few bytes behind a mark and is in range."""
    near = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"(?s)\Q{label}\E(?=(.{{0,{FLOAT_WITHIN + 4}}}))"), F.lit(1))
    places = F.array(*[F.lit(i) for i in range(1, FLOAT_WITHIN + 1)])

    def first(text: Column) -> Column:
        whole = F.filter(places, lambda i: (F.substr(text, i, F.lit(1)) == chr(FLOAT_MARK)) & (F.length(text) >= i + 4))
        return F.get(F.filter(F.transform(whole, lambda i: small_float(F.substr(text, i + 1, F.lit(4)))), lambda v: v.isNotNull()), F.lit(0))

    return F.filter(F.transform(near, first), lambda v: v.isNotNull())


def labelled_total(content: Column, family: str) -> Column:
    """The rounded sum of the numbers after the first label of a family that has any, 0 if none has."""
    total = lambda found: F.aggregate(found, F.lit(0).cast("long"), lambda a, v: a + F.floor(v + 0.5).cast("long"))
    lists = [numbers_after(content, label) for label in LABELS[family]]
    return F.coalesce(*[F.when(F.size(x) > 0, total(x)) for x in lists], F.lit(0).cast("long"))


def strings(content: Column) -> Column:
    """Printable runs of three characters or more."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"[\x20-\x7e]{3,}"), F.lit(0))


def dominant_model(content: Column) -> Column:
    """The model name that occurs most often; of equals the first."""
    names = F.transform(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(SLUG), F.lit(0)), F.lower)
    fit = F.filter(names, lambda n: F.length(n).between(5, 36))
    ranked = F.transform(F.array_distinct(fit), lambda n, i: F.struct(F.size(F.filter(fit, lambda m: m == n)).alias("n"), (-i).alias("place"), n.alias("name")))
    return F.array_max(ranked)["name"]
