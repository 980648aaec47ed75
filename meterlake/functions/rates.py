"""Rate tables: USD for a million tokens, and other names of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RATE = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("input_rate", T.DoubleType()),
        T.StructField("output_rate", T.DoubleType()),
        T.StructField("cache_read_rate", T.DoubleType()),
        T.StructField("cache_write_rate", T.DoubleType()),
        T.StructField("long_context", T.LongType()),
    ]
)

# Public list prices. model: input, output[, cache read[, cache write[, long-context threshold]]]; - where unknown.
BUNDLED = """
claude-opus-4: 15 75 1.5 18.75
claude-opus-4.5: 5 25 0.5 6.25
claude-opus-4.6: 5 25 0.5 6.25
claude-opus-4.7: 5 25 0.5 6.25
claude-opus-4.8: 5 25 0.5 6.25
claude-opus-4-6: 5 25 0.5 6.25
claude-opus-4-6-thinking: 5 25 0.5 6.25
claude-opus-4.6-thinking: 5 25 0.5 6.25
claude-opus-4-7: 5 25 0.5 6.25
claude-opus-4-7-thinking: 5 25 0.5 6.25
claude-opus-4.7-thinking: 5 25 0.5 6.25
claude-opus-4-8: 5 25 0.5 6.25
claude-opus-4-8-medium: 5 25 0.5 6.25
claude-opus-4.8-thinking: 5 25 0.5 6.25
claude-opus-4.8-fast: 10 50 1 12.5
claude-opus-4-8-fast: 10 50 1 12.5
claude-sonnet-4: 3 15 0.3 3.75
claude-sonnet-4.5: 3 15 0.3 3.75
claude-sonnet-4.5-lite: 0.3 1.5 0.03 0.375
claude-sonnet-4.6: 3 15 0.3 3.75
claude-sonnet-4-6: 3 15 0.3 3.75
claude-sonnet-4-6-thinking: 3 15 0.3 3.75
claude-3-5-sonnet: 3 15 0.3 3.75
claude-3-5-haiku: 0.8 4 0.08 1
claude-haiku-4: 1 5 0.1 1.25
claude-haiku-4.5: 1 5 0.1 1.25
gpt-5.5: 5 30 0.5
gpt-5.5-high: 5 30 0.5
gpt-5.5-xhigh: 5 30 0.5
gpt-5.5-openai-compact: 5 30 0.5
gp-gpt-5.5: 5 30 0.5
gpt-5.4: 2.5 15 0.25
gpt-5.4-openai-compact: 2.5 15 0.25
gpt-5.4-mini: 0.75 4.5 0.075
gpt-5.4-nano: 0.2 1.25 0.02
gpt-5.3-codex: 1.75 14 0.175
gpt-5.3-codex-high: 1.75 14 0.175
gpt-5.3-codex-xhigh: 1.75 14 0.175
gpt-5.3: 1.75 14 0.175
gpt-5.3-openai-compact: 1.75 14 0.175
gpt-5.2: 1.75 14 0.175
gpt-5.2-openai-compact: 1.75 14 0.175
gpt-5.1-openai-compact: 1.25 10 0.125
gpt-4.1: 2 8 0.5
gpt-4.1-mini: 0.4 1.6 0.1
gpt-4o: 2.5 10 1.25
gpt-4o-mini: 0.15 0.6 0.075
o3: 2 8 0.5
o3-pro: 20 80
o4-mini: 1.1 4.4 0.275
gemini-2.5-pro: 1.25 10 0.125
gemini-2.5-flash: 0.3 2.5 0.03
gemini-2.0-flash: 0.1 0.4 0.025
grok-4.5: 2 6 0.3 - 200000
grok-4.5-build: 2 6 0.3 - 200000
grok-4.3: 1.25 2.5 0.2 - 200000
grok-4: 3 15 0.75
grok-4-fast: 0.2 0.5 0.05
grok-4-fast-reasoning: 0.2 0.5 0.05
grok-3: 3 15 0.75
grok-3-mini: 0.3 0.5 0.075
grok-build: 1 2 0.2 - 200000
grok-build-0.1: 1 2 0.2 - 200000
grok-code-fast-1: 1 2 0.2
grok-code-fast: 1 2 0.2
deepseek-v3: 0.27 1.1
deepseek-v3.2: 0.28 0.42
deepseek-v4-flash: 0.14 0.28 0.0028
deepseek-v4-pro: 0.435 0.87 0.003625
deepseek-chat: 0.14 0.28 0.0028
deepseek-reasoner: 0.14 0.28 0.0028
glm-5: 1 3.2 0.2
glm-5.0: 1 3.2 0.2
glm-5.1: 1.4 4.4 0.26
glm-5.2: 1.4 4.4 0.26
glm-5-2: 1.4 4.4 0.26
glm-4.5: 0.6 2.2
minimax-m3: 0.3 1.2 0.06
minimax-m2.7: 0.3 1.2 0.06
kimi-k2-7: 0.6 2.5
kimi-k2.6: 0.66 3.41
kimi-k2.5: 0.375 2.025
kimi-k3: 0.6 2.5 0.06
kimi-k3.0: 0.6 2.5 0.06
xlab: 0.6 2.5 0.06
vip-kimi: 0.6 2.5 0.06
qwen3.7-max: 0.8 3.2 0.08
qwen3.8-max-preview: 0.8 3.2 0.08
qwen3-coder-next: 0.18 0.9 0.036
qwen3-coder: 0.22 1.8
step-3.7-flash: 0.2 1.15 0.04
step-3.5-flash: 0.1 0.3
laguna-s-2.1: 0.1 0.2 0.01
laguna-xs-2.1: 0.06 0.12 0.03
cursor-small: 0.2 0.8
mimo-auto: 0.2 0.8
swe-1-6: 0.5 2
swe-1-7: 0.5 2
windsurf-cascade: 1 4
adaptive: 1 4
big-pickle: 0 0
nemotron-3-ultra-free: 0 0
digigo: 0 0
default: 3 15 0.3 3.75
"""

# Other names of models.
ALIASES = {
    "claude-sonnet-4-20250514": "claude-sonnet-4",
    "claude-3-5-sonnet-20241022": "claude-3-5-sonnet",
    "claude-3-5-haiku-20241022": "claude-3-5-haiku",
    "claude-sonnet-4-5": "claude-sonnet-4.5",
    "claude-sonnet-4-5-lite": "claude-sonnet-4.5-lite",
    "gpt-4.1-2025-04-14": "gpt-4.1",
    "chatgpt-4o-latest": "gpt-4o",
    "grok-4-latest": "grok-4",
    "grok-code-fast-1-0825": "grok-code-fast-1",
    "qwen-qwen3-coder-next": "qwen3-coder-next",
    "composer": "default",
    "deep-seek-v4-flash": "deepseek-v4-flash",
    "deep-seek-v4-pro": "deepseek-v4-pro",
    "deepseek-v3-2": "deepseek-v3.2",
    "glm-5-1": "glm-5.1",
    "minimax-m2-7": "minimax-m2.7",
    "step-3-7-flash": "step-3.7-flash",
    "step-3-5-flash": "step-3.5-flash",
    "laguna-s-2-1": "laguna-s-2.1",
    "laguna-xs-2-1": "laguna-xs-2.1",
}

# For names without an entry, the parts that tell their family, in order of trial, and the entry that it takes.
FAMILIES = [
    (["claude", "sonnet", "lite"], "claude-sonnet-4.5-lite"),
    (["claude", "sonnet"], "claude-sonnet-4"),
    (["claude", "opus"], "claude-opus-4"),
    (["claude", "haiku"], "claude-3-5-haiku"),
    (["gpt-5.5"], "gpt-5.5"),
    (["gpt-5.4"], "gpt-5.4"),
    (["gpt-5.3", "codex"], "gpt-5.3-codex"),
    (["gpt-5.3"], "gpt-5.3"),
    (["gpt-4o-mini"], "gpt-4o-mini"),
    (["gpt-4o"], "gpt-4o"),
    (["gpt-4.1"], "gpt-4.1"),
    (["deepseek", "flash"], "deepseek-v4-flash"),
    (["deep-seek", "flash"], "deepseek-v4-flash"),
    (["deepseek", "pro"], "deepseek-v4-pro"),
    (["deep-seek", "pro"], "deepseek-v4-pro"),
    (["deepseek", "v3"], "deepseek-v3.2"),
    (["deep-seek", "v3"], "deepseek-v3.2"),
    (["deepseek"], "deepseek-v3"),
    (["deep-seek"], "deepseek-v3"),
    (["gemini", "flash"], "gemini-2.5-flash"),
    (["gemini"], "gemini-2.5-pro"),
    (["grok", "fast"], "grok-4-fast"),
    (["grok-4.5-build"], "grok-4.5-build"),
    (["grok-4.5"], "grok-4.5"),
    (["grok-build"], "grok-build"),
    (["grok"], "grok-4.5"),
    (["glm"], "glm-5.1"),
    (["minimax"], "minimax-m3"),
    (["qwen3-coder-next"], "qwen3-coder-next"),
    (["qwen3_coder_next"], "qwen3-coder-next"),
    (["step-3.7"], "step-3.7-flash"),
    (["step-3-7"], "step-3.7-flash"),
    (["laguna-s"], "laguna-s-2.1"),
    (["laguna-xs"], "laguna-xs-2.1"),
]


def parse(text: str = BUNDLED) -> list[tuple]:
    rows = []
    for i, line in enumerate(text.strip().splitlines()):
        key, _, rest = line.partition(": ")
        v = [None if x == "-" else float(x) for x in rest.split()]
        v += [None] * (5 - len(v))
        rows.append((i, key, *v[:4], int(v[4]) if v[4] is not None else None))
    return rows


def rates(spark: SparkSession, custom: dict[str, tuple] | None = None) -> DataFrame:
    """The bundled rates, or custom ones: key -> (input, output, cache read, cache write, long-context threshold), later ones optional."""
    if custom is None:
        return spark.createDataFrame(parse(), RATE)
    rows = [(i, k.strip().lower(), *[None if x is None else float(x) for x in (*v, None, None, None)[:4]], v[4] if len(v) > 4 else None) for i, (k, v) in enumerate(custom.items())]
    return spark.createDataFrame(rows, RATE)
