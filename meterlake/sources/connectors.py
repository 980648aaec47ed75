"""All agents whose logs can be read: where they keep them and what their files are called."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schema import conform, empty
from . import generic

JSON = r".*\.jsonl?$"


@dataclass(frozen=True)
class Connector:
    """``folders`` are relative to a home; ``name`` is a pattern over the path below a folder; ``kind`` says which reader is used."""

    agent: str
    folders: tuple[str, ...]
    name: str = JSON
    kind: str = "generic"


def _c(agent: str, folders: str, names: str = "", kind: str = "generic") -> Connector:
    """``names``: parts that a file's name may hold instead of ending in .json or .jsonl."""
    more = "".join(rf"|.*{n}[^/]*$" if not n.endswith("/") else rf"|(?:.*/)?{n}.*" for n in names.split())
    return Connector(agent, tuple(folders.split()), JSON + more, kind)


# Agents, their folders, and parts of names of their files.
CONNECTORS = [
    _c("claude-code", ".claude .config/claude", kind="claude"),
    _c("codex", ".codex", kind="rollout"),
    _c("cursor", ".cursor"),
    _c("windsurf", ".codeium/windsurf", kind="cascade"),
    _c("grok", ".grok", kind="updates"),
    _c("gemini", ".gemini", kind="gemini"),
    _c("opencode", ".opencode .local/share/opencode"),
    _c("hermes", ".hermes", kind="sessions"),
    _c("openclaw", ".openclaw", kind="carried"),
    _c("qwencoder", ".qwencoder", kind="dashboard"),
    _c("antigravity", ".gemini/antigravity", kind="transcripts"),
    _c("devin", ".devin", kind="devin"),
    _c("9router", ".9router", kind="router"),
    _c("routerlab", ".routerlab .xlabrouter", kind="router"),
    _c("litellm", ".litellm", kind="router"),
    _c("aider", ".aider .config/aider .local/share/aider", "usage analytics history"),
    _c("amazon-q", ".aws/amazonq .amazonq", "usage chat session"),
    _c("amp", ".amp .cache/amp .local/share/amp"),
    _c("blackbox", ".blackboxai .blackbox", "usage chat"),
    _c("cline", ".cline", "api_req"),
    _c("codebuddy", ".codebuddy .local/share/codebuddy", "usage"),
    _c("codebuff", ".config/manicode .codebuff", "usage"),
    _c("codewhale", ".codewhale .deepseek", "session usage"),
    _c("commandcode", ".commandcode"),
    _c("continue", ".continue .config/continue", "usage token sessions/ dev_data/"),
    Connector("copilot", (".copilot",), r".*\.jsonl$|.*usage[^/]*$|.*transcript[^/]*$|(?:.*/)?otel/.*"),
    _c("crush", ".crush .local/share/crush"),
    _c("droid", ".factory"),
    _c("forge", ".forge", "session usage"),
    _c("gjc", ".gjc", "sessions/"),
    _c("goose", ".config/goose .local/share/goose"),
    _c("iflow", ".iflow", "usage session"),
    _c("jcode", ".jcode", "journal session_"),
    _c("junie", ".junie", "usage"),
    _c("kilocode", ".local/share/kilo"),
    Connector("kimi", (".kimi", ".kimi-code"), r".*\.jsonl$|.*usage[^/]*$"),
    _c("kiro", ".kiro .local/share/kiro-cli", "sessions/ kiro"),
    _c("mimocode", ".mimocode .mimo", "session usage"),
    _c("mux", ".mux", "sessions/"),
    _c("ollama", ".ollama", "history usage"),
    _c("opencodereview", ".opencodereview .open-code-review", "review usage session"),
    Connector("pi", (".pi", ".omp"), r".*\.jsonl$|(?:.*/)?sessions/.*\.json$"),
    _c("qoder", ".qoder", "usage session"),
    _c("qwen", ".qwen"),
    _c("roocode", ".config/Code/User/globalStorage/rooveterinaryinc.roo-cline"),
    _c("trae", ".trae"),
    _c("void", ".void .void-editor", "usage"),
    _c("warp", ".warp .local/share/warp"),
    _c("workbuddy", ".workbuddy", "usage"),
    _c("zcode", ".zcode", "session usage history"),
    _c("zed", ".zed .config/zed .local/share/zed"),
]
BY_AGENT = {c.agent: c for c in CONNECTORS}


def roots_of(connector: Connector, homes: list[str]) -> list[str]:
    return [f"{h.rstrip('/')}/{f}" for h in homes for f in connector.folders]


def _proxies(homes: list[str]) -> list[str]:
    """Where routers keep their request histories: beside the agents' own folders."""
    return [f"{h.rstrip('/')}/{f}" for h in homes for f in (".litellm", ".9router", ".tokenlab/mirrors/litellm", ".tokenlab/mirrors/9router")]


def read_agent(spark: SparkSession, agent: str, homes: list[str], **options) -> DataFrame:
    """Usage rows of one agent below some homes (local folders or a copy of them in any store)."""
    from . import dashboards, rollouts, routers, sessions, streams, transcripts

    c = BY_AGENT[agent]
    readers = {
        "generic": lambda roots: generic.read_usage(spark, roots, agent, c.name),
        "claude": lambda roots: transcripts.read_claude(spark, roots),
        "carried": lambda roots: transcripts.read_carried(spark, roots, agent),
        "gemini": lambda roots: transcripts.read_gemini(spark, roots),
        "rollout": lambda roots: rollouts.read_rollouts(spark, roots, **({"proxies": _proxies(homes)} | options)),
        "updates": lambda roots: streams.read_updates(spark, roots),
        "transcripts": lambda roots: transcripts.read_steps(spark, roots),
        "cascade": lambda roots: sessions.read_cascade(spark, roots, **options),
        "sessions": lambda roots: sessions.read_sessions(spark, roots),
        "devin": lambda roots: sessions.read_message_nodes(spark, roots),
        "dashboard": lambda roots: dashboards.read_dashboards(spark, roots),
        "router": lambda roots: routers.read_router(spark, roots, agent, **options),
    }
    return conform(readers[c.kind](roots_of(c, homes)))


def read_all(spark: SparkSession, homes: list[str], agents: list[str] | None = None, **options) -> DataFrame:
    """Usage rows of all agents, or of the named ones. ``seq`` follows the order of agents, files and lines."""
    out = empty(spark)
    for c in CONNECTORS:
        if agents is None or c.agent in agents:
            out = out.unionByName(read_agent(spark, c.agent, homes, **(options if c.kind in ("cascade", "router") else {})))
    return out


def agents_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.agent, list(c.folders), c.kind) for c in CONNECTORS], "agent string, folders array<string>, kind string")
