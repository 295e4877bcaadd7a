"""Settings from the environment, strategies and prompts."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace
from typing import NamedTuple

from ..functions.ids import hash_of, sha256_hex

# What a strategy may be and its defaults; they enter the hash that identifies a configuration.
STRATEGIES = ("S0", "S1", "S3", "S4")
PROVIDERS = ("gemini", "anthropic")
EFFORTS = ("low", "medium", "high", "xhigh", "max")
DEFAULT_MODELS = {"gemini": "gemini-flash-latest", "anthropic": "claude-opus-5-5"}
MAX_DEPTH = 5


@dataclass(frozen=True)
class Strategy:
    """Everything that determines a review besides the change itself."""

    strategy: str
    provider: str = "gemini"
    model: str = DEFAULT_MODELS["gemini"]
    effort: str = "high"
    prompt_version: str = "review/v2"
    context_token_budget: int = 16_000
    max_output_tokens: int = 16_000
    max_comments: int = 10
    graph_depth: int = 0
    max_symbol_tokens: int = 1_500
    refusal_fallback: bool = False

    def __post_init__(self) -> None:
        problems = []
        for value, allowed, name in ((self.strategy, STRATEGIES, "strategy"), (self.provider, PROVIDERS, "provider"), (self.effort, EFFORTS, "effort")):
            if value not in allowed:
                problems.append(f"{name} must be one of {', '.join(allowed)}")
        if not self.model:
            problems.append("model must not be empty")
        if not re.fullmatch(r"[a-z-]+/v[0-9]+", self.prompt_version):
            problems.append("prompt_version must look like name/v1")
        for name in ("context_token_budget", "max_output_tokens", "max_comments", "max_symbol_tokens"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) <= 0:
                problems.append(f"{name} must be a positive integer")
        if not 0 <= self.graph_depth <= MAX_DEPTH:
            problems.append(f"graph_depth must be from 0 to {MAX_DEPTH}")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def uses_graph(self) -> bool:
        return self.strategy in ("S3", "S4")

    @property
    def depths(self) -> tuple[int, int]:
        """Hops to callees and to callers."""
        return (1, 0) if self.strategy == "S3" else (self.graph_depth, self.graph_depth)

    def fields(self) -> dict:
        """The fields under the names by which they are hashed and stored."""
        return {re.sub(r"_([a-z])", lambda m: m[1].upper(), k): v for k, v in asdict(self).items()}

    @property
    def hash(self) -> str:
        return hash_of(self.fields())


PRESETS = {"S0": Strategy("S0"), "S1": Strategy("S1"), "S3": Strategy("S3", graph_depth=1), "S4": Strategy("S4", graph_depth=2)}


def preset(strategy: str, provider: str | None = None, model: str | None = None) -> Strategy:
    """A strategy's defaults, for another provider or model if wanted."""
    if strategy not in PRESETS:
        raise ValueError(f"unknown strategy {strategy}; expected one of {', '.join(STRATEGIES)}")
    provider = provider or PRESETS[strategy].provider
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}")
    return replace(PRESETS[strategy], provider=provider, model=model or DEFAULT_MODELS[provider], refusal_fallback=provider == "anthropic")


def settings(required: Mapping[str, type], source: Mapping[str, str] | None = None) -> dict:
    """Settings by name and type; everything that is missing or malformed is reported at once."""
    source = os.environ if source is None else source
    out, problems = {}, []
    for name, kind in required.items():
        value = source.get(name)
        if value is None or value == "":
            problems.append(f"{name}: required")
            continue
        try:
            out[name] = kind(value)
        except ValueError:
            problems.append(f"{name}: expected {kind.__name__}")
    if problems:
        raise ValueError("invalid environment:\n" + "\n".join(f"  {p}" for p in problems))
    return out


class Prompt(NamedTuple):
    version: str
    content_hash: str
    system: str
    user: str


def load_prompt(folder: str, version: str) -> Prompt:
    """The two texts of a version, ends trimmed and line ends made equal, with a hash of both."""
    if not re.fullmatch(r"[a-z-]+/v[0-9]+", version):
        raise ValueError(f"invalid prompt version: {version}")
    texts = []
    for name in ("system.md", "user.md"):
        with open(os.path.join(folder, version, name), encoding="utf-8", newline="") as f:
            texts.append(f.read().replace("\r\n", "\n").strip())
    return Prompt(version, sha256_hex("\0".join(texts))[:12], *texts)
