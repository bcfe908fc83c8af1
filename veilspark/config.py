"""Tunables in one frozen object (window sizes, limits, scopes, dialect)."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.patterns import (
    CONTEXT_WINDOW,
    GRAPH_PROXIMITY_WINDOW,
    MESSAGE_MAX_LEN,
    PatternRegistry,
)


@dataclass(frozen=True)
class VeilConfig:
    # span detection
    registry: PatternRegistry = field(default_factory=PatternRegistry.default)
    unicode_regex: bool = True          # Python-like \b \d \w \s (Java (?U))
    context_window: int = CONTEXT_WINDOW
    # message agent
    max_message_len: int = MESSAGE_MAX_LEN
    oversize: str = "scan"              # scan (read every text) | clean (fail open) | block
    unicode_email_fallback: bool = False
    # proximity analysis
    proximity_window: int = 100
    # graph
    graph_window: int = GRAPH_PROXIMITY_WINDOW
    min_edge_weight: float = 0.1

    def with_registry(self, registry: PatternRegistry) -> "VeilConfig":
        from dataclasses import replace

        return replace(self, registry=registry)


DEFAULT = VeilConfig()
