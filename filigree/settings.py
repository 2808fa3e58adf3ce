"""Tunables of the engine, with environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Labels of document sections (fixed values).
SECTIONS = ["business", "risk_factors", "legal", "mdna", "market_risk", "financials", "controls", "other"]
#: Period types a plan may ask for (fixed values; Q4 reports exist and are accepted too).
PERIODS = ["FY", "Q1", "Q2", "Q3", "Q4"]


@dataclass(frozen=True)
class Settings:
    chunk_tokens: int = 800
    chunk_overlap: int = 100
    least_tokens: int = 30
    embed_provider: str = "offline"
    embed_model: str = ""
    embed_query_prefix: str = ""
    embed_doc_prefix: str = ""
    embed_max_tokens: int = 1024
    embed_dim: int = 768
    embed_batch: int = 64
    top_k: int = 20
    rrf_k: int = 60
    per_ticker: int = 5
    rerank: bool = False
    answer_mode: str = "single"
    llm_provider: str = "offline"
    llm_model: str = ""
    judge_provider: str = ""
    judge_model: str = ""
    llm_timeout: float = 60.0
    llm_cache: bool = True
    llm_cache_dir: str = "cache"
    fallback_models: tuple[str, ...] = field(default_factory=tuple)
    fiscal_tolerance_days: int = 10
    days_per_quarter: float = 91.3

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, dotenv: str | None = None) -> Settings:
        """Defaults, then a .env file (KEY=value lines), then the environment; names are field names in capitals."""
        found: dict[str, str] = {}
        if dotenv and Path(dotenv).exists():
            for line in Path(dotenv).read_text().splitlines():
                key, eq, value = line.partition("=")
                if eq and not key.strip().startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
        found |= os.environ if env is None else env
        out = {}
        for f in fields(cls):
            raw = found.get(f.name.upper())
            if raw is None or raw == "":
                continue
            kind = type(getattr(cls(), f.name))
            out[f.name] = raw in ("1", "true", "True") if kind is bool else tuple(x for x in raw.split(",") if x) if kind is tuple else kind(raw)
        return cls(**out)
