"""Configuration from environment variables."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass


def _number(value: str | None) -> float | None:
    """A finite number, an empty string being 0, or None."""
    if value is None:
        return None
    try:
        x = float(value.strip() or 0)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def _positive(value: str | None, default: float) -> float:
    x = _number(value)
    return x if x is not None and x > 0 else default


def _finite(value: str | None, default: float) -> float:
    x = _number(value)
    return default if x is None else x


def _text(value: str | None, default: str) -> str:
    return value.strip() if value and value.strip() else default


@dataclass(frozen=True)
class Config:
    port: int = 3000
    host: str = "0.0.0.0"
    llm_provider: str = "openai"
    llm_api_key: str = ""
    llm_base_url: str = "https://api.openai.com/v1"
    llm_model: str = "gpt-4o-mini"
    llm_temperature: float = 0.2
    llm_max_tokens: int = 1024
    embedding_provider: str = "local"
    embedding_model: str = "Xenova/all-MiniLM-L6-v2"
    embedding_api_model: str = "text-embedding-3-small"
    embedding_dims: int = 384
    top_k: int = 6
    threshold: float = 0.35
    keyword_weight: float = 0.3
    fusion_candidates: int = 20
    data_dir: str = "data"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        e, d = os.environ if env is None else env, cls()
        return cls(
            port=int(_positive(e.get("PORT"), d.port)), host=_text(e.get("HOST"), d.host),
            llm_provider=_text(e.get("LLM_PROVIDER"), d.llm_provider).lower(),
            llm_api_key=e.get("OPENAI_API_KEY") or e.get("GEMINI_API_KEY") or e.get("LLM_API_KEY") or "",
            llm_base_url=_text(e.get("LLM_BASE_URL"), d.llm_base_url).rstrip("/"), llm_model=_text(e.get("LLM_MODEL"), d.llm_model),
            llm_temperature=_finite(e.get("LLM_TEMPERATURE"), d.llm_temperature), llm_max_tokens=int(_positive(e.get("LLM_MAX_TOKENS"), d.llm_max_tokens)),
            embedding_provider=_text(e.get("EMBEDDING_PROVIDER"), d.embedding_provider).lower(), embedding_model=_text(e.get("EMBEDDING_MODEL"), d.embedding_model),
            embedding_api_model=_text(e.get("EMBED_MODEL"), d.embedding_api_model), embedding_dims=int(_positive(e.get("EMBED_DIMS"), d.embedding_dims)),
            top_k=int(_positive(e.get("RETRIEVAL_TOP_K"), d.top_k)), threshold=_finite(e.get("RETRIEVAL_THRESHOLD"), d.threshold),
            keyword_weight=_finite(e.get("RETRIEVAL_KEYWORD_WEIGHT"), d.keyword_weight),
            fusion_candidates=int(_positive(e.get("RETRIEVAL_FUSION_CANDIDATES"), d.fusion_candidates)), data_dir=_text(e.get("DATA_DIR"), d.data_dir),
        )
