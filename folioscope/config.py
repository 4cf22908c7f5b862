"""Configuration: a YAML file, overridden by the environment."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from folioscope import constants as C


@dataclass(frozen=True)
class ModelConfig:
    """Settings of one model role; every role has its own."""

    model: str = C.ANSWER_MODEL
    temperature: float | None = None
    max_tokens: int | None = None


@dataclass(frozen=True)
class Config:
    collection: str = C.DEFAULT_COLLECTION
    summary: ModelConfig = field(
        default_factory=lambda: ModelConfig(
            temperature=C.SUMMARY_TEMPERATURE, max_tokens=C.SUMMARY_MAX_TOKENS
        )
    )
    answer: ModelConfig = field(default_factory=lambda: ModelConfig(temperature=C.ANSWER_TEMPERATURE))
    judge: ModelConfig = field(
        default_factory=lambda: ModelConfig(temperature=C.JUDGE_TEMPERATURE, max_tokens=C.JUDGE_MAX_TOKENS)
    )


def load_config(path: str | None = "config.yaml", env: Mapping[str, str] | None = None) -> Config:
    """Read ``path`` (if given) and let ``COLLECTION_NAME`` override the collection.

    The model section may have any name: it is the one that holds
    ``summarization_model``.
    """
    env = os.environ if env is None else env
    document: dict = {}
    if path is not None:
        import yaml

        with open(path, encoding="utf-8") as handle:
            document = yaml.safe_load(handle) or {}
    base = Config()
    section = next(
        (v for v in document.values() if isinstance(v, dict) and "summarization_model" in v), {}
    )
    summary = ModelConfig(
        model=section.get("summarization_model", base.summary.model),
        temperature=section.get("temperature", base.summary.temperature),
        max_tokens=section.get("max_tokens", base.summary.max_tokens),
    )
    collection = env.get("COLLECTION_NAME", document.get("collection", base.collection))
    return Config(collection=collection, summary=summary, answer=base.answer, judge=base.judge)


def require_env(names: Iterable[str], env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Return the named variables, or fail before any job starts if one is unset or empty."""
    env = os.environ if env is None else env
    names = list(names)
    if not all(env.get(name) for name in names):
        raise ValueError("Missing required environment variables: " + ", ".join(names))
    return {name: env[name] for name in names}
