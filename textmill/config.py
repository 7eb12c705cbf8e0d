"""Engine settings: read from a mapping of strings, checked together, frozen."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from urllib.parse import urlsplit

TYPES = ("dialogue", "document", "log")
FORMATS = ("txt", "md", "csv", "xml", "json", "pdf")
DISCARD_REASONS = ("blank", "separator", "heartbeat", "duplicate")

#: The floor's default patterns, in RE2 syntax.
SEPARATOR_PATTERN = r"^\s*(?:-{3,}|={3,}|_{3,}|\*{3,}|~{3,}|#{3,}|\+{3,})\s*$"
HEARTBEAT_PATTERN = r"(?i)^\s*(?:ping|pong|ping\s+\S+\s+\(\S+\).*|\d+\s+bytes\s+from\s+.*\bicmp_seq=\d+.*|.*\bheartbeat\b.*\b(?:ok|alive|healthy)\s*)$"
HEARTBEAT_EXCLUDE_PATTERN = r"(?i)\b(?:error|fail|failed|failure|miss|missed|missing|timeout|timed\s+out|lost|unreachable|not|down|critical|fatal|warn|warning)\b"


class ConfigError(ValueError):
    """Names every bad key at once."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class EngineConfig:
    chunk_max_bytes: int = 1024
    strong_threshold: float = 0.30
    embed_provider: str = "openai"
    embed_url: str = "http://127.0.0.1:8086/v1/embeddings"
    embed_model: str = "all-MiniLM-L6-v2"
    embed_api_key: str = ""
    embed_dim: int = 384
    embed_timeout_ms: int = 10000
    embed_batch_size: int = 32
    floor_separator_pattern: str = SEPARATOR_PATTERN
    floor_heartbeat_pattern: str = HEARTBEAT_PATTERN
    floor_heartbeat_exclude_pattern: str = HEARTBEAT_EXCLUDE_PATTERN
    floor_heartbeat_types: frozenset[str] = frozenset({"log"})
    floor_dedup_types: frozenset[str] = frozenset(TYPES)
    capacity_mb: int = 64
    max_body_bytes: int = 16 << 20
    drain_max_default: int = 256
    drain_max_limit: int = 4096
    backpressure_retry_after_s: int = 5
    filter_threshold: float = 0.75
    push_url: str = ""
    push_api_key: str = ""
    push_batch: int = 256
    push_interval_ms: int = 1000
    push_max_backoff_ms: int = 30000
    push_timeout_ms: int = 10000
    push_max_body_bytes: int = 8 << 20

    @property
    def capacity_bytes(self) -> int:
        return self.capacity_mb << 20

    @classmethod
    def load(cls, values: Mapping[str, str], prefix: str = "") -> EngineConfig:
        """values: KEY -> text. A blank value counts as unset, except for the two type sets, where it means none."""
        problems: list[str] = []
        found: dict[str, object] = {}
        for f in fields(cls):
            key = prefix + f.name.upper()
            raw = values.get(key)
            if raw is None or (not raw.strip() and f.name not in _TYPE_SETS):
                continue
            try:
                found[f.name] = _READERS.get(f.name, _text)(raw.strip())
            except ValueError as e:
                problems.append(f"{key}={raw!r}: {e}")
        out = cls(**found)
        if out.drain_max_default > out.drain_max_limit:
            problems.append(f"{prefix}DRAIN_MAX_DEFAULT: must not exceed {prefix}DRAIN_MAX_LIMIT")
        if out.push_max_backoff_ms < out.push_interval_ms:
            problems.append(f"{prefix}PUSH_MAX_BACKOFF_MS: must be at least {prefix}PUSH_INTERVAL_MS")
        if problems:
            raise ConfigError(problems)
        return out


def _text(raw: str) -> str:
    return raw


def _integer(least: int) -> Callable[[str], int]:
    def read(raw: str) -> int:
        if not re.fullmatch(r"[+-]?[0-9]+", raw) or int(raw) < least:
            raise ValueError(f"must be an integer >= {least}")
        return int(raw)

    return read


def _number(least: float, most: float) -> Callable[[str], float]:
    def read(raw: str) -> float:
        try:
            x = float(raw)
        except ValueError:
            x = float("nan")
        if not least <= x <= most:
            raise ValueError(f"must be a number in [{least:g}, {most:g}]")
        return x

    return read


def _pattern(raw: str) -> str:
    try:
        re.compile(raw)
    except re.error as e:
        raise ValueError(f"invalid regular expression: {e}") from None
    return raw


def _types(raw: str) -> frozenset[str]:
    names = frozenset(x.strip() for x in raw.split(",") if x.strip())
    if odd := sorted(names - set(TYPES)):
        raise ValueError(f"unknown type {', '.join(odd)} (want dialogue, document or log)")
    return names


def _provider(raw: str) -> str:
    if raw not in ("openai", "none"):
        raise ValueError("must be openai or none")
    return raw


def _url(raw: str) -> str:
    parts = urlsplit(raw)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError("must be an http(s) URL with a host")
    return raw


_TYPE_SETS = {"floor_heartbeat_types", "floor_dedup_types"}
_READERS: dict[str, Callable[[str], object]] = {
    "chunk_max_bytes": _integer(64),
    "strong_threshold": _number(-1, 1),
    "embed_provider": _provider,
    "embed_url": _url,
    "embed_dim": _integer(1),
    "embed_timeout_ms": _integer(1),
    "embed_batch_size": _integer(1),
    "floor_separator_pattern": _pattern,
    "floor_heartbeat_pattern": _pattern,
    "floor_heartbeat_exclude_pattern": _pattern,
    "floor_heartbeat_types": _types,
    "floor_dedup_types": _types,
    "capacity_mb": _integer(1),
    "max_body_bytes": _integer(1),
    "drain_max_default": _integer(1),
    "drain_max_limit": _integer(1),
    "backpressure_retry_after_s": _integer(0),
    "filter_threshold": _number(0.01, 0.99),
    "push_url": _url,
    "push_batch": _integer(1),
    "push_interval_ms": _integer(1),
    "push_max_backoff_ms": _integer(1),
    "push_timeout_ms": _integer(1),
    "push_max_body_bytes": _integer(1),
}
