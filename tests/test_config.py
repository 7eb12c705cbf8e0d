import pytest

from textmill.config import ConfigError, EngineConfig


def test_defaults():
    c = EngineConfig.load({})
    assert (c.chunk_max_bytes, c.strong_threshold, c.drain_max_default, c.capacity_bytes) == (1024, 0.30, 256, 64 << 20)
    assert c.floor_heartbeat_types == {"log"} and c.floor_dedup_types == {"log", "document", "dialogue"}


def test_blank_is_unset_but_not_for_type_sets():
    c = EngineConfig.load({"X_CHUNK_MAX_BYTES": "  ", "X_FLOOR_DEDUP_TYPES": ""}, "X_")
    assert c.chunk_max_bytes == 1024 and c.floor_dedup_types == frozenset()


def test_every_problem_is_named():
    bad = {
        "CHUNK_MAX_BYTES": "10",
        "STRONG_THRESHOLD": "x",
        "EMBED_PROVIDER": "magic",
        "FLOOR_SEPARATOR_PATTERN": "(",
        "FLOOR_HEARTBEAT_TYPES": "log,chat",
        "DRAIN_MAX_DEFAULT": "5000",
        "PUSH_URL": "ftp://x",
        "PUSH_MAX_BACKOFF_MS": "5",
        "CAPACITY_MB": "1.5",
    }
    with pytest.raises(ConfigError) as e:
        EngineConfig.load(bad)
    assert all(k in str(e.value) for k in bad) and len(e.value.problems) == len(bad)
