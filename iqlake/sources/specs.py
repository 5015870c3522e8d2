"""Dataset specifications. Ids S01, S09 of the survey."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from .sinks import small_text

#: Bytes of a specification at most, and the keys that it has.
MOST, KEYS = 64 << 10, ("schema_version", "modulations", "snrs", "samples")


def load_spec(spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS) -> dict[str, Any]:
    """A YAML or JSON mapping with at least the given keys and schema_version 1. S01."""
    text = small_text(spark, path, MOST)
    if text is None:
        raise FileNotFoundError(path)
    if path.endswith(".json"):
        spec = json.loads(text)
    else:
        import yaml

        spec = yaml.safe_load(text)
    if not isinstance(spec, dict) or not set(keys) <= set(spec):
        raise ValueError(f"{path} must have the keys {', '.join(keys)}")
    if spec["schema_version"] != 1 or isinstance(spec["schema_version"], bool):
        raise ValueError(f"{path} has schema version {spec['schema_version']!r}")
    return spec


def check_spec(spec: dict[str, Any]) -> dict[str, Any]:
    """``spec`` itself if its grid adds up: different names and levels, a two-channel window of float32, and as many samples as
    names x levels x samples per cell. S09."""
    names, levels, samples = spec["modulations"], spec["snrs"], spec["samples"]
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not names or len(set(names)) != len(names) or not all(isinstance(n, str) and n.strip() for n in names):
        raise ValueError("modulations must be different names")
    if not levels or len(set(levels)) != len(levels) or not all(map(whole, levels)):
        raise ValueError("snrs must be different integers")
    shape = samples["shape"]
    if len(shape) != 2 or shape[0] != 2 or not all(whole(n) and n > 0 for n in shape) or samples["dtype"] != "float32":
        raise ValueError("windows must be two channels of float32")
    if not whole(samples["per_cell"]) or samples["total"] != len(names) * len(levels) * samples["per_cell"]:
        raise ValueError("total must be modulations x snrs x samples per cell")
    return spec
