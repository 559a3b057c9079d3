"""Team profiles and settings from small mappings (as a YAML file gives them)."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession


def read_yaml(path: str) -> dict:
    """A profile or settings file; an empty one is {}."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML profiles takes the package yaml") from e

    with open(path) as f:
        return yaml.safe_load(f) or {}


def roster(spark: SparkSession, profile: dict | None) -> DataFrame:
    """jersey, name, role, idp_focus of a profile's roster; an empty profile has none."""
    rows = [(p.get("jersey"), p.get("name"), p.get("role"), p.get("idp_focus")) for p in (profile or {}).get("roster", [])]
    return spark.createDataFrame(rows, "jersey int, name string, role string, idp_focus string")


def run_paths(root: str, match_id: str) -> dict[str, str]:
    """Where a match's files lie."""
    base = PurePosixPath(root) / match_id
    names = {"events": "events.json", "tracks": "tracks.json", "stats": "stats.json", "jerseys": "jerseys.json", "clips": "clips", "sheets": "sheets", "proxy": "proxy.mp4", "store": "store"}
    return {k: str(base / v) for k, v in names.items()}
