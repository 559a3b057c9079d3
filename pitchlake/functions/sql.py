"""Some of the functions by name for SQL, as expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geometry import CORNER_R, FIELD_H, FIELD_W, GOAL_BOX, TOUCH

#: name: (parameters, type, expression)
FUNCTIONS = {
    "goal_zone": ("x DOUBLE, y DOUBLE", "STRING", f"CASE WHEN y BETWEEN 0 AND {FIELD_H} THEN CASE WHEN x BETWEEN 0 AND {GOAL_BOX} THEN 'left' WHEN x BETWEEN {FIELD_W - GOAL_BOX} AND {FIELD_W} THEN 'right' END END"),
    "in_corner": ("x DOUBLE, y DOUBLE", "BOOLEAN", f"least(hypot(x, y), hypot(x - {FIELD_W}, y), hypot(x, y - {FIELD_H}), hypot(x - {FIELD_W}, y - {FIELD_H})) <= {CORNER_R}"),
    "on_touchline": ("y DOUBLE", "BOOLEAN", f"y <= {TOUCH} OR y >= {FIELD_H - TOUCH}"),
    "clip_start": ("ts DOUBLE, pre DOUBLE", "DOUBLE", "greatest(0D, ts - pre)"),
    "box_overlap": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "greatest(0D, least(a[2], b[2]) - greatest(a[0], b[0])) * greatest(0D, least(a[3], b[3]) - greatest(a[1], b[1]))"
        " / nullif((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - greatest(0D, least(a[2], b[2]) - greatest(a[0], b[0])) * greatest(0D, least(a[3], b[3]) - greatest(a[1], b[1])), 0D)",
    ),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make FUNCTIONS known to spark.sql(); returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
