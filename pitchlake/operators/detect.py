"""Set-piece detectors, the engine registry and the dead-time plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import goal_zone, in_corner, on_touchline
from ..functions.labels import phase
from .sequence import complement, dead_labels, dead_segments, greedy_dedup, trailing_still

def _still(balls: DataFrame, key: list[str], n: int, limit: float) -> DataFrame:
    s = trailing_still(balls, key, "frame", "px", "py", n, limit)
    return s.where("still and fx is not null and fy is not null").drop("still")


def _events(rows: DataFrame, key: list[str], label: str, gap_ms: int, default: float) -> DataFrame:
    e = greedy_dedup(rows.select(*key, "ts_ms", "frame", "px", "py", "fx", "fy", "conf"), key, gap_ms=gap_ms)
    return e.withColumn("label", F.lit(label)).withColumn("conf", F.coalesce("conf", F.lit(default))).withColumn("source", F.lit("rules"))


def goal_kicks(balls: DataFrame, key: list[str], n: int = 3, limit: float = 10.0, gap_ms: int = 5000) -> DataFrame:
    zone = goal_zone(F.col("fx"), F.col("fy"))
    return _events(_still(balls, key, n, limit).where(zone.isNotNull()), key, "goal_kick", gap_ms, 0.5)


def corner_kicks(balls: DataFrame, key: list[str], n: int = 3, limit: float = 10.0, gap_ms: int = 5000) -> DataFrame:
    return _events(_still(balls, key, n, limit).where(in_corner(F.col("fx"), F.col("fy"))), key, "corner_kick", gap_ms, 0.5)


def throw_ins(balls: DataFrame, key: list[str], n: int = 3, limit: float = 10.0, gap_ms: int = 5000) -> DataFrame:
    near = on_touchline(F.col("fx"), F.col("fy")) & ~in_corner(F.col("fx"), F.col("fy"))
    return _events(_still(balls, key, n, limit).where(near), key, "throw_in", gap_ms, 0.4)


def set_pieces(balls: DataFrame, key: list[str], n: int = 3, limit: float = 10.0, gap_ms: int = 5000) -> DataFrame:
    """All three kinds with their phase; a ball at rest in a corner is a goal kick as well.

    The samples are windowed once; each kind is thinned out on its own in one fold.
    """
    x, y = F.col("fx"), F.col("fy")
    corner = in_corner(x, y)
    kinds = F.array(F.when(goal_zone(x, y).isNotNull(), "goal_kick"), F.when(corner, "corner_kick"), F.when(on_touchline(x, y) & ~corner, "throw_in"))
    rows = _still(balls, key, n, limit).withColumn("label", F.explode(F.array_compact(kinds)))
    e = greedy_dedup(rows.select(*key, "label", "ts_ms", "frame", "px", "py", "fx", "fy", "conf"), [*key, "label"], gap_ms=gap_ms)
    conf = F.coalesce("conf", F.when(F.col("label") == "throw_in", 0.4).otherwise(0.5))
    return e.withColumn("conf", conf).withColumn("source", F.lit("rules")).withColumn("phase", phase(F.col("label")))


@dataclass
class Context:
    """What an engine may read."""

    balls: DataFrame
    players: DataFrame | None = None
    fps: float = 5.0
    key: list[str] = field(default_factory=lambda: ["match_id"])
    config: dict = field(default_factory=dict)


@runtime_checkable
class Engine(Protocol):
    name: str

    def is_available(self) -> bool: ...

    def detect(self, context: Context) -> DataFrame: ...


class Rules:
    name = "rules"

    def is_available(self) -> bool:
        return True

    def detect(self, context: Context) -> DataFrame:
        return set_pieces(context.balls, context.key, **context.config)


class Learned:
    """Place of a trained action model; without one it isn't available."""

    name = "learned"

    def __init__(self, model: Callable[[Context], DataFrame] | None = None):
        self.model = model

    def is_available(self) -> bool:
        return self.model is not None

    def detect(self, context: Context) -> DataFrame:
        return self.model(context)


class Registry:
    """Engines by name; opt-in ones run only if named, unknown and unavailable ones are skipped."""

    def __init__(self) -> None:
        self.made: dict[str, tuple[Callable[[], Engine], bool]] = {}
        self.aliases: dict[str, str] = {}

    def add(self, name: str, make: Callable[[], Engine], opt_in: bool = False, aliases: Iterable[str] = ()) -> None:
        self.made[name] = (make, opt_in)
        self.aliases.update(dict.fromkeys(aliases, name))

    def resolve(self, names: Iterable[str] | None = None) -> list[Engine]:
        wanted = [n for n, (_, opt_in) in self.made.items() if not opt_in] if names is None else [self.aliases.get(n, n) for n in names]
        engines = [self.made[n][0]() for n in dict.fromkeys(wanted) if n in self.made]
        return [e for e in engines if e.is_available()]

    def run(self, context: Context, names: Iterable[str] | None = None) -> DataFrame | None:
        """Events of all engines in order of time (none counts as 0), then of engines; source defaults to the engine's name."""
        parts = []
        for i, e in enumerate(self.resolve(names)):
            got = e.detect(context)
            got = got if "source" in got.columns else got.withColumn("source", F.lit(e.name))
            parts.append(got.withColumn("_engine", F.lit(i)))
        if not parts:
            return None
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        ts = [F.coalesce("ts_ms", F.lit(0))] if "ts_ms" in every.columns else []
        return every.orderBy(*ts, "_engine", *(c for c in ("match_id", "frame") if c in every.columns)).drop("_engine")


def default_registry() -> Registry:
    r = Registry()
    r.add("rules", Rules, aliases=("set_piece", "heuristic"))
    r.add("learned", Learned)
    return r


@dataclass
class TrimPlan:
    removed: DataFrame
    kept: DataFrame
    totals: DataFrame


def trim_plan(samples: DataFrame, key: list[str], min_ms: int = 5000, pad_ms: int = 500, window_ms: int = 1000, limit: float = 40.0, ts: str = "ts_ms") -> TrimPlan:
    """Dead time to cut, what is kept, and both sums with the share removed."""
    removed = dead_segments(dead_labels(samples, key, ts=ts, window_ms=window_ms, limit=limit), key, ts=ts, min_ms=min_ms, pad_ms=pad_ms)
    total = samples.groupBy(*key).agg(F.max(ts).alias("total_ms"))
    kept = complement(removed, total, key)
    cut = removed.groupBy(*key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("removed_ms"), F.count("*").alias("cuts"))
    t = total.join(cut, key, "left").select(*key, "total_ms", F.coalesce("removed_ms", F.lit(0)).alias("removed_ms"), F.coalesce("cuts", F.lit(0)).alias("cuts"))
    t = t.withColumn("kept_ms", F.col("total_ms") - F.col("removed_ms")).withColumn("removed_pct", F.when(F.col("total_ms") > 0, F.round(F.col("removed_ms") * 100.0 / F.col("total_ms"), 1)).otherwise(0.0))
    return TrimPlan(removed, kept, t)
