"""Counts, shares and movement figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup_counts(events: DataFrame) -> DataFrame:
    """label, team, n: by both, by label and in all (nulls stand for all; a null team counts as unknown)."""
    e = events.withColumn("team", F.coalesce("team", F.lit("unknown")))
    return e.groupingSets([["label", "team"], ["label"], []], "label", "team").agg(F.count("*").alias("n"))


def _steps(df: DataFrame, key: list[str], order: str, x: str, y: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_dx", F.col(x) - F.lag(x).over(w)).withColumn("_dy", F.col(y) - F.lag(y).over(w)).withColumn("_step", F.hypot("_dx", "_dy"))


def distance(df: DataFrame, key: list[str], order: str, x: str, y: str) -> DataFrame:
    """key, distance: sum of the steps between consecutive positions."""
    return _steps(df, key, order, x, y).groupBy(*key).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("distance"))


def sprints(df: DataFrame, key: list[str], order: str, x: str, y: str, fps: float = 10.0, speed: float = 5.0, seconds: float = 1.0) -> DataFrame:
    """key, start, end, positions of runs of steps faster than speed that span seconds * fps positions."""
    w = Window.partitionBy(*key).orderBy(order)
    s = _steps(df, key, order, x, y).withColumn("_from", F.lag(order).over(w)).withColumn("_fast", F.coalesce(F.col("_step") * fps > speed, F.lit(False)))
    s = s.withColumn("_run", F.sum((~F.col("_fast")).cast("long")).over(w)).where("_fast")
    g = s.groupBy(*key, "_run").agg(F.min("_from").alias("start"), F.max(order).alias("end"), (F.count("*") + 1).alias("positions"))
    return g.where(F.col("positions") >= int(seconds * fps)).drop("_run")


def shots(df: DataFrame, key: list[str], order: str, x: str, y: str, fps: float = 10.0, speed: float = 8.0, w: float = 55.0, h: float = 36.0, mouth: float = 5.0) -> DataFrame:
    """Rows with column shot: a fast step toward a goal, near its end and within its mouth."""
    s = _steps(df, key, order, x, y)
    toward = ((F.col("_dx") < 0) & (F.col(x) < 0.3 * w)) | ((F.col("_dx") > 0) & (F.col(x) > 0.7 * w))
    inside = F.col(y).between(h / 2 - mouth / 2, h / 2 + mouth / 2)
    return s.withColumn("shot", F.coalesce((F.col("_step") * fps >= speed) & toward & inside, F.lit(False))).drop("_dx", "_dy", "_step")


def velocity(df: DataFrame, key: list[str], order: str, x: str, y: str) -> DataFrame:
    """Rows with vx, vy per unit of order, at least one of which lies between rows; 0 for the first."""
    w = Window.partitionBy(*key).orderBy(order)
    gap = F.greatest(F.lit(1), F.col(order) - F.lag(order).over(w))
    return df.withColumn("vx", F.coalesce((F.col(x) - F.lag(x).over(w)) / gap, F.lit(0.0))).withColumn("vy", F.coalesce((F.col(y) - F.lag(y).over(w)) / gap, F.lit(0.0)))


def histogram(df: DataFrame, x: str, y: str, bins: int = 20, w: float = 55.0, h: float = 36.0) -> DataFrame:
    """bin_x, bin_y, n for all bins; the last ones include their far border, points outside are left out."""
    spark = df.sparkSession
    at = lambda c, size: F.least(F.lit(bins - 1), F.floor(F.col(c) / size * bins)).cast("int")
    n = df.where(F.col(x).between(0, w) & F.col(y).between(0, h)).groupBy(at(x, w).alias("bin_x"), at(y, h).alias("bin_y")).agg(F.count("*").alias("n"))
    grid = spark.range(bins * bins).select((F.col("id") / bins).cast("int").alias("bin_x"), (F.col("id") % bins).cast("int").alias("bin_y"))
    return grid.join(n, ["bin_x", "bin_y"], "left").select("bin_x", "bin_y", F.coalesce("n", F.lit(0)).alias("n"))


def possession(nearest: DataFrame, teams: DataFrame, track: str = "track") -> DataFrame:
    """team, frames, pct of the frames whose nearest player has a team."""
    j = nearest.join(teams.groupBy(track).agg(F.min("team").alias("team")), track).where("team is not null").groupBy("team").agg(F.count("*").alias("frames"))
    return j.withColumn("pct", F.round(F.col("frames") * 100.0 / F.sum("frames").over(Window.partitionBy(F.lit(1))), 1))


def touches(near: DataFrame, key: list[str], order: str, track: str = "track", least: int = 2, step: int = 1) -> DataFrame:
    """key, track, start, end, frames of runs of consecutive frames with the same nearest player."""
    w = Window.partitionBy(*key).orderBy(order)
    new = F.coalesce((F.lag(track).over(w) != F.col(track)) | (F.col(order) - F.lag(order).over(w) > step), F.lit(True))
    r = near.withColumn("_run", F.sum(new.cast("long")).over(w))
    g = r.groupBy(*key, "_run", track).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("frames"))
    return g.where(F.col("frames") >= least).drop("_run")


def centroid(df: DataFrame, key: list[str], class_id: str, x: Column, y: Column, ball: int = 0, players: tuple[int, ...] = (1, 3)) -> DataFrame:
    """key, cx, cy: mean of the ball's centres, else of the players'; keys with neither have nulls."""
    is_ball, is_player = F.col(class_id) == ball, F.col(class_id).isin(*players)
    mean = lambda v: F.coalesce(F.avg(F.when(is_ball, v)), F.avg(F.when(is_player, v)))
    return df.groupBy(*key).agg(mean(x).alias("cx"), mean(y).alias("cy"))


def best_ball(df: DataFrame, key: list[str], confidence: str, tie: str) -> DataFrame:
    """The most confident row of each key, of equal ones that of the smallest tie."""
    rest = [c for c in df.columns if c not in key]
    top = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(confidence), -F.col(tie))).alias("_b"))
    return top.select(*key, *(F.col(f"_b.{c}").alias(c) for c in rest))


def of_class(detections: DataFrame, *classes: int, class_id: str = "class_id") -> DataFrame:
    """Detections of some classes."""
    return detections.where(F.col(class_id).isin(*classes))


def detection_summary(detections: DataFrame, frame: str = "frame", class_id: str = "class_id", ball: int = 0) -> DataFrame:
    """One row: frames, mean_n detections per frame, share with_ball."""
    f = detections.groupBy(frame).agg(F.count("*").alias("n"), F.max((F.col(class_id) == ball).cast("int")).alias("ball"))
    return f.agg(F.count("*").alias("frames"), F.avg("n").alias("mean_n"), F.avg("ball").alias("with_ball"))


def coverage(samples: DataFrame, key: list[str], seen: str = "visible", frame: str = "frame") -> DataFrame:
    """key, coverage (share of samples in which the ball is seen), frames."""
    return samples.groupBy(*key).agg(F.avg(F.col(seen).cast("double")).alias("coverage"), F.count_distinct(frame).alias("frames"))


def unique_tracks(rows: DataFrame, key: list[str], track: str = "track") -> DataFrame:
    """key, tracks: how many tracks there are."""
    return rows.groupBy(*key).agg(F.count_distinct(track).alias("tracks"))


def success_rate(attempts: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, ok, total, rate: attempts that gave a value; enough is whether at least half did."""
    g = attempts.groupBy(*key).agg(F.count(value).alias("ok"), F.count("*").alias("total"))
    return g.withColumn("rate", F.col("ok") / F.col("total")).withColumn("enough", F.col("ok") >= F.col("total") * 0.5)
