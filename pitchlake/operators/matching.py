"""Nearest, as-of and interval joins, made of equi joins on explicit candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou


def nearest_in_frames(events: DataFrame, players: DataFrame, key: list[str], event_id: str, frame: str = "frame", reach: int = 3, field: tuple[str, str] = ("fx", "fy"), pixel: tuple[str, str] | None = ("px", "py"), most: float = 5.0, most_px: float = 120.0, track: str = "track") -> DataFrame:
    """events with track and distance of the nearest player, null if none is near.

    An event with field coordinates is measured on the field, else by pixels. Frames are
    tried in the order f, f+1, f-1, ...; the first with a player that has coordinates of
    that kind decides. Of equal distances the smallest track counts.
    """
    steps = [0] + [s * d for d in range(1, reach + 1) for s in (1, -1)]
    on_field = F.col(field[0]).isNotNull() & F.col(field[1]).isNotNull()
    px = [F.col(c) if pixel else F.lit(None).cast("double") for c in pixel or field]
    e = events.select(*key, event_id, frame, on_field.alias("_field"), F.when(on_field, F.col(field[0])).otherwise(px[0]).alias("_x"), F.when(on_field, F.col(field[1])).otherwise(px[1]).alias("_y"))
    e = e.where("_x is not null and _y is not null").select("*", F.posexplode(F.array(*(F.lit(s) for s in steps))).alias("_turn", "_step")).withColumn("_frame", F.col(frame) + F.col("_step"))
    has_px = pixel is not None and set(pixel) <= set(players.columns)
    p = players.select(*key, F.col(frame).alias("_frame"), F.col(track).alias("_track"), F.col(field[0]).alias("_pfx"), F.col(field[1]).alias("_pfy"), *(F.col(c).alias(n) if has_px else F.lit(None).cast("double").alias(n) for c, n in zip(pixel or field, ("_ppx", "_ppy"), strict=True)))
    j = e.join(p, [*key, "_frame"])
    dx = F.when(F.col("_field"), F.col("_pfx")).otherwise(F.col("_ppx")) - F.col("_x")
    dy = F.when(F.col("_field"), F.col("_pfy")).otherwise(F.col("_ppy")) - F.col("_y")
    best = j.withColumn("_d", F.hypot(dx, dy)).where("_d is not null").groupBy(event_id).agg(F.min(F.struct("_turn", "_d", "_track", "_field")).alias("_b"))
    near = best.where(F.col("_b._d") <= F.when(F.col("_b._field"), F.lit(most)).otherwise(F.lit(most_px)))
    return events.join(near.select(event_id, F.col("_b._track").alias(track), F.col("_b._d").alias("distance")), event_id, "left")


def nearest_player(ball: DataFrame, players: DataFrame, key: list[str], most: float = 3.0, track: str = "track") -> DataFrame:
    """key, track, distance of the player nearest to the ball of each frame, within most."""
    j = ball.select(*key, F.col("fx").alias("_bx"), F.col("fy").alias("_by")).where("_bx is not null and _by is not null").join(players, key)
    best = j.withColumn("_d", F.hypot(F.col("fx") - F.col("_bx"), F.col("fy") - F.col("_by"))).where("_d is not null").groupBy(*key).agg(F.min(F.struct("_d", track)).alias("_b"))
    return best.where(F.col("_b._d") <= most).select(*key, F.col(f"_b.{track}").alias(track), F.col("_b._d").alias("distance"))


def nearest_valid(rows: DataFrame, key: list[str], order: str, value: str, out: str = "nearest") -> DataFrame:
    """The value that isn't null of the nearest row by order, the lower one of two as near, the smallest of rows that share it.

    Rows without an order are near nothing. Both windows grow from one end of the key, so each row is taken up once: a frame that
    ends at the last row would be added up anew for every row.
    """
    o, part = F.col(order), Window.partitionBy(*key)
    item = lambda at: F.min(F.when(F.col(value).isNotNull() & o.isNotNull(), F.struct(at.alias("o"), F.col(value).alias("v"))))
    grown = lambda by: part.orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back, ahead = item(-o).over(grown(o.asc())), item(o).over(grown(o.desc()))
    far = F.lit(2**62)
    pick = F.when(F.coalesce(o + back["o"], far) <= F.coalesce(ahead["o"] - o, far), back["v"]).otherwise(ahead["v"])
    return rows.withColumn(out, pick)


def interpolated_boxes(samples: DataFrame, wanted: DataFrame, key: list[str], frame: str = "frame", sides: tuple[str, ...] = ("x1", "y1", "x2", "y2"), max_gap: int = 10) -> DataFrame:
    """wanted (key, frame) with each track's box: the sample itself, or on the line between two that are at most max_gap apart; else null."""
    w = Window.partitionBy(*key).orderBy(frame)
    spans = samples.select(*key, F.col(frame).alias("_f0"), F.lead(frame).over(w).alias("_f1"), *sides, *(F.lead(s).over(w).alias(f"_{s}") for s in sides))
    last = F.when(F.col("_f1") - F.col("_f0") <= max_gap, F.col("_f1") - 1).otherwise(F.col("_f0"))
    grid = spans.withColumn(frame, F.explode(F.sequence("_f0", F.coalesce(last, F.col("_f0")))))
    share = F.when(F.col(frame) == F.col("_f0"), F.lit(0.0)).otherwise((F.col(frame) - F.col("_f0")) / (F.col("_f1") - F.col("_f0")))
    on = [F.when(share == 0, F.col(s)).otherwise(F.col(s) + (F.col(f"_{s}") - F.col(s)) * share).alias(s) for s in sides]
    return wanted.join(grid.select(*key, frame, *on), [*key, frame], "left")


def veto(boxes: DataFrame, against: DataFrame, key: list[str], sides: tuple[str, ...] = ("x1", "y1", "x2", "y2"), most: float = 0.45) -> DataFrame:
    """boxes that overlap none of the other boxes of their key by more than most (intersection over union)."""
    o = against.select(*key, *(F.col(s).alias(f"_{s}") for s in sides))
    cond = [boxes[k] == o[k] for k in key]
    over = iou(tuple(boxes[s] for s in sides), tuple(o[f"_{s}"] for s in sides)) > most
    return boxes.join(o, [*cond, over], "left_anti")


def lookup(rows: DataFrame, table: DataFrame, on: str, value: str) -> DataFrame:
    """Left join to one row per key (the smallest value), as a dictionary would give."""
    return rows.join(table.groupBy(on).agg(F.min(value).alias(value)), on, "left")


def event_filter(events: DataFrame, label: str | list[str] | None = None, team: str | None = None, track: int | None = None, lanes: DataFrame | None = None) -> DataFrame:
    """Rows that meet all conditions given; label may be a list; team ignores case, null counts as empty text.

    track and lanes (a table with a column track) are one set of tracks; an empty one
    lets nothing through, a null track is in none.
    """
    out = events
    if label is not None:
        out = out.where(F.col("label").isin([label] if isinstance(label, str) else list(label)))
    if team is not None:
        out = out.where(F.lower(F.coalesce("team", F.lit(""))) == team.lower())
    if lanes is not None:
        some = lanes.select(F.col("track").cast("long").alias("track"))
        if track is not None:
            some = some.unionByName(events.sparkSession.createDataFrame([(track,)], "track long"))
        out = out.join(some.distinct(), "track", "left_semi")
    elif track is not None:
        out = out.where(F.col("track") == track)
    return out


def lanes_for(votes: DataFrame, roster: DataFrame, number: Column | None = None, name: str | None = None) -> DataFrame:
    """Tracks of a jersey number, or of a name's number in the roster, or of the name stored with the vote."""
    if number is not None:
        return votes.where(F.col("jersey") == number).select("track").distinct()
    if name is None:
        return votes.where("false").select("track")
    same = lambda c: F.lower(F.trim(c)) == name.strip().lower()
    # one row: the number, or null if the roster doesn't have the name
    hit = roster.where(same(F.col("name"))).agg(F.min("jersey").alias("_hit"))
    found = votes.crossJoin(F.broadcast(hit)).where(F.when(F.col("_hit").isNotNull(), F.col("jersey") == F.col("_hit")).otherwise(same(F.coalesce("name", F.lit("")))))
    return found.select("track").distinct()


def by_frames(rows: DataFrame, frames: DataFrame | None, frame: str = "frame") -> DataFrame:
    """rows of the listed frames; no list keeps all."""
    return rows if frames is None else rows.join(frames.select(frame).distinct(), frame, "left_semi")


def named(votes: DataFrame, roster: DataFrame) -> DataFrame:
    """votes with the name of their jersey in the roster (its first by name), null without one."""
    return votes.join(roster.where("jersey is not null").groupBy("jersey").agg(F.min("name").alias("name")), "jersey", "left")
