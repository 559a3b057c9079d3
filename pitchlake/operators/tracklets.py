"""Clean-up of tracks and of per-frame class scores."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: lane_grid fills stretches of 2 ** STRETCH_BITS frames.
STRETCH_BITS = 12


def continuous(rows: DataFrame, key: list[str], frame: str = "frame", stride: int = 1, share: float = 0.5, least: int = 10) -> DataFrame:
    """Rows of tracks seen in at least least frames and share of those between their first and last."""
    n = rows.groupBy(*key).agg(F.count_distinct(frame).alias("n"), F.min(frame).alias("a"), F.max(frame).alias("b"))
    good = n.where((F.col("n") >= least) & (F.col("n") / ((F.col("b") - F.col("a")) / stride + 1) >= share))
    return rows.join(good.select(*key), key, "left_semi")


def slots(rows: DataFrame, team: str, track: str, most: int = 13) -> DataFrame:
    """team, track, n, slot: 1 for the team's longest track and so on, 0 beyond most; ties by track."""
    n = rows.groupBy(team, track).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(team).orderBy(F.desc("n"), track))
    return n.withColumn("slot", F.when(rank <= most, rank).otherwise(0))


def slot_grid(rows: DataFrame, track: str, frame: str, defaults: dict[str, float], most: int = 26) -> DataFrame:
    """slot, frame, the columns of defaults, mask: slots 1..most, the longest tracks of all, over frames 0 to the last one.

    A slot without a row in a frame has the defaults and mask 0; of several rows the smallest values count.
    """
    last = rows.agg(F.max(frame)).first()[0]
    grid = rows.sparkSession.range(0 if last is None else most * (last + 1)).select((F.floor(F.col("id") / (last + 1 if last is not None else 1)) + 1).cast("long").alias("slot"), (F.col("id") % (last + 1 if last is not None else 1)).alias(frame))
    n = rows.groupBy(track).agg(F.count("*").alias("n")).orderBy(F.desc("n"), track).limit(most)  # most rows
    lanes = n.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("n"), track)).cast("long")).select(track, "slot")
    present = rows.join(F.broadcast(lanes), track).groupBy("slot", frame).agg(F.min(F.struct(*defaults)).alias("_v"))
    j = grid.join(present, ["slot", frame], "left")
    return j.select("slot", frame, *(F.coalesce(f"_v.{c}", F.lit(v)).alias(c) for c, v in defaults.items()), F.col("_v").isNotNull().cast("int").alias("mask"))


def lane_grid(rows: DataFrame, team: str, track: str, frame: str, defaults: dict[str, float], most: int = 13) -> DataFrame:
    """team, slot, frame, the columns of defaults, mask: each team's slots 1..most over the whole frame range of rows.

    Slots are the team's longest tracks; a slot without a row in a frame, or with a null
    or NaN value there, has the defaults and mask 0. Of several rows the smallest values count.
    What is shuffled are the slots' own rows and one for each stretch of frames; each of
    them gives the frames up to the next one, so the grid itself is never shuffled.
    """
    at, span = F.col(frame).cast("long"), rows.agg(F.min(frame).cast("long").alias("_low"), F.max(frame).cast("long").alias("_high"))
    lanes = slots(rows, team, track, most).where("slot > 0").select(team, track, "slot")  # most rows of each team
    # the semi join comes first: Spark takes it below joins and aggregates that rows is made of
    own = rows.join(F.broadcast(lanes.select(track)), track, "left_semi").join(F.broadcast(lanes), [team, track])
    whole = [F.col(c).isNotNull() & ~F.isnan(c) if kind in ("float", "double") else F.col(c).isNotNull() for c, kind in rows.select(*defaults).dtypes]
    present = own.where(at.isNotNull()).select(team, "slot", at.alias("_at"), F.when(functools.reduce(Column.__and__, whole), F.struct(*defaults)).alias("_v"))
    begins = F.explode(F.sequence(F.shiftright("_low", STRETCH_BITS), F.shiftright("_high", STRETCH_BITS)))
    every = rows.select(team).dropna().distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(most))))
    marks = every.crossJoin(F.broadcast(span)).withColumn("_begin", begins).select(team, "slot", F.greatest("_low", F.shiftleft("_begin", STRETCH_BITS)).alias("_at"), F.lit(None).cast(present.schema["_v"].dataType).alias("_v"))
    known = marks.unionByName(present).withColumn("_stretch", F.shiftright("_at", STRETCH_BITS))
    # a fixed number of partitions: what goes in is too small to tell what comes out
    dealt = known.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), team, "slot", "_stretch").groupBy(team, "slot", "_stretch", "_at").agg(F.min("_v").alias("_v"))
    ahead = dealt.withColumn("_next", F.lead("_at").over(Window.partitionBy(team, "slot", "_stretch").orderBy("_at"))).crossJoin(F.broadcast(span))
    until = F.coalesce(F.col("_next") - 1, F.least("_high", F.shiftleft(F.col("_stretch") + 1, STRETCH_BITS) - 1))
    grid = ahead.select(team, "slot", "_at", "_v", F.explode(F.sequence("_at", until)).alias("_frame"))
    seen = (F.col("_frame") == F.col("_at")) & F.col("_v").isNotNull()
    return grid.select(team, "slot", F.col("_frame").alias(frame), *(F.when(seen, F.col(f"_v.{c}")).otherwise(F.lit(v)).alias(c) for c, v in defaults.items()), seen.cast("int").alias("mask"))


def best_class(scores: Column) -> tuple[Column, Column]:
    """Index (the first of equal ones) and value of the highest score."""
    top = F.array_max(scores)
    return (F.array_position(scores, top) - 1).cast("int"), top


def temporal_nms(rows: DataFrame, slot: str = "slot", frame: str = "frame", cls: str = "cls", score: str = "score", least: float = 0.15, reach: int = 15) -> DataFrame:
    """Rows of classes other than 0 above least whose score is the highest of the class within reach frames; ties stay."""
    w = Window.partitionBy(slot, cls).orderBy(frame).rangeBetween(-reach, reach)
    return rows.withColumn("_top", F.max(score).over(w)).where((F.col(cls) != 0) & (F.col(score) > least) & (F.col(score) >= F.col("_top"))).drop("_top")


def ball_distance(events: DataFrame, players: DataFrame, balls: DataFrame, width: float) -> DataFrame:
    """events (track, frame, ...) with ball_d: distance from the player's foot to the ball over width, null if either is missing."""
    p = players.select("track", "frame", F.col("x").alias("_px"), F.col("y").alias("_py"))
    b = balls.select("frame", F.col("x").alias("_bx"), F.col("y").alias("_by"))
    j = events.join(p, ["track", "frame"], "left").join(b, "frame", "left")
    return j.withColumn("ball_d", F.hypot(F.col("_px") - F.col("_bx"), F.col("_py") - F.col("_by")) / width).drop("_px", "_py", "_bx", "_by")


def ball_gate(events: DataFrame, near: float = 0.18, far: float = 0.32, sure: float = 0.45) -> DataFrame:
    """events with near; those far from the ball and not sure go, those without a distance stay."""
    drop = F.coalesce((F.col("ball_d") > far) & (F.col("score") < sure), F.lit(False))
    return events.where(~drop).withColumn("near", F.coalesce(F.col("ball_d") <= near, F.lit(False)))


def held_action(rows: DataFrame, key: list[str], frame: str, action: str, hold: int = 12, out: str = "held") -> DataFrame:
    """The latest action that isn't null within the last hold frames, this one included."""
    w = Window.partitionBy(*key).orderBy(frame).rangeBetween(-(hold - 1), 0)
    return rows.withColumn(out, F.last(action, True).over(w))


def class_counts(events: DataFrame, classes: list[str]) -> DataFrame:
    """cls, n for all classes, 0 for those that don't occur."""
    dim = events.sparkSession.createDataFrame([(c,) for c in classes], "cls string")
    return dim.join(events.groupBy("cls").agg(F.count("*").alias("n")), "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"))


def gate_counts(events: DataFrame, near: float = 0.18, far: float = 0.32, sure: float = 0.45) -> DataFrame:
    """One row: events, kept, near (kept ones by the ball) and gated (far from it and not sure) of events with ball_d and score."""
    gated = F.coalesce((F.col("ball_d") > far) & (F.col("score") < sure), F.lit(False))
    return events.agg(F.count("*").alias("events"), F.count_if(~gated).alias("kept"), F.count_if(~gated & (F.col("ball_d") <= near)).alias("near"), F.count_if(gated).alias("gated"))


def matrix(rows: DataFrame, game: str, frame: str, track: str, side: Column, width: float, height: float, box: tuple[str, str, str, str] = ("x", "y", "w", "h")) -> DataFrame:
    """The tracklet table, 14 columns after game: boxes with their normalised foot point and its speed per frame; shirt number, role and class unknown."""
    x, y, w, h = (F.col(c) for c in box)
    r = rows.withColumn("x_pos", (x + w / 2) / width).withColumn("y_pos", (y + h) / height)
    o = Window.partitionBy(game, track).orderBy(frame)
    gap = F.greatest(F.lit(1), F.col(frame) - F.lag(frame).over(o))
    speed = lambda c: F.coalesce((F.col(c) - F.lag(c).over(o)) / gap, F.lit(0.0))
    return r.select(game, F.col(frame).alias("frame"), F.col(track).alias("player_id"), F.coalesce(side, F.lit(0)).alias("left_to_right"), F.lit(-1).alias("shirt_number"), F.lit(0).alias("role_id"), "x_pos", "y_pos", speed("x_pos").alias("x_speed"), speed("y_pos").alias("y_speed"), x.alias("roi_x"), y.alias("roi_y"), w.alias("roi_w"), h.alias("roi_h"), F.lit(0).alias("cls"))


def associate(detections: DataFrame, key: list[str], frame: str = "frame", sides: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), conf: str = "conf", high: float = 0.25, low: float = 0.1, overlap: float = 0.2, lost: int = 30) -> DataFrame:
    """detections with track: boxes of following frames that overlap are one track.

    In each frame confident boxes choose first, then weak ones, by falling overlap with
    the tracks' last boxes; a confident box without a track begins one, a weak one has
    none (null). Tracks unseen for more than lost frames end. Numbers start at 1 per key.
    """
    cols = [*key, frame, *sides, conf]
    rest = detections.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tracks, made, held = None, {}, 0, []  # tracks: number -> (frame, box)

        def matched(rows: list[tuple], free: dict, got: list, pick) -> None:
            pairs = sorted(((-_overlap(r[2], box), i, n) for i, r in enumerate(rows) if got[i] is None and pick(r[3]) for n, (_, box) in free.items()), key=lambda p: p[:3])
            for score, i, n in pairs:
                if -score >= overlap and got[i] is None and n in free:
                    got[i] = n
                    del free[n]

        def done(rows: list[tuple]) -> list[int | None]:
            nonlocal last, tracks, made
            if rows[0][0] != last:
                last, tracks, made = rows[0][0], {}, 0
            now = rows[0][1]
            tracks = {n: t for n, t in tracks.items() if now - t[0] <= lost}
            got: list[int | None] = [None] * len(rows)
            free = dict(tracks)
            matched(rows, free, got, lambda c: c >= high)
            matched(rows, free, got, lambda c: low <= c < high)
            for i, r in enumerate(rows):
                if got[i] is None and r[3] >= high:
                    made += 1
                    got[i] = made
                if got[i] is not None:
                    tracks[got[i]] = (now, r[2])
            return got

        def out(part: pa.Table, rows: list[tuple]) -> pa.RecordBatch:
            numbers, at = [], 0
            for k in range(1, len(rows) + 1):
                if k == len(rows) or rows[k][:2] != rows[at][:2]:
                    numbers += done(rows[at:k])
                    at = k
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in part.columns), pa.array(numbers, pa.int64())], [*part.schema.names, "track"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                t = pa.Table.from_batches(held)
                rows = [(tuple(r[: len(key)]), r[len(key)], r[len(key) + 1 : -1], r[-1] or 0.0) for r in zip(*(t.column(c).to_pylist() for c in cols), strict=True)]
                cut = len(rows)
                while cut and rows[cut - 1][:2] == rows[-1][:2]:
                    cut -= 1
                if cut:  # the last frame may go on
                    yield out(t.slice(0, cut), rows[:cut])
                held = t.slice(cut).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield out(t, [(tuple(r[: len(key)]), r[len(key)], r[len(key) + 1 : -1], r[-1] or 0.0) for r in zip(*(t.column(c).to_pylist() for c in cols), strict=True)])

    dealt = detections.repartition(*key).sortWithinPartitions(*key, frame, F.desc(conf), *sides)
    return dealt.mapInArrow(run, StructType([*rest.fields, StructField("track", LongType())]))


def _overlap(a: tuple, b: tuple) -> float:
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0
    both = wide * high
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)
