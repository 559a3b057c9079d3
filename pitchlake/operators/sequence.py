"""Operators over ordered samples of a key: trailing windows, islands, folds.

Times are whole milliseconds. Windows of one key share a shuffle. Filters whose state
goes from row to row (ema, kalman) stream over the sorted rows of a partition and hold
one state, whatever the length of a match; the fold of greedy_dedup runs over one array
of few candidates per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _w(key: list[str], order: str, *more: str) -> Window:
    return Window.partitionBy(*key, *more).orderBy(order)


def trailing_still(df: DataFrame, key: list[str], order: str, x: str, y: str, n: int = 3, limit: float = 10.0, out: str = "still") -> DataFrame:
    """Whether the last n rows' bounding box has a diagonal under limit; false with fewer rows."""
    w = _w(key, order).rowsBetween(-(n - 1), 0)
    spread = F.hypot(F.max(x).over(w) - F.min(x).over(w), F.max(y).over(w) - F.min(y).over(w))
    return df.withColumn(out, F.coalesce((F.count("*").over(w) >= max(n, 2)) & (spread < limit), F.lit(False)))


def trailing_still_reset(df: DataFrame, key: list[str], order: str, x: str, y: str, seen: Column, n: int = 3, limit: float = 10.0, out: str = "still") -> DataFrame:
    """trailing_still over runs of rows where seen holds; other rows are false and end a run."""
    marked = df.withColumn("_seen", seen).withColumn("_run", F.sum((~F.col("_seen")).cast("long")).over(_w(key, order)))
    # rows of a run follow its unseen row, which is a partition of its own
    done = trailing_still(marked, [*key, "_run", "_seen"], order, x, y, n, limit, out)
    return done.withColumn(out, F.col(out) & F.col("_seen")).drop("_seen", "_run")


def dead_labels(df: DataFrame, key: list[str], ts: str = "ts_ms", seen: str = "visible", x: str = "px", y: str = "py", window_ms: int = 1000, limit: float = 40.0, out: str = "dead") -> DataFrame:
    """offscreen, stationary or null per sample.

    Stationary: the samples of the last window_ms since the ball was last lost lie within
    limit and the first sample since then is at least that old.
    """
    visible = F.coalesce(F.col(seen), F.lit(False)) & F.col(x).isNotNull()
    m = df.withColumn("_vis", visible).withColumn("_run", F.sum((~F.col("_vis")).cast("long")).over(_w(key, ts)))
    run = Window.partitionBy(*key, "_run", "_vis").orderBy(ts)
    w = run.rangeBetween(-window_ms, 0)
    begun = F.min(ts).over(run.rowsBetween(Window.unboundedPreceding, 0))
    spread = F.hypot(F.max(x).over(w) - F.min(x).over(w), F.max(y).over(w) - F.min(y).over(w))
    still = (F.col(ts) - begun >= window_ms) & (F.count("*").over(w) >= 2) & (spread < limit)
    return m.withColumn(out, F.when(~F.col("_vis"), "offscreen").when(still, "stationary")).drop("_vis", "_run")


def dead_segments(df: DataFrame, key: list[str], ts: str = "ts_ms", label: str = "dead", min_ms: int = 5000, pad_ms: int = 500) -> DataFrame:
    """key, start_ms, end_ms, reason of runs of labelled samples that last min_ms, shrunk by pad_ms at both ends."""
    prev = F.lag(F.col(label).isNotNull(), 1, False).over(_w(key, ts))
    m = df.withColumn("_new", (F.col(label).isNotNull() & ~prev).cast("long")).withColumn("_run", F.sum("_new").over(_w(key, ts))).where(F.col(label).isNotNull())
    g = m.groupBy(*key, "_run").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.min(label).alias("a"), F.max(label).alias("b")).where(F.col("last") - F.col("first") >= min_ms)
    out = g.select(*key, (F.col("first") + pad_ms).alias("start_ms"), (F.col("last") - pad_ms).alias("end_ms"), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("reason"))
    return out.where("end_ms > start_ms")


def complement(segments: DataFrame, totals: DataFrame, key: list[str], start: str = "start_ms", end: str = "end_ms", total: str = "total_ms") -> DataFrame:
    """key, start, end of what segments leave of [0, total]; they may overlap. totals has a row per key."""
    s = segments.join(totals.select(*key, total), key).withColumn(start, F.greatest(F.lit(0), F.col(start))).withColumn(end, F.least(F.col(end), F.col(total))).where(F.col(end) > F.col(start))
    ends = totals.select(*key, F.col(total).alias(start), F.col(total).alias(end))
    both = s.select(*key, start, end).unionByName(ends)
    w = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    gap = both.withColumn("_from", F.coalesce(F.max(end).over(w), F.lit(0)))
    return gap.where(F.col(start) > F.col("_from")).select(*key, F.col("_from").alias(start), F.col(start).alias(end))


def _fold(df: DataFrame, key: list[str], order: list[str], extra: list[str]) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(*order, *extra)))
    return df.groupBy(*key).agg(items.alias("_items"))


def greedy_dedup(df: DataFrame, key: list[str], ts: str = "ts_ms", gap_ms: int = 5000, tie: str = "frame") -> DataFrame:
    """In order of time, rows at least gap_ms after the last row taken; all columns of df stay."""
    rest = [c for c in df.columns if c not in (*key, ts, tie)]
    f = _fold(df, key, [ts, tie], rest)
    kind = f.schema["_items"].dataType.simpleString()
    state = f"struct<last:bigint,got:{kind}>"
    begin = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(kind).alias("got")).cast(state)

    def step(acc: Column, e: Column) -> Column:
        take = acc["last"].isNull() | (e[ts] - acc["last"] >= gap_ms)
        return F.when(take, F.struct(e[ts].cast("long").alias("last"), F.concat(acc["got"], F.array(e)).alias("got")).cast(state)).otherwise(acc)

    got = f.select(*key, F.explode(F.aggregate("_items", begin, step)["got"]).alias("_e"))
    return got.select(*(F.col(c) if c in key else F.col("_e")[c].alias(c) for c in df.columns))


def carried(df: DataFrame, key: list[str], order: list[str], inputs: list[str], begin: Callable[[], Callable[..., tuple]], out: str) -> DataFrame:
    """df with the columns of the DDL out, made row by row: begin() gives a key's step, which gets the inputs of each row in order.

    Keys are dealt out by one shuffle and sorted; rows stream through in batches, and only
    the step of the last key is kept between them.
    """
    made = df.sparkSession.createDataFrame([], out).schema
    types = [f.type for f in to_arrow_schema(made)]
    where = [df.columns.index(c) for c in (*key, *inputs)]
    n_key = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for b in batches:
            if not b.num_rows:
                continue
            got = []
            for row in zip(*(b.column(i).to_pylist() for i in where), strict=True):
                if step is None or row[:n_key] != last:
                    last, step = row[:n_key], begin()
                got.append(step(*row[n_key:]))
            new = [pa.array(v, t) for v, t in zip(zip(*got, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *made.names])

    schema = StructType([*df.schema.fields, *made.fields])
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def ema(df: DataFrame, key: list[str], order: str, value: str, start: float, alpha: float, out: str = "smooth") -> DataFrame:
    """key, order, value, out: exponential average from start over the rows' values; null values keep it."""

    def begin() -> Callable[[float | None], tuple[float]]:
        now = float(start)

        def step(v: float | None) -> tuple[float]:
            nonlocal now
            if v is not None:
                now += (v - now) * alpha
            return (now,)

        return step

    return carried(df.select(*key, order, value), key, [order], [value], begin, f"`{out}` double")


def kalman(df: DataFrame, key: list[str], ts: str = "ts_ms", seen: str = "visible", x: str = "px", y: str = "py", noise: float = 8.0, accel: float = 300.0, gate: float = 9.21, relock: int = 3, gap_ms: int = 1000, speed: float = 1000.0) -> DataFrame:
    """Constant-velocity smoothing of seen samples with outlier gating.

    All rows and columns of df come back, with x and y smoothed where the ball is seen and
    as they were where it isn't, and raw_x, raw_y (what was measured; null if unseen),
    smoothed and outlier. Both axes have the same noise and don't mix, so one 2x2
    covariance (p, c, v) serves for both. The time step counts from the sample before,
    seen or not; unseen ones don't move the filter. Values are not rounded.
    """
    r, q = noise * noise, accel * accel

    def begin() -> Callable[..., tuple]:
        state = None  # x, y, vx, vy, p, c, v
        before = last = None  # times of the sample before, and of the last one seen
        rejects = 0

        def step(t: int, visible: bool | None, mx: float | None, my: float | None) -> tuple:
            nonlocal state, before, last, rejects
            d = 0.0 if before is None else max(0.0, (t - before) / 1000.0)
            before = t
            if not visible or mx is None:
                return mx, my, None, None, False, False
            stale = last is not None and t - last > gap_ms
            last = t
            fresh = (mx, my, 0.0, 0.0, r, 0.0, speed * speed)
            if state is None:
                state = fresh
                return mx, my, mx, my, True, False
            if stale:
                state, rejects = fresh, 0
            sx, sy, vx, vy, p, c, v = state
            sx, sy = sx + d * vx, sy + d * vy
            p, c, v = p + 2 * d * c + d * d * v + q * d * d * d * d / 4, c + d * v + q * d * d * d / 2, v + q * d * d
            ex, ey, n = mx - sx, my - sy, p + r
            outlier = (ex * ex + ey * ey) / n > gate
            if not outlier:
                kp, kc = p / n, c / n
                state, rejects = (sx + kp * ex, sy + kp * ey, vx + kc * ex, vy + kc * ey, p * (1 - kp), c * (1 - kp), v - kc * c), 0
            elif rejects + 1 >= relock:
                state, rejects, outlier = fresh, 0, False
            else:
                state, rejects = (sx, sy, vx, vy, p, c, v), rejects + 1
            return state[0], state[1], mx, my, True, outlier

        return step

    given = df.withColumn(x, F.col(x).cast("double")).withColumn(y, F.col(y).cast("double"))
    out = carried(given, key, [ts], [ts, seen, x, y], begin, "_x double, _y double, raw_x double, raw_y double, smoothed boolean, outlier boolean")
    return out.withColumns({x: F.col("_x"), y: F.col("_y")}).drop("_x", "_y")


def attempts(df: DataFrame, key: list[str], order: str, gap: int) -> DataFrame:
    """df with attempt: rows at which something is tried again, the earliest gap after the last attempt; a key's first row is one."""

    def begin() -> Callable[[int], tuple[bool]]:
        last = None

        def step(at: int) -> tuple[bool]:
            nonlocal last
            due = last is None or at - last >= gap
            last = at if due else last
            return (due,)

        return step

    return carried(df, key, [order], [order], begin, "attempt boolean")


def registered(df: DataFrame, key: list[str], order: str, value: str, gap: int, out: str = "current") -> DataFrame:
    """df with attempt and out: the value of the last attempt that gave one; values between attempts aren't taken."""
    a = attempts(df, key, order, gap)
    return carry_forward(a.withColumn("_v", F.when(F.col("attempt"), F.col(value))), key, order, "_v", out).drop("_v")


def carry_forward(df: DataFrame, key: list[str], order: str, value: str, out: str) -> DataFrame:
    """The last value that isn't null up to each row."""
    return df.withColumn(out, F.last(value, True).over(_w(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def sliding_windows(totals: DataFrame, key: list[str], total: str = "total_ms", length: int = 10_000, stride: int = 10_000) -> DataFrame:
    """key, start_ms, end_ms, mid_ms of windows laid over each key's duration."""
    starts = totals.where(F.col(total) > 0).select(*key, F.explode(F.sequence(F.lit(0), F.col(total) - 1, F.lit(stride))).alias("start_ms"))
    return starts.select(*key, "start_ms", (F.col("start_ms") + length).alias("end_ms"), (F.col("start_ms") + length // 2).alias("mid_ms"))


def spotted(windows: DataFrame, confidence: str = "confidence", label: str = "label", least: float = 0.6) -> DataFrame:
    """Windows with a label whose confidence is at least least, with the times of an event at their middle."""
    kept = windows.where(F.col(label).isNotNull() & (F.col(confidence) >= least))
    return kept.withColumn("timestamp_s", F.round(F.col("mid_ms") / 1000.0, 2)).withColumn("position_ms", F.col("mid_ms").cast("long"))


def half(frames: DataFrame, frame: str, which: str, total: Column, half_frame: Column | None = None) -> DataFrame:
    """Rows of the first or second half, which begins at half_frame (if that isn't 0) or total div 2; both keeps all."""
    middle = F.floor(total / 2)
    middle = middle if half_frame is None else F.coalesce(F.nullif(half_frame, F.lit(0)), middle)
    if which == "first":
        return frames.where(F.col(frame) < middle)
    return frames.where((F.col(frame) >= middle) & (F.col(frame) < total)) if which == "second" else frames
