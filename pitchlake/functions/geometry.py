"""Column functions over positions and boxes; lengths in the unit of the field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_W, FIELD_H = 55.0, 36.0
GOAL_BOX, CORNER_R, TOUCH = 5.5, 2.0, 2.0


def goal_zone(x: Column, y: Column, w: float = FIELD_W, h: float = FIELD_H, depth: float = GOAL_BOX) -> Column:
    """left, right or null; borders count, left wins."""
    return F.when((y >= 0) & (y <= h), F.when((x >= 0) & (x <= depth), "left").when((x >= w - depth) & (x <= w), "right"))


def in_corner(x: Column, y: Column, w: float = FIELD_W, h: float = FIELD_H, r: float = CORNER_R) -> Column:
    return F.least(*(F.hypot(x - cx, y - cy) for cx in (0.0, w) for cy in (0.0, h))) <= r


def on_touchline(x: Column, y: Column, h: float = FIELD_H, margin: float = TOUCH, bounded: bool = False, w: float = FIELD_W) -> Column:
    """Within margin of a long side, also outside the field unless bounded."""
    near = (y <= margin) | (y >= h - margin)
    return near & x.between(0, w) & y.between(0, h) if bounded else near


def foot_point(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def box_centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def project(x: Column, y: Column, h: list[float] | Column) -> tuple[Column, Column]:
    """Perspective map by nine row-major numbers, or a column that holds them."""
    m = [F.lit(float(v)) for v in h] if isinstance(h, list) else [h[i] for i in range(9)]
    d = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / d, (m[3] * x + m[4] * y + m[5]) / d


def on_field(fx: Column, fy: Column, margin: float = 3.0, w: float = FIELD_W, h: float = FIELD_H) -> Column:
    return fx.between(-margin, w + margin) & fy.between(-margin, h + margin)


def in_central_part(x: Column, y: Column, w: float, h: float, share: float = 0.7) -> Column:
    edge = round((1 - share) / 2, 9)
    mx, my = w * edge, h * edge
    return x.between(mx, w - mx) & y.between(my, h - my)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 if both are empty."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = wide * high
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def crop_rect(cx: Column, cy: Column, w: int, h: int, frame_w: int, frame_h: int) -> tuple[Column, Column]:
    """Top left corner of a crop around a point, cut toward zero and kept in the frame."""

    def side(c: Column, size: int, limit: int) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least((c - size / 2).cast("long"), F.lit(limit - size).cast("long")))

    return side(cx, w, frame_w), side(cy, h, frame_h)


def crop_fit(frame_w: Column, frame_h: Column, out_w: int, out_h: int) -> tuple[Column, Column]:
    """Largest crop of the output's shape within the frame, cut to whole pixels."""
    wide = frame_w * out_h > frame_h * out_w
    return F.when(wide, (frame_h * out_w / out_h).cast("long")).otherwise(frame_w), F.when(wide, frame_h).otherwise((frame_w * out_h / out_w).cast("long"))


def _part_rect(box: tuple[Column, ...], least: tuple[float, float], side: float, top: float, bottom: float, result: int, frame: tuple[int, int]) -> tuple[Column, ...]:
    """Whole pixels (halves to even) of a part of a box, kept in the frame; null for boxes and parts that are too small."""
    x1, y1, x2, y2 = box
    w, h = x2 - x1, y2 - y1
    whole = lambda c: F.bround(c).cast("long")
    low = lambda c: F.greatest(F.lit(0).cast("long"), whole(c))
    high = lambda c, most: F.least(F.lit(most).cast("long"), whole(c))
    part = (low(x1 + w * side), low(y1 + h * top), high(x2 - w * side, frame[0]), high(y1 + h * bottom, frame[1]))
    fits = (w >= least[0]) & (h >= least[1]) & (part[2] - part[0] >= result) & (part[3] - part[1] >= result)
    return tuple(F.when(fits, c) for c in part)


def torso_rect(x1: Column, y1: Column, x2: Column, y2: Column, frame: tuple[int, int] = (1920, 1080)) -> tuple[Column, ...]:
    """20 to 55 % of the height without 20 % at either side, of boxes of 4 x 8 and more; at least 2 x 2."""
    return _part_rect((x1, y1, x2, y2), (4, 8), 0.2, 0.2, 0.55, 2, frame)


def number_rect(x1: Column, y1: Column, x2: Column, y2: Column, frame: tuple[int, int] = (1920, 1080)) -> tuple[Column, ...]:
    """The top 55 % without 10 % at either side, of boxes of 12 x 24 and more; at least 8 x 8."""
    return _part_rect((x1, y1, x2, y2), (12, 24), 0.1, 0.0, 0.55, 8, frame)


def legible(w: Column, h: Column, deviation: Column, side: float = 16, least: float = 18.0) -> Column:
    return (w >= side) & (h >= side) & (deviation >= least)


def roi_scaled(x1: Column, y1: Column, x2: Column, y2: Column, k: float = 1.125, frame: tuple[int, int] = (1920, 1080), out: tuple[int, int] = (640, 352)) -> tuple[Column, ...]:
    """A box grown by k about its middle, kept in the frame and scaled down to whole pixels."""
    w, h = x2 - x1, y2 - y1
    left = F.greatest(F.lit(0.0), x1 - F.floor(w * ((k - 1) / 2)))
    top = F.greatest(F.lit(0.0), y1 - F.floor(h * ((k - 1) / 2)))
    right, bottom = F.least(F.lit(float(frame[0])), left + w * k), F.least(F.lit(float(frame[1])), top + h * k)
    sx, sy = frame[0] / out[0], frame[1] / out[1]
    return tuple(v.cast("long") for v in (left / sx, top / sy, right / sx, bottom / sy))


def hull_distance(x: Column, y: Column, hull: list[tuple[float, float]]) -> Column:
    """Signed distance to a convex polygon given counter-clockwise in (x, y): to its nearest border point, positive inside."""
    far, within = [], []
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
        dx, dy = bx - ax, by - ay
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        far.append(F.hypot(x - (ax + share * dx), y - (ay + share * dy)))
        within.append((x - ax) * -dy + (y - ay) * dx)
    return F.least(*far) * F.when(F.least(*within) >= 0, 1.0).otherwise(-1.0)


def zone_or_side(fx: Column, fy: Column, px: Column, width: float, share: float = 0.2) -> Column:
    """Goal zone of a position on the field; without one, the side of the image whose outer share holds the ball."""
    side = F.when(px < width * share, "left").when(px > width * (1 - share), "right")
    return F.when(fx.isNotNull() & fy.isNotNull(), goal_zone(fx, fy)).otherwise(side)


def kept_person(known: Column, field: tuple[Column, Column], pixel: tuple[Column, Column], frame: tuple[int, int] = (1920, 1080)) -> Column:
    """Whether a person's foot is on the field, or in the middle of the image where no homography is known."""
    return F.when(known, on_field(*field)).otherwise(in_central_part(*pixel, *frame))


def over_threshold(confidence: Column, given: Column | float | None, default: float) -> Column:
    """At least the threshold given; none or 0 means the default."""
    least = F.lit(default) if given is None else F.coalesce(F.nullif(given if isinstance(given, Column) else F.lit(float(given)), F.lit(0.0)), F.lit(default))
    return confidence >= least


def even_starts(duration: Column, n: int, margin: float = 60.0, clip: float = 15.0) -> Column:
    """Start times of n clips spread evenly within margins; one clip starts in the middle."""
    if n <= 1:
        return F.array(F.greatest(F.lit(0.0), duration / 2))
    span = F.greatest(F.lit(0.0), duration - 2 * margin - clip)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(margin) + span * i / (n - 1))


def corners_sane(corners: list[tuple[Column, Column]], frame: tuple[int, int] = (1920, 1080), margin: float = 0.3) -> Column:
    """Whether all corners are there and none is farther outside the frame than margin of its size."""
    inside = [x.between(-frame[0] * margin, frame[0] * (1 + margin)) & y.between(-frame[1] * margin, frame[1] * (1 + margin)) for x, y in corners]
    return F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(False))


def lab_colour(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """L, a, b (CIE, D65) of a colour given as 0..255 blue, green, red."""

    def linear(c: Column) -> Column:
        s = c / 255.0
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, 2.4))

    def curve(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, 1 / 3)).otherwise(7.787 * t + 16 / 116)

    # sRGB primaries and the white point of D65.
    rl, gl, bl = linear(r), linear(g), linear(b)
    x = curve((0.412453 * rl + 0.357580 * gl + 0.180423 * bl) / 0.950456)
    y_ = 0.212671 * rl + 0.715160 * gl + 0.072169 * bl
    z = curve((0.019334 * rl + 0.119193 * gl + 0.950227 * bl) / 1.088754)
    y = curve(y_)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def line_crossing(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column]:
    """Where two lines through (x1, y1, x2, y2) meet; null if parallel."""
    d = (a[0] - a[2]) * (b[1] - b[3]) - (a[1] - a[3]) * (b[0] - b[2])
    p, q = a[0] * a[3] - a[1] * a[2], b[0] * b[3] - b[1] * b[2]
    some = F.abs(d) > 1e-9
    return F.when(some, (p * (b[0] - b[2]) - (a[0] - a[2]) * q) / d), F.when(some, (p * (b[1] - b[3]) - (a[1] - a[3]) * q) / d)


def clip_window(ts: Column, pre: float = 5.0, post: float = 30.0) -> tuple[Column, Column]:
    """Start, not before 0, and duration, which isn't shortened."""
    return F.greatest(F.lit(0.0), ts - pre), F.lit(pre + post)


def harvest_window(duration: Column, clip: float = 10.0, frac: float = 0.6, draw: Column | None = None) -> tuple[Column, Column]:
    """Start and end of a clip around frac of a video, or with draw (0..1) at random off its ends; within the video."""
    length = F.least(F.lit(clip), duration)
    start = F.greatest(F.lit(0.0), duration * frac - length / 2)
    if draw is not None:
        start = F.when(duration > 2 * length, length + draw * (duration - 3 * length)).otherwise(start)
    start = F.greatest(F.lit(0.0), F.least(start, duration - length))
    return start, start + length


def sample_interval(native: Column, target: Column) -> Column:
    """Frames from one sample to the next, halves to even, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.bround(native / target).cast("long"))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)
