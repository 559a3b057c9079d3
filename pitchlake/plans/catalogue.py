"""One query per operator over the driver's tables, each with its SQL where that can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as lab
from ..operators import detect, harvest, identity, matching, metrics, review, sequence, tracklets
from ..session import load
from ..sources import documents
from .adapters import ctes, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
H = [0.03, 0.001, -1.0, 0.0005, 0.035, -0.5, 0.00001, 0.00002, 1.0]
HULL = [(100.0, 100.0), (1800.0, 150.0), (1700.0, 950.0), (200.0, 900.0)]
LIMIT = 60.0  # still within this many units: the made-up samples jump about


def query(sql: str | None = None):
    """Registers a query under its name; {a,b} at the head of sql names the views that it uses."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            m = re.match(r"\s*\{([\w,]*)\}", sql)
            body = sql[m.end() :] if m else sql
            head = ctes(*m[1].split(",")) if m and m[1] else ""
            ORACLES[f.__name__] = f"{head}{body}"
        return f

    return put


def v(spark, sf, name):
    return view(spark, sf, name)


# -- sources and projections --------------------------------------------------


@query("{samples} SELECT match_id, frame, ts_ms FROM samples WHERE frame >= 3 AND (frame - 3) % 5 = 0")
def strided_sample(spark, sf):
    return documents.sampled(v(spark, sf, "samples"), "frame", 5, 3).select("match_id", "frame", "ts_ms")


@query("SELECT p_partkey, greatest(1, CAST(round_even(p_size / 4.0, 0) AS BIGINT)) AS step FROM part")
def sample_interval(spark, sf):
    return load(spark, sf, "part").select("p_partkey", g.sample_interval(F.col("p_size"), F.lit(4.0)).alias("step"))


@query("{boxes} SELECT frame, det, class_id FROM boxes WHERE class_id IN (1, 3)")
def class_filter(spark, sf):
    return metrics.of_class(v(spark, sf, "boxes"), 1, 3).select("frame", "det", "class_id")


@query("{boxes} SELECT frame, det, conf FROM boxes WHERE conf >= 0.25")
def confidence_filter(spark, sf):
    return v(spark, sf, "boxes").where(g.over_threshold(F.col("conf"), None, 0.25)).select("frame", "det", "conf")


@query("{boxes} SELECT frame, det FROM boxes WHERE conf >= CASE frame % 3 WHEN 1 THEN 0.7::DOUBLE ELSE 0.25::DOUBLE END")
def confidence_default(spark, sf):
    # a third of the rows is given 0, a third nothing
    given = F.when(F.col("frame") % 3 == 0, 0.0).when(F.col("frame") % 3 == 1, 0.7)
    return v(spark, sf, "boxes").where(g.over_threshold(F.col("conf"), given, 0.25)).select("frame", "det")


@query("{boxes} SELECT frame, det, conf FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, det) AS rn FROM boxes WHERE class_id = 0) WHERE rn = 1")
def best_ball(spark, sf):
    return metrics.best_ball(v(spark, sf, "boxes").where("class_id = 0").select("frame", "det", "conf"), ["frame"], "conf", "det")


@query("{samples} SELECT match_id, frame, CASE WHEN fy BETWEEN 0 AND 36 THEN CASE WHEN fx BETWEEN 0 AND 5.5 THEN 'left' WHEN fx BETWEEN 49.5 AND 55 THEN 'right' END END AS zone FROM samples")
def goal_zone(spark, sf):
    return v(spark, sf, "samples").select("match_id", "frame", g.goal_zone(F.col("fx"), F.col("fy")).alias("zone"))


_CORNER = "least(sqrt(fx*fx + fy*fy), sqrt((fx-55)*(fx-55) + fy*fy), sqrt(fx*fx + (fy-36)*(fy-36)), sqrt((fx-55)*(fx-55) + (fy-36)*(fy-36))) <= 2"


@query(f"{{samples}} SELECT match_id, frame, {_CORNER} AS corner FROM samples")
def corner_zone(spark, sf):
    return v(spark, sf, "samples").select("match_id", "frame", g.in_corner(F.col("fx"), F.col("fy")).alias("corner"))


@query("{samples} SELECT match_id, frame, fy <= 2 OR fy >= 34 AS touch FROM samples")
def touchline(spark, sf):
    return v(spark, sf, "samples").select("match_id", "frame", g.on_touchline(F.col("fx"), F.col("fy")).alias("touch"))


@query("{dated} SELECT frame, label, CASE WHEN label IN ('goal_kick','corner_kick','throw_in','free_kick','kickoff','penalty','substitution','halftime') THEN 'dead_ball' ELSE 'in_play' END AS phase FROM dated")
def phase(spark, sf):
    return v(spark, sf, "dated").select("frame", "label", lab.phase(F.col("label")).alias("phase"))


_SAID = {"ECONOMY": "Kick-Off", "SMALL": "Shots on target", "STANDARD": "Weird Thing"}


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'kickoff' WHEN 'SMALL' THEN 'shot' WHEN 'STANDARD' THEN 'weird_thing' ELSE replace(lower(p_name), ' ', '_') END AS label FROM part""")
def label_map(spark, sf):
    said = F.coalesce(F.element_at(lab.mapping(_SAID), F.col("p_type")), F.col("p_name"))
    return load(spark, sf, "part").select("p_partkey", lab.map_label(said).alias("label"))


@query("{dated} SELECT label, count(*) AS n FROM dated WHERE label IN ('goal_kick','corner_kick','throw_in','free_kick','kickoff','penalty','goal','shot','foul','tackle','clearance','ball_out','offside','substitution','yellow_card','red_card','halftime') GROUP BY label")
def valid_labels(spark, sf):
    return v(spark, sf, "dated").where(lab.is_label(F.col("label"))).groupBy("label").agg(F.count("*").alias("n"))


@query("{boxes} SELECT frame, det, (x1 + x2) / 2 AS foot_x, y2 AS foot_y, (y1 + y2) / 2 AS mid_y FROM boxes")
def foot_point(spark, sf):
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    (fx, fy), (_, my) = g.foot_point(*b), g.box_centre(*b)
    return v(spark, sf, "boxes").select("frame", "det", fx.alias("foot_x"), fy.alias("foot_y"), my.alias("mid_y"))


_PX = f"(({H[0]} * x + {H[1]} * y + {H[2]}) / ({H[6]:f} * x + {H[7]:f} * y + 1))"
_PY = f"(({H[3]} * x + {H[4]} * y + {H[5]}) / ({H[6]:f} * x + {H[7]:f} * y + 1))"
_FEET = "feet AS (SELECT frame, det, (x1 + x2) / 2 AS x, y2 AS y FROM boxes)"


def _projected(spark, sf):
    x, y = g.foot_point(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    px, py = g.project(x, y, H)
    return v(spark, sf, "boxes").select("frame", "det", x.alias("x"), y.alias("y"), px.alias("px"), py.alias("py"))


@query(f"{{boxes}}, {_FEET} SELECT frame, det, round({_PX}, 6) AS fx, round({_PY}, 6) AS fy FROM feet")
def project_homography(spark, sf):
    return _projected(spark, sf).select("frame", "det", F.round("px", 6).alias("fx"), F.round("py", 6).alias("fy"))


@query(f"{{boxes}}, {_FEET} SELECT frame, det FROM feet WHERE {_PX} BETWEEN -3 AND 58 AND {_PY} BETWEEN -3 AND 39")
def field_filter(spark, sf):
    return _projected(spark, sf).where(g.on_field(F.col("px"), F.col("py"))).select("frame", "det")


@query(f"{{boxes}}, {_FEET} SELECT frame, det FROM feet WHERE x BETWEEN 288 AND 1632 AND y BETWEEN 162 AND 918")
def hull_filter(spark, sf):
    return _projected(spark, sf).where(g.in_central_part(F.col("x"), F.col("y"), 1920, 1080)).select("frame", "det")


@query(f"{{boxes}}, {_FEET} SELECT frame, det FROM feet WHERE CASE WHEN frame % 2 = 0 THEN {_PX} BETWEEN -3 AND 58 AND {_PY} BETWEEN -3 AND 39 ELSE x BETWEEN 288 AND 1632 AND y BETWEEN 162 AND 918 END")
def spectator_switch(spark, sf):
    inside = g.kept_person(F.col("frame") % 2 == 0, (F.col("px"), F.col("py")), (F.col("x"), F.col("y")))
    return _projected(spark, sf).where(inside).select("frame", "det")


def _hull_sql() -> str:
    """Distance to the nearest point of the border: inside if the foot lies left of every side."""
    far, left = [], []
    for (ax, ay), (bx, by) in zip(HULL, HULL[1:] + HULL[:1], strict=True):
        t = f"greatest(0, least(1, ((x - {ax}) * {bx - ax} + (y - {ay}) * {by - ay}) / {(bx - ax) ** 2 + (by - ay) ** 2}::DOUBLE))"
        far.append(f"sqrt(power(x - {ax} - {t} * ({bx - ax}), 2) + power(y - {ay} - {t} * ({by - ay}), 2))")
        left.append(f"({bx - ax}) * (y - {ay}) >= ({by - ay}) * (x - {ax})")
    return f"CASE WHEN {' AND '.join(left)} THEN 1 ELSE -1 END * least({', '.join(far)})"


@query(f"{{boxes}}, {_FEET} SELECT frame, det FROM feet WHERE {_hull_sql()} >= -20")
def turf_gate(spark, sf):
    return _projected(spark, sf).where(g.hull_distance(F.col("x"), F.col("y"), HULL) >= -20).select("frame", "det")


@query("""{boxes}, a AS (SELECT *, greatest(0, x1 - floor((x2 - x1) * 0.0625)) AS l, greatest(0, y1 - floor((y2 - y1) * 0.0625)) AS t FROM boxes)
SELECT frame, det, CAST(trunc(l / 3.0) AS BIGINT) AS rx1, CAST(trunc(t / (1080 / 352.0::DOUBLE)) AS BIGINT) AS ry1,
 CAST(trunc(least(1920, l + (x2 - x1) * 1.125::DOUBLE) / 3.0) AS BIGINT) AS rx2, CAST(trunc(least(1080, t + (y2 - y1) * 1.125::DOUBLE) / (1080 / 352.0::DOUBLE)) AS BIGINT) AS ry2 FROM a""")
def roi_scale(spark, sf):
    r = g.roi_scaled(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return v(spark, sf, "boxes").select("frame", "det", *(c.alias(n) for c, n in zip(r, ("rx1", "ry1", "rx2", "ry2"), strict=True)))


@query("{samples} SELECT match_id, frame, greatest(0, least(CAST(trunc(px - 640) AS BIGINT), 640)) AS crop_x, greatest(0, least(CAST(trunc(py - 360) AS BIGINT), 360)) AS crop_y FROM samples")
def crop_rect(spark, sf):
    x, y = g.crop_rect(F.col("px"), F.col("py"), 1280, 720, 1920, 1080)
    return v(spark, sf, "samples").select("match_id", "frame", x.alias("crop_x"), y.alias("crop_y"))


def _part_sql(name: str, least: tuple[int, int], side: float, top: float, bottom: float, result: int) -> str:
    """A CTE with the corners of a part of each box, null where box or part is too small."""
    return f"""{name}_r AS (SELECT frame, det, x2 - x1 AS w, y2 - y1 AS h, greatest(0, CAST(round_even(x1 + (x2 - x1) * {side}::DOUBLE, 0) AS BIGINT)) AS a, greatest(0, CAST(round_even(y1 + (y2 - y1) * {top}::DOUBLE, 0) AS BIGINT)) AS b,
 least(1920, CAST(round_even(x2 - (x2 - x1) * {side}::DOUBLE, 0) AS BIGINT)) AS c, least(1080, CAST(round_even(y1 + (y2 - y1) * {bottom}::DOUBLE, 0) AS BIGINT)) AS d FROM sized),
{name} AS (SELECT frame, det, w >= {least[0]} AND h >= {least[1]} AND c - a >= {result} AND d - b >= {result} AS ok, a, b, c, d FROM {name}_r)"""


# boxes of all sizes, some beyond the frame
_SIZED = "sized AS (SELECT frame, det, x1 - 30 AS x1, y1 + 60 AS y1, x1 - 30 + (x2 - x1) / (1 + frame % 9) AS x2, y1 + 60 + (y2 - y1) / (1 + frame % 9) AS y2, conf FROM boxes)"
_TORSO, _NUMBER = _part_sql("torso", (4, 8), 0.2, 0.2, 0.55, 2), _part_sql("num", (12, 24), 0.1, 0.0, 0.55, 8)


def _sized(spark, sf):
    b, k = v(spark, sf, "boxes"), 1 + F.col("frame") % 9
    x, y = F.col("x1") - 30, F.col("y1") + 60
    return b.select("frame", "det", x.alias("x1"), y.alias("y1"), (x + (F.col("x2") - F.col("x1")) / k).alias("x2"), (y + (F.col("y2") - F.col("y1")) / k).alias("y2"), "conf")


@query(f"{{boxes}}, {_SIZED}, {_TORSO}, {_NUMBER} SELECT t.frame, t.det, CASE WHEN t.ok THEN t.a END AS tx1, CASE WHEN t.ok THEN t.b END AS ty1, CASE WHEN t.ok THEN t.c END AS tx2, CASE WHEN t.ok THEN t.d END AS ty2, CASE WHEN n.ok THEN n.a END AS nx1, CASE WHEN n.ok THEN n.b END AS ny1, CASE WHEN n.ok THEN n.c END AS nx2, CASE WHEN n.ok THEN n.d END AS ny2 FROM torso t JOIN num n USING (frame, det)")
def torso_rect(spark, sf):
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    parts = zip((*g.torso_rect(*b), *g.number_rect(*b)), ("tx1", "ty1", "tx2", "ty2", "nx1", "ny1", "nx2", "ny2"), strict=True)
    return _sized(spark, sf).select("frame", "det", *(c.alias(n) for c, n in parts))


@query(f"{{boxes}}, {_SIZED}, {_NUMBER} SELECT n.frame, n.det FROM num n JOIN sized s USING (frame, det) WHERE n.ok AND c - a >= 16 AND d - b >= 16 AND s.conf * 40 >= 18")
def legibility(spark, sf):
    n = g.number_rect(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return _sized(spark, sf).where(g.legible(n[2] - n[0], n[3] - n[1], F.col("conf") * 40)).select("frame", "det")


_FRAMES = "640 + p_size * 20 AS fw, 360 + p_partkey % 50 * 10 AS fh"


@query(f"SELECT p_partkey, CASE WHEN fw * 720 > fh * 1280 THEN CAST(trunc(fh * 1280 / 720) AS BIGINT) ELSE fw END AS w, CASE WHEN fw * 720 > fh * 1280 THEN fh ELSE CAST(trunc(fw * 720 / 1280) AS BIGINT) END AS h FROM (SELECT p_partkey, {_FRAMES} FROM part)")
def crop_fit(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", (640 + F.col("p_size") * 20).cast("long").alias("fw"), (360 + F.col("p_partkey") % 50 * 10).alias("fh"))
    w, h = g.crop_fit(F.col("fw"), F.col("fh"), 1280, 720)
    return p.select("p_partkey", w.alias("w"), h.alias("h"))


@query("{samples} SELECT match_id, frame, CASE WHEN frame % 3 <> 0 THEN CASE WHEN fy BETWEEN 0 AND 36 THEN CASE WHEN fx BETWEEN 0 AND 5.5 THEN 'left' WHEN fx BETWEEN 49.5 AND 55 THEN 'right' END END WHEN px < 100 THEN 'left' WHEN px > 400 THEN 'right' END AS zone FROM samples")
def zone_fallback(spark, sf):
    fx = F.when(F.col("frame") % 3 != 0, F.col("fx"))
    return v(spark, sf, "samples").select("match_id", "frame", g.zone_or_side(fx, F.col("fy"), F.col("px"), 500.0).alias("zone"))


@query("{candidates} SELECT id, CAST(i AS INTEGER) AS i, round(60 + greatest(0, duration - 135) * i / 4, 6) AS start_s FROM candidates CROSS JOIN range(5) r(i) WHERE duration IS NOT NULL")
def even_starts(spark, sf):
    c = v(spark, sf, "candidates").where("duration is not null")
    return c.select("id", F.posexplode(g.even_starts(F.col("duration"), 5)).alias("i", "start_s")).withColumn("start_s", F.round("start_s", 6))


@query("{boxes} SELECT frame, det, coalesce(x1 * 2 - 900 BETWEEN -576 AND 2496 AND y1 * 2 - 500 BETWEEN -324 AND 1404 AND x2 * 2 BETWEEN -576 AND 2496 AND CASE WHEN frame % 5 <> 0 THEN y2 * 2 END BETWEEN -324 AND 1404, false) AS sane FROM boxes")
def corner_sanity(spark, sf):
    corners = [(F.col("x1") * 2 - 900, F.col("y1") * 2 - 500), (F.col("x2") * 2, F.when(F.col("frame") % 5 != 0, F.col("y2") * 2))]
    return v(spark, sf, "boxes").select("frame", "det", g.corners_sane(corners).alias("sane"))


@query("{dated} SELECT frame, greatest(0, ts - 5) AS start_s, 35.0::DOUBLE AS duration_s FROM dated")
def clip_windows(spark, sf):
    s, d = g.clip_window(F.col("ts"))
    return v(spark, sf, "dated").select("frame", s.alias("start_s"), d.alias("duration_s"))


@query("""{candidates}, w AS (SELECT id, duration, least(10.0::DOUBLE, duration) AS len FROM candidates WHERE duration IS NOT NULL),
s AS (SELECT id, len, greatest(0, least(greatest(0, duration * 0.6::DOUBLE - len / 2), duration - len)) AS a FROM w)
SELECT id, round(a, 6) AS start_s, round(a + len, 6) AS end_s FROM s""")
def clip_placement(spark, sf):
    a, b = g.harvest_window(F.col("duration"))
    return v(spark, sf, "candidates").where("duration is not null").select("id", F.round(a, 6).alias("start_s"), F.round(b, 6).alias("end_s"))


@query("{boxes} SELECT frame, det, round(CASE WHEN abs((x1 - x2) * (-4.0) - (y1 - y2) * 3.0) > 1e-9 THEN ((x1*y2 - y1*x2) * 3.0 - (x1 - x2) * 100.0) / ((x1 - x2) * (-4.0) - (y1 - y2) * 3.0) END, 6) AS cx FROM boxes")
def line_crossing(spark, sf):
    # the other line runs through (25, 0) and (22, 4)
    other = tuple(F.lit(x) for x in (25.0, 0.0, 22.0, 4.0))
    return v(spark, sf, "boxes").select("frame", "det", F.round(g.line_crossing(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), other)[0], 6).alias("cx"))


@query("""{class_scores}, e AS (SELECT slot, frame, unnest(scores) AS s, generate_subscripts(scores, 1) - 1 AS i FROM class_scores),
x AS (SELECT slot, frame, i, exp(s - max(s) OVER (PARTITION BY frame)) AS e FROM e),
p AS (SELECT slot, frame, i, e / sum(e) OVER (PARTITION BY frame) AS p, row_number() OVER (PARTITION BY frame ORDER BY e DESC, i) AS rn FROM x)
SELECT slot, frame, CAST(i AS INTEGER) AS cls, round(p, 6) AS score FROM p WHERE rn = 1""")
def softmax_class(spark, sf):
    return _class_rows(spark, sf).select("slot", "frame", "cls", F.round("score", 6).alias("score"))


def _class_rows(spark, sf):
    c = v(spark, sf, "class_scores").withColumn("p", g.softmax(F.col("scores")))
    cls, score = tracklets.best_class(F.col("p"))
    return c.select("slot", "frame", cls.alias("cls"), score.alias("score"))


# -- windows ------------------------------------------------------------------

_STILL = f"""still AS (SELECT *, count(*) OVER w >= 3 AND sqrt(power(max(px) OVER w - min(px) OVER w, 2) + power(max(py) OVER w - min(py) OVER w, 2)) < {LIMIT} AS still FROM samples
 WINDOW w AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query(f"{{samples}}, {_STILL} SELECT match_id, frame, still FROM still")
def trailing_stationary(spark, sf):
    return sequence.trailing_still(v(spark, sf, "samples"), ["match_id"], "frame", "px", "py", 3, LIMIT).select("match_id", "frame", "still")


@query(f"""{{samples}}, r AS (SELECT *, sum(CASE WHEN visible THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY frame) AS run FROM samples)
SELECT match_id, frame, visible AND count(*) OVER w >= 3 AND sqrt(power(max(px) OVER w - min(px) OVER w, 2) + power(max(py) OVER w - min(py) OVER w, 2)) < {LIMIT} AS still FROM r
WINDOW w AS (PARTITION BY match_id, run, visible ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def stationary_with_reset(spark, sf):
    return sequence.trailing_still_reset(v(spark, sf, "samples"), ["match_id"], "frame", "px", "py", F.col("visible"), 3, LIMIT).select("match_id", "frame", "still")


_DEAD = """r AS (SELECT *, sum(CASE WHEN visible THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY ts_ms) AS run FROM samples),
b AS (SELECT *, min(ts_ms) OVER (PARTITION BY match_id, run, visible) AS begun, count(*) OVER w AS n, sqrt(power(max(px) OVER w - min(px) OVER w, 2) + power(max(py) OVER w - min(py) OVER w, 2)) AS spread FROM r
 WINDOW w AS (PARTITION BY match_id, run, visible ORDER BY ts_ms RANGE BETWEEN 400 PRECEDING AND CURRENT ROW)),
dead AS (SELECT match_id, frame, ts_ms, CASE WHEN NOT visible THEN 'offscreen' WHEN ts_ms - begun >= 400 AND n >= 2 AND spread < 150 THEN 'stationary' END AS dead FROM b)"""


def _dead(spark, sf):
    return sequence.dead_labels(v(spark, sf, "samples"), ["match_id"], window_ms=400, limit=150.0)


@query(f"{{samples}}, {_DEAD} SELECT match_id, frame, dead FROM dead")
def dead_labels(spark, sf):
    return _dead(spark, sf).select("match_id", "frame", "dead")


_SEGMENTS = f"""{_DEAD},
i AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms) - row_number() OVER (PARTITION BY match_id, dead IS NULL ORDER BY ts_ms) AS isl FROM dead),
seg AS (SELECT match_id, min(ts_ms) + 50 AS start_ms, max(ts_ms) - 50 AS end_ms, CASE WHEN min(dead) = max(dead) THEN min(dead) ELSE 'mixed' END AS reason
 FROM i WHERE dead IS NOT NULL GROUP BY match_id, isl HAVING max(ts_ms) - min(ts_ms) >= 600),
tot AS (SELECT match_id, max(ts_ms) AS total_ms FROM samples GROUP BY match_id)"""


def _plan(spark, sf):
    return detect.trim_plan(v(spark, sf, "samples"), ["match_id"], min_ms=600, pad_ms=50, window_ms=400, limit=150.0)


@query(f"{{samples}}, {_SEGMENTS} SELECT match_id, start_ms, end_ms, reason FROM seg")
def removed_segments(spark, sf):
    return _plan(spark, sf).removed


@query(f"""{{samples}}, {_SEGMENTS}, pts AS (SELECT match_id, start_ms, end_ms FROM seg UNION ALL SELECT match_id, total_ms, total_ms FROM tot),
gaps AS (SELECT match_id, start_ms AS s, coalesce(max(end_ms) OVER (PARTITION BY match_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM pts)
SELECT match_id, f AS start_ms, s AS end_ms FROM gaps WHERE s > f""")
def keep_segments(spark, sf):
    return _plan(spark, sf).kept


@query(f"""{{samples}}, {_SEGMENTS}, c AS (SELECT match_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS removed_ms, count(*) AS cuts FROM seg GROUP BY match_id)
SELECT tot.match_id, total_ms, coalesce(removed_ms, 0) AS removed_ms, coalesce(cuts, 0) AS cuts, total_ms - coalesce(removed_ms, 0) AS kept_ms, round(coalesce(removed_ms, 0) * 100.0::DOUBLE / total_ms, 1) AS removed_pct FROM tot LEFT JOIN c USING (match_id)""")
def trim_plan(spark, sf):
    return _plan(spark, sf).totals


# -- detectors ----------------------------------------------------------------


def _greedy(name: str, where: str, label: str, gap: int = 5000) -> str:
    """CTEs that take candidates of still samples greedily; name has the rows."""
    return f"""{name}_c AS (SELECT match_id, frame, ts_ms FROM still WHERE still AND ({where})),
{name}_r(match_id, ts_ms) AS (SELECT match_id, min(ts_ms) FROM {name}_c GROUP BY match_id UNION ALL
 SELECT r.match_id, (SELECT min(c.ts_ms) FROM {name}_c c WHERE c.match_id = r.match_id AND c.ts_ms >= r.ts_ms + {gap}) FROM {name}_r r WHERE r.ts_ms IS NOT NULL),
{name} AS (SELECT c.match_id, c.frame, c.ts_ms, '{label}' AS label FROM {name}_c c JOIN {name}_r r ON r.match_id = c.match_id AND r.ts_ms = c.ts_ms)"""


_ZONE = "fy BETWEEN 0 AND 36 AND (fx BETWEEN 0 AND 5.5 OR fx BETWEEN 49.5 AND 55)"
_GK, _CK = _greedy("gk", _ZONE, "goal_kick"), _greedy("ck", _CORNER, "corner_kick")
_TI = _greedy("ti", f"(fy <= 2 OR fy >= 34) AND NOT {_CORNER}", "throw_in")
_EVENT = ("match_id", "frame", "ts_ms", "label")


def _detected(spark, sf, detector):
    return detector(v(spark, sf, "samples"), ["match_id"], limit=LIMIT)


@query(f"{{samples}}, {_STILL}, {_GK} SELECT match_id, frame, ts_ms, label FROM gk")
def goal_kicks(spark, sf):
    return _detected(spark, sf, detect.goal_kicks).select(*_EVENT)


@query(f"{{samples}}, {_STILL}, {_CK} SELECT match_id, frame, ts_ms, label FROM ck")
def corner_kicks(spark, sf):
    return _detected(spark, sf, detect.corner_kicks).select(*_EVENT)


@query(f"{{samples}}, {_STILL}, {_TI} SELECT match_id, frame, ts_ms, label FROM ti")
def throw_ins(spark, sf):
    return _detected(spark, sf, detect.throw_ins).select(*_EVENT)


_ALL = f"{_STILL}, {_GK}, {_CK}, {_TI}, pieces AS (SELECT * FROM gk UNION ALL SELECT * FROM ck UNION ALL SELECT * FROM ti)"


@query(f"{{samples}}, {_ALL} SELECT match_id, frame, ts_ms, label, 'dead_ball' AS phase, 'rules' AS source FROM pieces")
def all_set_pieces(spark, sf):
    context = detect.Context(v(spark, sf, "samples"), config={"limit": LIMIT})
    return detect.default_registry().run(context, ["heuristic", "learned", "unknown"]).select(*_EVENT, "phase", "source")


_NEAR = f"""{_ALL}, pe AS (SELECT p.*, s.fx, s.fy, concat(p.label, '-', CAST(p.frame AS VARCHAR)) AS event_id FROM pieces p JOIN samples s USING (match_id, frame)),
turn(t, d) AS (VALUES (0,0),(1,1),(2,-1),(3,2),(4,-2),(5,3),(6,-3)),
cand AS (SELECT e.event_id, t, sqrt(power(pl.fx - e.fx, 2) + power(pl.fy - e.fy, 2)) AS dist, pl.track, row_number() OVER (PARTITION BY e.event_id ORDER BY t, sqrt(power(pl.fx - e.fx, 2) + power(pl.fy - e.fy, 2)), pl.track) AS rn
 FROM pe e CROSS JOIN turn JOIN players pl ON pl.frame = e.frame + d),
near AS (SELECT pe.event_id, pe.match_id, pe.frame, pe.ts_ms, pe.label, c.track, c.dist FROM pe LEFT JOIN cand c ON c.event_id = pe.event_id AND c.rn = 1 AND c.dist <= 5),
att AS (SELECT near.*, tm.team FROM near LEFT JOIN teams tm USING (track))"""


def attributed(spark, sf):
    """Set pieces with the nearest player's track and team."""
    e = _detected(spark, sf, detect.set_pieces).withColumn("event_id", F.concat_ws("-", "label", F.col("frame").cast("string")))
    near = matching.nearest_in_frames(e, v(spark, sf, "players"), [], "event_id", pixel=None)
    return matching.lookup(near, v(spark, sf, "teams"), "track", "team")


@query(f"{{samples,players,teams}}, {_NEAR} SELECT event_id, match_id, track, team, round(dist, 6) AS distance FROM att")
def associate_nearest(spark, sf):
    return attributed(spark, sf).select("event_id", "match_id", "track", "team", F.round("distance", 6).alias("distance"))


@query(f"{{samples,players,teams}}, {_NEAR} SELECT event_id, team FROM att WHERE lower(coalesce(team, '')) = 'nation_9' AND label = 'goal_kick'")
def event_filter_team(spark, sf):
    return matching.event_filter(attributed(spark, sf), label="goal_kick", team="Nation_9").select("event_id", "team")


@query(f"{{samples,players,teams}}, {_NEAR} SELECT event_id, track FROM att WHERE track IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) OR track = 5")
def event_filter_lanes(spark, sf):
    lanes = load(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("track"))
    return matching.event_filter(attributed(spark, sf), track=5, lanes=lanes).select("event_id", "track")


@query(f"""{{samples,players,teams}}, {_NEAR} SELECT event_id, match_id, label, team, track, greatest(0, ts_ms / 1000.0::DOUBLE - 5) AS start_s, 35.0::DOUBLE AS duration_s FROM att""")
def cut_list(spark, sf):
    s, d = g.clip_window(F.col("ts_ms") / 1000.0)
    return attributed(spark, sf).select("event_id", "match_id", "label", "team", "track", s.alias("start_s"), d.alias("duration_s"))


@query(f"{{samples,players,teams}}, {_NEAR} SELECT label, coalesce(team, 'unknown') AS team, count(*) AS n FROM att GROUP BY GROUPING SETS ((label, coalesce(team, 'unknown')), (label), ())")
def stats_rollup(spark, sf):
    return metrics.rollup_counts(attributed(spark, sf))


@query("{dated} SELECT frame, label FROM dated WHERE label IN ('shot', 'throw_in')")
def label_list(spark, sf):
    return matching.event_filter(v(spark, sf, "dated"), label=["shot", "throw_in", "halftime"]).select("frame", "label")


@query("{dated} SELECT frame, track FROM dated WHERE label = 'shot'")
def shot_filter(spark, sf):
    return matching.event_filter(v(spark, sf, "dated"), label="shot").select("frame", "track")


@query("{samples} SELECT match_id, frame FROM samples WHERE frame IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def frame_list(spark, sf):
    wanted = load(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("frame"))
    return matching.by_frames(v(spark, sf, "samples"), wanted).select("match_id", "frame")


# -- metrics ------------------------------------------------------------------

_POSS = """c AS (SELECT b.frame, sqrt(power(p.fx - b.fx, 2) + power(p.fy - b.fy, 2)) AS d, p.track FROM samples b JOIN players p ON p.frame = b.frame),
near AS (SELECT frame, d, track FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY d, track) AS rn FROM c) WHERE rn = 1 AND d <= 12)"""


def _near(spark, sf):
    return matching.nearest_player(v(spark, sf, "samples"), v(spark, sf, "players"), ["frame"], most=12.0)


@query(f"{{samples,players,teams}}, {_POSS}, t AS (SELECT team, count(*) AS frames FROM near JOIN teams USING (track) GROUP BY team) SELECT team, frames, round(frames * 100.0::DOUBLE / sum(frames) OVER (), 1) AS pct FROM t")
def possession(spark, sf):
    return metrics.possession(_near(spark, sf), v(spark, sf, "teams"))


@query(f"""{{samples,players}}, {_POSS}, n AS (SELECT s.match_id, near.*, CASE WHEN lag(track) OVER w = track AND frame - lag(frame) OVER w <= 50 THEN 0 ELSE 1 END AS new FROM near JOIN samples s USING (frame) WINDOW w AS (PARTITION BY s.match_id ORDER BY frame)),
r AS (SELECT *, sum(new) OVER (PARTITION BY match_id ORDER BY frame) AS run FROM n) SELECT match_id, track, min(frame) AS "start", max(frame) AS "end", count(*) AS frames FROM r GROUP BY match_id, run, track HAVING count(*) >= 1""")
def touches(spark, sf):
    n = _near(spark, sf).join(v(spark, sf, "samples").select("frame", "match_id"), "frame")
    return metrics.touches(n, ["match_id"], "frame", least=1, step=50)


_STEP = "s AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step, lag(idx) OVER w AS pidx FROM trajectory WINDOW w AS (PARTITION BY track ORDER BY idx))"


@query(f"{{trajectory}}, {_STEP} SELECT track, round(coalesce(sum(step), 0), 4) AS distance FROM s GROUP BY track")
def distance(spark, sf):
    return metrics.distance(v(spark, sf, "trajectory"), ["track"], "idx", "x", "y").withColumn("distance", F.round("distance", 4))


@query(f"""{{trajectory}}, {_STEP}, r AS (SELECT *, coalesce(step * 10 > 100, false) AS fast, sum(CASE WHEN coalesce(step * 10 > 100, false) THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY idx) AS run FROM s)
SELECT track, min(pidx) AS "start", max(idx) AS "end", count(*) + 1 AS positions FROM r WHERE fast GROUP BY track, run HAVING count(*) + 1 >= 5""")
def sprints(spark, sf):
    return metrics.sprints(v(spark, sf, "trajectory"), ["track"], "idx", "x", "y", speed=100.0, seconds=0.5)


@query(f"""{{trajectory}}, {_STEP} SELECT track, idx FROM s WHERE step * 10 >= 8 AND ((dx < 0 AND x < 16.5) OR (dx > 0 AND x > 38.5)) AND y BETWEEN 15.5 AND 20.5""")
def shots(spark, sf):
    return metrics.shots(v(spark, sf, "trajectory"), ["track"], "idx", "x", "y").where("shot").select("track", "idx")


@query("""{trajectory} SELECT track, idx, round(coalesce((x - lag(x) OVER w) / greatest(1, idx - lag(idx) OVER w), 0), 6) AS vx, round(coalesce((y - lag(y) OVER w) / greatest(1, idx - lag(idx) OVER w), 0), 6) AS vy FROM trajectory WINDOW w AS (PARTITION BY track ORDER BY idx)""")
def velocity(spark, sf):
    return metrics.velocity(v(spark, sf, "trajectory"), ["track"], "idx", "x", "y").select("track", "idx", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


@query("""{trajectory}, c AS (SELECT CAST(least(19, floor(x / 55 * 20)) AS INTEGER) AS bin_x, CAST(least(19, floor(y / 36 * 20)) AS INTEGER) AS bin_y, count(*) AS n FROM trajectory WHERE x BETWEEN 0 AND 55 AND y BETWEEN 0 AND 36 GROUP BY 1, 2),
grid AS (SELECT CAST(a.i AS INTEGER) AS bin_x, CAST(b.i AS INTEGER) AS bin_y FROM range(20) a(i), range(20) b(i)) SELECT bin_x, bin_y, coalesce(n, 0) AS n FROM grid LEFT JOIN c USING (bin_x, bin_y)""")
def heatmap(spark, sf):
    return metrics.histogram(v(spark, sf, "trajectory"), "x", "y")


@query("{boxes} SELECT frame, round(coalesce(avg(CASE WHEN class_id = 0 THEN (x1 + x2) / 2 END), avg(CASE WHEN class_id IN (1, 3) THEN (x1 + x2) / 2 END)), 6) AS cx, round(coalesce(avg(CASE WHEN class_id = 0 THEN (y1 + y2) / 2 END), avg(CASE WHEN class_id IN (1, 3) THEN (y1 + y2) / 2 END)), 6) AS cy FROM boxes GROUP BY frame")
def action_centroid(spark, sf):
    x, y = g.box_centre(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return metrics.centroid(v(spark, sf, "boxes"), ["frame"], "class_id", x, y).select("frame", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("""{samples}, o AS (SELECT match_id, frame, CASE WHEN visible THEN px END AS t, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS rn FROM samples),
e(match_id, rn, frame, s) AS (SELECT match_id, rn, frame, CASE WHEN t IS NULL THEN 250.0::DOUBLE ELSE 250.0::DOUBLE + (t - 250.0::DOUBLE) * 0.3::DOUBLE END FROM o WHERE rn = 1 UNION ALL
 SELECT o.match_id, o.rn, o.frame, CASE WHEN o.t IS NULL THEN e.s ELSE e.s + (o.t - e.s) * 0.3::DOUBLE END FROM e JOIN o ON o.match_id = e.match_id AND o.rn = e.rn + 1)
SELECT match_id, frame, round(s, 4) AS smooth FROM e""")
def ema_camera(spark, sf):
    s = v(spark, sf, "samples").withColumn("t", F.when(F.col("visible"), F.col("px")))
    return sequence.ema(s, ["match_id"], "frame", "t", 250.0, 0.3).select("match_id", "frame", F.round("smooth", 4).alias("smooth"))


#: The filter row by row over the seen samples: b is the state to start from (a new one after a gap), m the predicted one, u what measuring tells.
_KALMAN = """d AS (SELECT *, greatest(0, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY match_id ORDER BY ts_ms), 0)) / 1000.0::DOUBLE AS d FROM samples),
o AS (SELECT match_id, ts_ms, px AS rx, py AS ry, d, row_number() OVER (PARTITION BY match_id ORDER BY ts_ms) AS rn FROM d WHERE visible AND px IS NOT NULL),
k(match_id, rn, ts_ms, x, y, vx, vy, p, c, v, rejects, outlier) AS (
 SELECT match_id, rn, ts_ms, rx, ry, 0::DOUBLE, 0::DOUBLE, 64::DOUBLE, 0::DOUBLE, 1e6::DOUBLE, 0, false FROM o WHERE rn = 1 UNION ALL
 SELECT match_id, rn, ts_ms, CASE WHEN NOT bad THEN mx + mp / n * ex WHEN lost THEN rx ELSE mx END, CASE WHEN NOT bad THEN my + mp / n * ey WHEN lost THEN ry ELSE my END,
  CASE WHEN NOT bad THEN vx + mc / n * ex WHEN lost THEN 0 ELSE vx END, CASE WHEN NOT bad THEN vy + mc / n * ey WHEN lost THEN 0 ELSE vy END,
  CASE WHEN NOT bad THEN mp * (1 - mp / n) WHEN lost THEN 64 ELSE mp END, CASE WHEN NOT bad THEN mc * (1 - mp / n) WHEN lost THEN 0 ELSE mc END, CASE WHEN NOT bad THEN mv - mc / n * mc WHEN lost THEN 1e6 ELSE mv END,
  CASE WHEN bad AND NOT lost THEN rejects + 1 ELSE 0 END, bad AND NOT lost
 FROM (SELECT *, mp + 64 AS n, (ex * ex + ey * ey) / (mp + 64) > 9.21::DOUBLE AS bad, rejects + 1 >= 3 AS lost
  FROM (SELECT *, rx - mx AS ex, ry - my AS ey
   FROM (SELECT match_id, rn, ts_ms, rx, ry, vx, vy, rejects, x + d * vx AS mx, y + d * vy AS my, p + 2 * d * c + d * d * v + 90000 * d * d * d * d / 4 AS mp, c + d * v + 90000 * d * d * d / 2 AS mc, v + 90000 * d * d AS mv
    FROM (SELECT o.match_id, o.rn, o.ts_ms, o.rx, o.ry, o.d, CASE WHEN s THEN o.rx ELSE k.x END AS x, CASE WHEN s THEN o.ry ELSE k.y END AS y, CASE WHEN s THEN 0 ELSE k.vx END AS vx, CASE WHEN s THEN 0 ELSE k.vy END AS vy,
      CASE WHEN s THEN 64 ELSE k.p END AS p, CASE WHEN s THEN 0 ELSE k.c END AS c, CASE WHEN s THEN 1e6 ELSE k.v END AS v, CASE WHEN s THEN 0 ELSE k.rejects END AS rejects
     FROM k JOIN (SELECT *, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY match_id ORDER BY rn) > 1000, false) AS s FROM o) o ON o.match_id = k.match_id AND o.rn = k.rn + 1) b) m) e) u)"""


@query(f"""{{samples}}, {_KALMAN} SELECT s.match_id, s.ts_ms, round(CASE WHEN k.rn IS NULL THEN s.px ELSE k.x END, 1) + 0 AS x, round(CASE WHEN k.rn IS NULL THEN s.py ELSE k.y END, 1) + 0 AS y,
 CASE WHEN k.rn IS NOT NULL THEN s.px END AS raw_x, CASE WHEN k.rn IS NOT NULL THEN s.py END AS raw_y, k.rn IS NOT NULL AS smoothed, coalesce(k.outlier, false) AS outlier FROM samples s LEFT JOIN k ON k.match_id = s.match_id AND k.ts_ms = s.ts_ms""")
def kalman_smooth(spark, sf):
    k = sequence.kalman(v(spark, sf, "samples"), ["match_id"])
    return k.select("match_id", "ts_ms", (F.round("px", 1) + 0.0).alias("x"), (F.round("py", 1) + 0.0).alias("y"), "raw_x", "raw_y", "smoothed", "outlier")


@query("""{samples}, b AS (SELECT match_id, frame, CASE WHEN frame % 3 <> 0 THEN px END AS val FROM samples WHERE visible),
r(match_id, frame) AS (SELECT match_id, min(frame) FROM b GROUP BY match_id UNION ALL SELECT r.match_id, (SELECT min(b.frame) FROM b WHERE b.match_id = r.match_id AND b.frame >= r.frame + 150) FROM r WHERE r.frame IS NOT NULL)
SELECT b.match_id, b.frame, r.frame IS NOT NULL AS attempt, last_value(CASE WHEN r.frame IS NOT NULL THEN val END IGNORE NULLS) OVER (PARTITION BY b.match_id ORDER BY b.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current FROM b LEFT JOIN r ON r.match_id = b.match_id AND r.frame = b.frame""")
def homography_schedule(spark, sf):
    b = v(spark, sf, "samples").where("visible").select("match_id", "frame", F.when(F.col("frame") % 3 != 0, F.col("px")).alias("val"))
    return sequence.registered(b, ["match_id"], "frame", "val", 150).select("match_id", "frame", "attempt", "current")


@query("""{samples}, t AS (SELECT match_id, max(frame) + 1 AS total FROM samples GROUP BY match_id) SELECT match_id, frame, frame < CASE WHEN match_id % 2 = 0 THEN total // 2 ELSE 777 END AS first FROM samples JOIN t USING (match_id)""")
def half_restriction(spark, sf):
    total = v(spark, sf, "samples").groupBy("match_id").agg((F.max("frame") + 1).alias("total"))
    s = v(spark, sf, "samples").select("match_id", "frame").join(total, "match_id")
    middle = F.when(F.col("match_id") % 2 == 0, 0).otherwise(777)
    parts = [sequence.half(s, "frame", which, F.col("total"), middle).select("match_id", "frame", F.lit(which == "first").alias("first")) for which in ("first", "second")]
    return parts[0].unionByName(parts[1])


@query("""{samples}, t AS (SELECT match_id, max(ts_ms) AS total_ms FROM samples GROUP BY match_id), w AS (SELECT match_id, unnest(range(0, total_ms, 10000)) AS start_ms FROM t WHERE total_ms > 0),
c AS (SELECT *, start_ms // 10000 % 10 / 10.0::DOUBLE AS confidence, CASE WHEN start_ms // 10000 % 3 <> 0 THEN 'shot' END AS label FROM w)
SELECT match_id, label, round((start_ms + 5000) / 1000.0::DOUBLE, 2) AS timestamp_s, start_ms + 5000 AS position_ms FROM c WHERE label IS NOT NULL AND confidence >= 0.6::DOUBLE""")
def spotter_confidence(spark, sf):
    w = sequence.sliding_windows(v(spark, sf, "samples").groupBy("match_id").agg(F.max("ts_ms").alias("total_ms")), ["match_id"])
    n = F.floor(F.col("start_ms") / 10000)
    w = w.withColumn("confidence", n % 10 / 10.0).withColumn("label", F.when(n % 3 != 0, "shot"))
    return sequence.spotted(w).select("match_id", "label", "timestamp_s", "position_ms")


@query("{samples}, t AS (SELECT match_id, max(ts_ms) AS total_ms FROM samples GROUP BY match_id) SELECT match_id, unnest(range(0, total_ms, 10000)) AS start_ms, unnest(range(0, total_ms, 10000)) + 10000 AS end_ms, unnest(range(0, total_ms, 10000)) + 5000 AS mid_ms FROM t WHERE total_ms > 0")
def spotter_windows(spark, sf):
    return sequence.sliding_windows(v(spark, sf, "samples").groupBy("match_id").agg(F.max("ts_ms").alias("total_ms")), ["match_id"])


@query("{samples} SELECT match_id, round(avg(CASE WHEN visible THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, count(DISTINCT frame) AS frames FROM samples GROUP BY match_id")
def coverage(spark, sf):
    return metrics.coverage(v(spark, sf, "samples"), ["match_id"]).withColumn("coverage", F.round("coverage", 6))


@query("{boxes}, f AS (SELECT frame, count(*) AS n, max(CASE WHEN class_id = 0 THEN 1 ELSE 0 END) AS ball FROM boxes GROUP BY frame) SELECT count(*) AS frames, round(avg(n), 6) AS mean_n, round(avg(ball), 6) AS with_ball FROM f")
def detection_summary(spark, sf):
    d = metrics.detection_summary(v(spark, sf, "boxes"))
    return d.select("frames", F.round("mean_n", 6).alias("mean_n"), F.round("with_ball", 6).alias("with_ball"))


@query("{players,teams} SELECT team, count(DISTINCT track) AS tracks FROM players JOIN teams USING (track) GROUP BY team")
def unique_tracks(spark, sf):
    return metrics.unique_tracks(v(spark, sf, "players").join(v(spark, sf, "teams"), "track"), ["team"])


@query("{samples} SELECT match_id, count(val) AS ok, count(*) AS total, round(count(val) / count(*), 6) AS rate, count(val) >= count(*) * 0.5 AS enough FROM (SELECT match_id, CASE WHEN frame % 7 < 4 AND visible THEN px END AS val FROM samples) GROUP BY match_id")
def registration_rate(spark, sf):
    s = v(spark, sf, "samples").withColumn("val", F.when((F.col("frame") % 7 < 4) & F.col("visible"), F.col("px")))
    return metrics.success_rate(s, ["match_id"], "val").withColumn("rate", F.round("rate", 6))


# -- identity -----------------------------------------------------------------

_VOTE = """per AS (SELECT track, number, count(*) AS n, sum(greatest(0, coalesce(conf, 0))) AS w FROM reads GROUP BY track, number),
rk AS (SELECT *, CASE WHEN number IS NOT NULL THEN w END AS hw, row_number() OVER (PARTITION BY track ORDER BY CASE WHEN number IS NOT NULL THEN w END DESC NULLS LAST, number) AS rn FROM per),
vg AS (SELECT track, CAST(sum(n) AS BIGINT) AS n_obs, sum(hw) AS total, coalesce(sum(CASE WHEN number IS NOT NULL THEN n END), 0) AS legible, max(CASE WHEN rn = 1 THEN number END) AS top, max(CASE WHEN rn = 1 THEN hw END) AS w1, coalesce(max(CASE WHEN rn = 2 THEN hw END), 0) AS w2 FROM rk GROUP BY track),
vote AS (SELECT track, CASE WHEN n_obs >= 3 AND coalesce(total, 0) > 0 AND w1 / total >= 0.5 AND (w1 - w2) / total >= 0.15 THEN top END AS jersey, CASE WHEN n_obs >= 3 AND coalesce(total, 0) > 0 THEN round(w1 / total, 6) ELSE 0 END AS confidence, n_obs, round(legible / n_obs, 6) AS legible_frac FROM vg)"""


def _votes(spark, sf):
    return identity.weighted_vote(v(spark, sf, "reads"), ["track"])


@query(f"{{reads}}, {_VOTE} SELECT track, jersey, confidence, n_obs, legible_frac FROM vote")
def jersey_vote(spark, sf):
    return _votes(spark, sf).select("track", "jersey", F.round("confidence", 6).alias("confidence"), "n_obs", F.round("legible_frac", 6).alias("legible_frac"))


@query(f"{{reads}}, {_VOTE}, named AS (SELECT vote.*, c_name FROM vote LEFT JOIN customer ON c_custkey = track) SELECT track FROM named WHERE jersey = 7")
def lanes_for(spark, sf):
    names = load(spark, sf, "customer").select(F.col("c_custkey").alias("track"), F.col("c_name").alias("name"))
    roster = spark.createDataFrame([(7, "Bryce "), (11, "Ada")], "jersey int, name string")
    return matching.lanes_for(_votes(spark, sf).join(names, "track", "left"), roster, name=" bryce")


@query(f"{{reads}}, {_VOTE} SELECT track, jersey, CASE jersey WHEN 7 THEN 'Ada' WHEN 11 THEN 'Bryce' END AS name FROM vote")
def roster_names(spark, sf):
    roster = spark.createDataFrame([(7, "Ada"), (7, "Zoe"), (11, "Bryce"), (None, "Noah")], "jersey int, name string")
    return matching.named(_votes(spark, sf), roster).select("track", "jersey", "name")


@query(f"{{reads}}, {_VOTE} SELECT CAST(track % 8 AS VARCHAR) AS video, track, jersey, round(confidence, 3) AS confidence, n_obs, round(legible_frac, 3) AS legible_frac, CASE jersey WHEN 7 THEN 'Ada' END AS name FROM vote")
def jerseys_document(spark, sf):
    named = matching.named(_votes(spark, sf), spark.createDataFrame([(7, "Ada")], "jersey int, name string")).withColumn("video", (F.col("track") % 8).cast("string"))
    docs = documents.jerseys_document(named.withColumn("confidence", F.round("confidence", 6)).withColumn("legible_frac", F.round("legible_frac", 6)), "video")
    return docs.select("video", F.explode(F.from_json("doc", documents.JERSEYS)["tracks"]).alias("track", "e")).select("video", F.col("track").cast("long").alias("track"), "e.*")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY o_custkey) // 4) AS step FROM orders) WHERE i % step = 0""")
def stride_sample(spark, sf):
    return identity.stride_sample(load(spark, sf, "orders"), ["o_custkey"], "o_orderkey", 4).select("o_orderkey")


@query("""SELECT p_partkey, CASE WHEN length(d) IN (1, 2) THEN CAST(d AS INTEGER) END AS number, CASE WHEN length(d) IN (1, 2) THEN 0.8::DOUBLE ELSE 0 END AS conf FROM (SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS d FROM part)""")
def parse_number(spark, sf):
    p = load(spark, sf, "part")
    conf = F.transform(F.split("p_brand", ""), lambda c: F.when(c == "#", 0.1).otherwise(0.8))
    n, c = lab.parse_number(F.col("p_brand"), conf)
    return p.select("p_partkey", n.alias("number"), c.alias("conf"))


_COLOUR = """CASE WHEN v < 50 THEN 'black' WHEN round(s) < 45 THEN CASE WHEN v > 150 THEN 'white' ELSE 'gray' END WHEN h < 10 THEN 'red' WHEN h < 25 THEN 'orange' WHEN h < 35 THEN 'yellow' WHEN h < 85 THEN 'green' WHEN h < 100 THEN 'cyan' WHEN h < 130 THEN 'blue' WHEN h < 160 THEN 'purple' WHEN h < 170 THEN 'pink' ELSE 'red' END"""
_HSV = """hs AS (SELECT *, greatest(b, g, r)::DOUBLE AS v, (greatest(b, g, r) - least(b, g, r))::DOUBLE AS d FROM {src}),
hd AS (SELECT *, CASE WHEN v > 0 THEN d / v * 255 ELSE 0 END AS s, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (g - b) / d * 60 WHEN v = g THEN (b - r) / d * 60 + 120 ELSE (r - g) / d * 60 + 240 END AS deg FROM hs),
hh AS (SELECT *, round(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END / 2) % 180 AS h FROM hd)"""


@query(f"{{colours}}, u AS (SELECT DISTINCT b, g, r FROM colours), {_HSV.replace('{src}', 'u')} SELECT b, g, r, {_COLOUR} AS colour FROM hh")
def colour_name(spark, sf):
    return v(spark, sf, "colours").select("b", "g", "r").distinct().withColumn("colour", lab.colour_name(F.col("b"), F.col("g"), F.col("r")))


@query(f"{{colours}}, u AS (SELECT track, median(b) AS b, median(g) AS g, median(r) AS r FROM colours GROUP BY track HAVING count(*) >= 3), {_HSV.replace('{src}', 'u')} SELECT track, b, g, r, {_COLOUR} AS colour FROM hh")
def track_median_colour(spark, sf):
    return identity.track_colours(v(spark, sf, "colours"), ["track"])


_LIN = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE power(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) END AS {c}l"
_CUBE = "CASE WHEN {t} > 0.008856 THEN power({t}, 1 / 3.0::DOUBLE) ELSE 7.787::DOUBLE * {t} + 16 / 116.0::DOUBLE END AS {n}"
_NEARER = "(l - l1) * (l - l1) + (a - a1) * (a - a1) + (b_ - b1) * (b_ - b1) < (l - l0) * (l - l0) + (a - a0) * (a - a0) + (b_ - b0) * (b_ - b0)"
#: Two means from the least and the greatest row, twenty rounds.
_CLUSTERS = f"""med AS (SELECT track, median(b) AS b, median(g) AS g, median(r) AS r FROM colours GROUP BY track HAVING count(*) >= 3),
lin AS (SELECT *, {", ".join(_LIN.format(c=c) for c in "bgr")} FROM med),
xyz AS (SELECT *, (0.412453::DOUBLE * rl + 0.357580::DOUBLE * gl + 0.180423::DOUBLE * bl) / 0.950456::DOUBLE AS xx, 0.212671::DOUBLE * rl + 0.715160::DOUBLE * gl + 0.072169::DOUBLE * bl AS yy, (0.019334::DOUBLE * rl + 0.119193::DOUBLE * gl + 0.950227::DOUBLE * bl) / 1.088754::DOUBLE AS zz FROM lin),
cub AS (SELECT track, b, g, r, {_CUBE.format(t="xx", n="x3")}, {_CUBE.format(t="yy", n="y3")}, {_CUBE.format(t="zz", n="z3")} FROM xyz),
lab AS (SELECT track, b, g, r, 116 * y3 - 16 AS l, 500 * (x3 - y3) AS a, 200 * (y3 - z3) AS b_ FROM cub),
ends AS (SELECT first(l ORDER BY l, a, b_, track) AS l0, first(a ORDER BY l, a, b_, track) AS a0, first(b_ ORDER BY l, a, b_, track) AS b0, last(l ORDER BY l, a, b_, track) AS l1, last(a ORDER BY l, a, b_, track) AS a1, last(b_ ORDER BY l, a, b_, track) AS b1 FROM lab),
means(n, l0, a0, b0, l1, a1, b1) AS (SELECT 0, l0, a0, b0, l1, a1, b1 FROM ends UNION ALL
 SELECT n + 1, {", ".join(f"coalesce(avg({v}) FILTER (WHERE {'' if i else 'NOT '}s), min({c}{i}))" for i in (0, 1) for v, c in (("l", "l"), ("a", "a"), ("b_", "b")))} FROM (SELECT *, {_NEARER} AS s FROM means, lab) WHERE n < 20 GROUP BY n),
own AS (SELECT lab.*, {_NEARER} AS s FROM lab, means WHERE n = 20),
tm AS (SELECT s, avg(b) AS b, avg(g) AS g, avg(r) AS r FROM own GROUP BY s)"""


@query(f"{{colours}}, {_CLUSTERS}, {_HSV.replace('{src}', 'tm')}, named AS (SELECT s2, {_COLOUR} AS team FROM hh) SELECT own.track, CASE WHEN own.s THEN 'team_b' ELSE 'team_a' END AS cluster, named.team FROM own JOIN named ON named.s2 = own.s".replace("hs AS (SELECT *,", "hs AS (SELECT s AS s2, b, g, r,"))
def team_cluster(spark, sf):
    return identity.two_teams(identity.track_colours(v(spark, sf, "colours"), ["track"]), ["track"])


# -- tracks -------------------------------------------------------------------


@query("""{boxes} SELECT a.frame, a.det FROM boxes a WHERE a.class_id IN (1, 3) AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.class_id = 2 AND b.frame = a.frame
 AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) > 0.05)""")
def referee_veto(spark, sf):
    b = v(spark, sf, "boxes")
    return matching.veto(b.where(F.col("class_id").isin(1, 3)), v(spark, sf, "boxes").where("class_id = 2"), ["frame"], most=0.05).select("frame", "det")


@query("{players} SELECT frame, track FROM players WHERE track IN (SELECT track FROM players GROUP BY track HAVING count(DISTINCT frame) >= 10 AND count(DISTINCT frame) / ((max(frame) - min(frame)) / 24.0 + 1) >= 0.9)")
def continuity_filter(spark, sf):
    return tracklets.continuous(v(spark, sf, "players"), ["track"], stride=24, share=0.9).select("frame", "track")


@query("{players,teams}, n AS (SELECT team, track, count(*) AS n FROM players JOIN teams USING (track) GROUP BY team, track), r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n DESC, track) AS rn FROM n) SELECT team, track, n, CAST(CASE WHEN rn <= 3 THEN rn ELSE 0 END AS INTEGER) AS slot FROM r")
def top_lanes(spark, sf):
    return tracklets.slots(v(spark, sf, "players").join(v(spark, sf, "teams"), "track"), "team", "track", 3)


@query("""{players}, n AS (SELECT track, count(*) AS n FROM players GROUP BY track), r AS (SELECT track, row_number() OVER (ORDER BY n DESC, track) AS slot FROM n), p AS (SELECT slot, frame, fx AS x, fy AS y FROM players JOIN r USING (track) WHERE slot <= 26)
SELECT s.i AS slot, f.i AS frame, coalesce(x, 50.0) AS x, coalesce(y, 50.0) AS y, CAST(CASE WHEN x IS NULL THEN 0 ELSE 1 END AS INTEGER) AS mask FROM range(1, 27) s(i) CROSS JOIN (SELECT unnest(range(0, max(frame) + 1)) AS i FROM players) f LEFT JOIN p ON p.slot = s.i AND p.frame = f.i""")
def slot_grid(spark, sf):
    p = v(spark, sf, "players").select("track", "frame", F.col("fx").alias("x"), F.col("fy").alias("y"))
    return tracklets.slot_grid(p, "track", "frame", {"x": 50.0, "y": 50.0})


@query()
def lane_grid(spark, sf):
    p = v(spark, sf, "players").join(v(spark, sf, "teams"), "track").select("team", "track", "frame", F.col("fx").alias("x"), F.col("fy").alias("y"))
    return tracklets.lane_grid(p, "team", "track", "frame", {"x": 50.0, "y": 50.0})


@query("""{class_scores}, e AS (SELECT slot, frame, unnest(scores) AS s, generate_subscripts(scores, 1) - 1 AS i FROM class_scores),
x AS (SELECT slot, frame, i, exp(s - max(s) OVER (PARTITION BY frame)) AS e FROM e),
p AS (SELECT slot, frame, CAST(i AS INTEGER) AS cls, round(e / sum(e) OVER (PARTITION BY frame), 9) AS score, row_number() OVER (PARTITION BY frame ORDER BY e DESC, i) AS rn FROM x),
m AS (SELECT slot, frame, cls, score, max(score) OVER (PARTITION BY slot, cls ORDER BY frame RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING) AS top FROM p WHERE rn = 1)
SELECT slot, frame, cls, round(score, 6) AS score FROM m WHERE cls <> 0 AND score > 0.12 AND score >= top""")
def temporal_nms(spark, sf):
    rows = _class_rows(spark, sf).withColumn("score", F.round("score", 9))
    return tracklets.temporal_nms(rows, least=0.12, reach=60).select("slot", "frame", "cls", F.round("score", 6).alias("score"))


_GATE = """ev AS (SELECT l_suppkey AS track, l_orderkey AS frame, l_linenumber AS line, l_discount * 10 AS score FROM lineitem),
bl AS (SELECT frame, avg(fx) AS x, avg(fy) AS y FROM samples GROUP BY frame),
bd AS (SELECT ev.track, ev.frame, line, round(score, 2) AS score, sqrt(power(p.fx - bl.x, 2) + power(p.fy - bl.y, 2)) / 55 AS ball_d FROM ev LEFT JOIN players p ON p.track = ev.track AND p.frame = ev.frame LEFT JOIN bl ON bl.frame = ev.frame)"""


def _ball_events(spark, sf):
    e = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("track"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("line"), F.round(F.col("l_discount") * 10, 2).alias("score"))
    p = v(spark, sf, "players").select("track", "frame", F.col("fx").alias("x"), F.col("fy").alias("y"))
    b = v(spark, sf, "samples").groupBy("frame").agg(F.avg("fx").alias("x"), F.avg("fy").alias("y"))
    return tracklets.ball_distance(e, p, b, 55.0)


@query(f"{{samples,players}}, {_GATE} SELECT track, frame, line, round(ball_d, 6) AS ball_d FROM bd")
def ball_distance(spark, sf):
    return _ball_events(spark, sf).select("track", "frame", "line", F.round("ball_d", 6).alias("ball_d"))


@query(f"{{samples,players}}, {_GATE} SELECT track, frame, line, coalesce(ball_d <= 0.18, false) AS near FROM bd WHERE NOT coalesce(ball_d > 0.32 AND score < 0.45, false)")
def ball_gate(spark, sf):
    return tracklets.ball_gate(_ball_events(spark, sf)).select("track", "frame", "line", "near")


@query(f"{{samples,players}}, {_GATE} SELECT count(*) AS events, count(*) FILTER (WHERE NOT coalesce(ball_d > 0.32 AND score < 0.45, false)) AS kept, count(*) FILTER (WHERE NOT coalesce(ball_d > 0.32 AND score < 0.45, false) AND ball_d <= 0.18) AS near, count(*) FILTER (WHERE ball_d > 0.32 AND score < 0.45) AS gated FROM bd")
def gate_counts(spark, sf):
    return tracklets.gate_counts(_ball_events(spark, sf))


@query("""{players}, b AS (SELECT CAST(frame % 4 AS VARCHAR) AS game_key, frame, track, fx * 30 AS x, fy * 20 AS y, 20.0::DOUBLE AS w, 40.0::DOUBLE AS h FROM players),
n AS (SELECT *, (x + w / 2) / 1920 AS x_pos, (y + h) / 1080 AS y_pos FROM b)
SELECT game_key, frame, track AS player_id, CAST(track % 2 AS BIGINT) AS left_to_right, -1 AS shirt_number, round(x_pos, 9) AS x_pos, round(y_pos, 9) AS y_pos,
 round(coalesce((x_pos - lag(x_pos) OVER o) / greatest(1, frame - lag(frame) OVER o), 0), 9) AS x_speed, round(coalesce((y_pos - lag(y_pos) OVER o) / greatest(1, frame - lag(frame) OVER o), 0), 9) AS y_speed, x AS roi_x, h AS roi_h FROM n WINDOW o AS (PARTITION BY game_key, track ORDER BY frame)""")
def tracklet_matrix(spark, sf):
    p = v(spark, sf, "players").select((F.col("frame") % 4).cast("string").alias("game_key"), "frame", "track", (F.col("fx") * 30).alias("x"), (F.col("fy") * 20).alias("y"), F.lit(20.0).alias("w"), F.lit(40.0).alias("h"))
    m = tracklets.matrix(p, "game_key", "frame", "track", F.col("track") % 2, 1920.0, 1080.0)
    return m.select("game_key", "frame", "player_id", "left_to_right", "shirt_number", *(F.round(c, 9).alias(c) for c in ("x_pos", "y_pos", "x_speed", "y_speed")), "roi_x", "roi_h")


@query()
def track_association(spark, sf):
    b = v(spark, sf, "boxes").withColumn("match_id", F.col("frame") % 8)
    return tracklets.associate(b, ["match_id"], lost=200).select("match_id", "frame", "det", "track")


@query("""{trajectory} SELECT track, idx, last_value(CASE WHEN event_type = 'click' THEN 'click' END IGNORE NULLS) OVER (PARTITION BY track ORDER BY idx RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) AS held FROM trajectory""")
def action_hold(spark, sf):
    t = v(spark, sf, "trajectory").withColumn("action", F.when(F.col("event_type") == "click", F.col("event_type")))
    return tracklets.held_action(t, ["track"], "idx", "action", 300).select("track", "idx", "held")


@query("{dated}, d(cls) AS (VALUES ('shot'), ('foul'), ('penalty'), ('throw_in')), n AS (SELECT label, count(*) AS n FROM dated GROUP BY label) SELECT cls, coalesce(n, 0) AS n FROM d LEFT JOIN n ON n.label = cls")
def class_counts(spark, sf):
    return tracklets.class_counts(v(spark, sf, "dated").withColumnRenamed("label", "cls"), ["shot", "foul", "penalty", "throw_in"])


# -- as-of joins --------------------------------------------------------------


@query("""{samples}, h AS (SELECT match_id, frame, CASE WHEN frame % 7 = 0 AND visible THEN px END AS val FROM samples),
b AS (SELECT *, max(CASE WHEN val IS NOT NULL THEN frame END) OVER (PARTITION BY match_id ORDER BY frame) AS p, min(CASE WHEN val IS NOT NULL THEN frame END) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM h),
c AS (SELECT match_id, frame, CASE WHEN q IS NULL OR frame - p <= q - frame THEN p ELSE q END AS pick FROM b)
SELECT c.match_id, c.frame, h.val AS nearest FROM c LEFT JOIN h ON h.match_id = c.match_id AND h.frame = c.pick""")
def nearest_homography(spark, sf):
    s = v(spark, sf, "samples").withColumn("val", F.when((F.col("frame") % 7 == 0) & F.col("visible"), F.col("px")))
    return matching.nearest_valid(s, ["match_id"], "frame", "val").select("match_id", "frame", "nearest")


@query("""{samples} SELECT match_id, frame, last_value(CASE WHEN frame % 7 = 0 THEN px END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM samples""")
def carry_forward(spark, sf):
    s = v(spark, sf, "samples").withColumn("val", F.when(F.col("frame") % 7 == 0, F.col("px")))
    return sequence.carry_forward(s, ["match_id"], "frame", "val", "carried").select("match_id", "frame", "carried")


@query("""{boxes}, s AS (SELECT *, lead(frame) OVER w AS f1, lead(x1) OVER w AS nx, lead(y1) OVER w AS ny FROM boxes WINDOW w AS (PARTITION BY det ORDER BY frame)),
want AS (SELECT DISTINCT det, frame + 3 AS frame FROM boxes),
hit AS (SELECT want.det, want.frame, s.*  EXCLUDE (det, frame), s.frame AS f0 FROM want LEFT JOIN s ON s.det = want.det AND s.frame <= want.frame AND (want.frame = s.frame OR (s.f1 - s.frame <= 40 AND want.frame < s.f1)))
SELECT det, frame, round(CASE WHEN frame = f0 THEN x1 ELSE x1 + (nx - x1) * ((frame - f0) / (f1 - f0)) END, 6) AS x1, round(CASE WHEN frame = f0 THEN y1 ELSE y1 + (ny - y1) * ((frame - f0) / (f1 - f0)) END, 6) AS y1 FROM hit""")
def interpolate_boxes(spark, sf):
    b = v(spark, sf, "boxes")
    want = v(spark, sf, "boxes").select("det", (F.col("frame") + 3).alias("frame")).distinct()
    return matching.interpolated_boxes(b, want, ["det"], sides=("x1", "y1"), max_gap=40).select("det", "frame", F.round("x1", 6).alias("x1"), F.round("y1", 6).alias("y1"))


# -- harvest ------------------------------------------------------------------


@query("{candidates} SELECT id FROM candidates WHERE contains(lower(license), 'creative commons')")
def cc_filter(spark, sf):
    return v(spark, sf, "candidates").where(lab.open_licence(F.col("license"))).select("id")


_TERMS = "tion|erer|the"


@query(f"""{{candidates}} SELECT id FROM candidates WHERE regexp_matches(title || ' ' || substr(description, 1, 400), '(?i)(^|[^\\p{{L}}\\p{{N}}_])({_TERMS})($|[^\\p{{L}}\\p{{N}}_])')""")
def offtopic_filter(spark, sf):
    return v(spark, sf, "candidates").where(lab.off_topic(F.col("title"), F.col("description"), _TERMS)).select("id")


@query(f"""{{candidates,manifest}}, e AS (SELECT *, CASE WHEN id IN (SELECT id FROM manifest) THEN 'seen' WHEN duration IS NULL THEN 'unresolvable' WHEN NOT contains(lower(license), 'creative commons') THEN 'license'
 WHEN regexp_matches(title || ' ' || substr(description, 1, 400), '(?i)\\b({lab.OFF_TOPIC_TERMS})\\b') THEN 'off_topic' WHEN duration < 300 THEN 'too_short' END AS early FROM candidates),
h AS (SELECT channel, count(*) AS had FROM manifest GROUP BY channel),
t AS (SELECT e.*, early IS NULL AND row_number() OVER (PARTITION BY e.channel, early IS NULL ORDER BY id) + coalesce(had, 0) <= 12 AS ok FROM e LEFT JOIN h ON h.channel = e.channel),
k AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY id) AS taken FROM t)
SELECT id, coalesce(early, CASE WHEN NOT ok THEN 'channel_cap' WHEN taken + (SELECT count(*) FROM manifest) <= 200 THEN 'kept' ELSE 'target' END) AS reason FROM k""")
def harvest_admission(spark, sf):
    return _admitted(spark, sf).select("id", "reason")


def _admitted(spark, sf):
    return harvest.admission(v(spark, sf, "candidates"), v(spark, sf, "manifest"), "id", per_channel=12, target=200)


_REASONS = ("seen", "unresolvable", "license", "off_topic", "too_short", "channel_cap", "kept")


@query(f"SELECT count(*) AS candidates, {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in _REASONS)} FROM ({ORACLES['harvest_admission']})")
def harvest_counters(spark, sf):
    return harvest.counters(_admitted(spark, sf))


@query("SELECT source AS channel, count(*) AS n FROM documents GROUP BY source")
def channel_counts(spark, sf):
    d = load(spark, sf, "documents").select(F.lit(None).cast("string").alias("channel_id"), F.col("source").alias("channel"))
    return harvest.channel_counts(d)


@query("{candidates} SELECT id, '- **' || title || '** — ' || channel || ' ([' || CAST(id AS VARCHAR) || '](v/' || CAST(id AS VARCHAR) || ')), ' || license AS line FROM candidates")
def attribution_lines(spark, sf):
    m = v(spark, sf, "candidates").withColumn("url", F.concat(F.lit("v/"), F.col("id").cast("string")))
    return harvest.attribution_lines(m)


# -- review -------------------------------------------------------------------

_NAMES = "names AS (SELECT frame, ts, label, 'run_' || CAST(match_id AS VARCHAR) || '_' || lpad(CAST(frame AS VARCHAR), CAST(greatest(3, length(CAST(frame AS VARCHAR))) AS INTEGER), '0') || '_' || label || '_' || CAST(CAST(round_even(ts, 0) AS BIGINT) AS VARCHAR) || 's.mp4' AS name FROM dated)"


def _names(spark, sf):
    d = v(spark, sf, "dated")
    index = F.when(F.length(F.col("frame").cast("string")) < 3, F.lpad(F.col("frame").cast("string"), 3, "0")).otherwise(F.col("frame").cast("string"))
    return d.withColumn("name", F.concat(F.lit("run_"), F.col("match_id").cast("string"), F.lit("_"), index, F.lit("_"), "label", F.lit("_"), F.bround("ts").cast("long").cast("string"), F.lit("s.mp4")))


@query(rf"""{{dated}}, {_NAMES} SELECT frame, name, regexp_extract(name, '{lab.CLIP_NAME}', 1) AS prefix, CAST(regexp_extract(name, '{lab.CLIP_NAME}', 2) AS INTEGER) AS idx, regexp_extract(name, '{lab.CLIP_NAME}', 3) AS label, CAST(regexp_extract(name, '{lab.CLIP_NAME}', 4) AS INTEGER) AS secs FROM names""")
def clip_name_parse(spark, sf):
    p = lab.parse_clip_name(F.col("name"))
    return _names(spark, sf).select("frame", "name", *(c.alias(n) for c, n in zip(p, ("prefix", "idx", "label", "secs"), strict=True)))


@query(f"""{{dated}}, {_NAMES}, e AS (SELECT match_id AS run, frame AS idx, ts FROM dated),
c AS (SELECT d.match_id AS run, CASE WHEN d.frame % 5 = 0 THEN d.frame + 1 ELSE d.frame END AS cidx, round_even(d.ts, 0) AS cts, n.name FROM dated d JOIN names n USING (frame) WHERE d.frame % 3 <> 0),
one AS (SELECT e.run, e.idx, min(c.name) AS clip FROM e JOIN c ON c.run = e.run AND c.cidx = e.idx AND abs(e.ts - c.cts) <= 2 GROUP BY e.run, e.idx),
rest AS (SELECT e.*, row_number() OVER (PARTITION BY run ORDER BY idx) AS rn FROM e WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.run = e.run AND one.idx = e.idx)),
free AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.run = c.run AND one.clip = c.name)),
near AS (SELECT r.run, r.rn, r.idx, list({{'d': abs(f.cts - r.ts), 'n': f.name}} ORDER BY abs(f.cts - r.ts), f.name) FILTER (WHERE f.name IS NOT NULL) AS clips FROM rest r LEFT JOIN free f ON f.run = r.run AND abs(f.cts - r.ts) <= 2 GROUP BY r.run, r.rn, r.idx),
g(run, rn, idx, clip, used) AS (SELECT DISTINCT run, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM rest UNION ALL
 SELECT run, rn, idx, clip, CASE WHEN clip IS NULL THEN used ELSE list_append(used, clip) END FROM (SELECT g.run, n.rn, n.idx, g.used, list_filter(coalesce(n.clips, []), lambda x: NOT list_contains(g.used, x.n))[1].n AS clip FROM g JOIN near n ON n.run = g.run AND n.rn = g.rn + 1))
SELECT run, idx, clip FROM one UNION ALL SELECT run, idx, clip FROM g WHERE rn > 0""")
def pair_clips(spark, sf):
    d = v(spark, sf, "dated").select(F.col("match_id").alias("run"), F.col("frame").alias("idx"), "ts")
    clips = _names(spark, sf).where("frame % 3 <> 0").select(F.col("match_id").alias("run"), F.when(F.col("frame") % 5 == 0, F.col("frame") + 1).otherwise(F.col("frame")).alias("idx"), F.bround("ts").alias("ts"), "name")
    return review.pair_clips(d, clips, "run")


_CLASSES = ", ".join(f"({i}, '{c}', '{x}')" for i, (c, x) in enumerate(lab.CAPTION_CLASSES.items()))
_SEEN = f"""cl(i, cls, lbl) AS (VALUES {_CLASSES}), t AS (SELECT *, lower(regexp_replace(trim(said), '^\\.+|\\.+$', '', 'g')) AS t FROM reports),
x AS (SELECT conv_id, turn, label, (SELECT min(i) FROM cl WHERE lower(cls) = t.t) AS e, (SELECT min(i) FROM cl WHERE contains(t.t, lower(cls))) AS c FROM t),
seen AS (SELECT conv_id, turn, label, cls, lbl, CASE WHEN e IS NOT NULL THEN 0.9::DOUBLE WHEN c IS NOT NULL THEN 0.6 ELSE 0 END AS sure FROM x LEFT JOIN cl ON cl.i = coalesce(e, c)),
vd AS (SELECT *, CASE WHEN lbl IS NULL THEN 'UNKNOWN' WHEN lbl = label THEN 'CONFIRMED' WHEN label = 'goal_kick' AND cls IN ('Kick-off', 'Ball out of play') THEN 'PLAUSIBLE' ELSE 'REJECTED' END AS verdict FROM seen)"""


def _seen(spark, sf):
    cls, sure = lab.normalise_class(F.col("said"))
    r = v(spark, sf, "reports").withColumn("cls", cls).withColumn("sure", sure).withColumn("lbl", F.element_at(lab.mapping(lab.CAPTION_CLASSES), F.col("cls")))
    c = (F.col("label"), F.col("cls"), F.col("lbl"))
    return r.withColumn("verdict", lab.verdict(*c)).withColumn("reason", lab.verdict_reason(*c))


@query(f"{{reports}}, {_SEEN} SELECT conv_id, turn, cls, sure FROM seen")
def normalise_class(spark, sf):
    return _seen(spark, sf).select("conv_id", "turn", "cls", "sure")


@query(f"{{reports}}, {_SEEN} SELECT conv_id, turn, verdict, CASE verdict WHEN 'UNKNOWN' THEN 'no class recognised' WHEN 'CONFIRMED' THEN 'agrees: ' || cls WHEN 'PLAUSIBLE' THEN cls || ' may stand for a goal kick' ELSE 'predicts ' || cls || ' (' || lbl || '), not ' || label END AS reason FROM vd")
def verdicts(spark, sf):
    return _seen(spark, sf).select("conv_id", "turn", "verdict", "reason")


@query(f"{{reports}}, {_SEEN} SELECT verdict, count(*) AS n FROM vd GROUP BY verdict")
def verdict_tally(spark, sf):
    return review.tally(_seen(spark, sf))


_PATCH = "ok AS (SELECT DISTINCT frame FROM dated WHERE label = 'shot'), bad AS (SELECT DISTINCT l_orderkey AS frame FROM lineitem)"


@query(f"{{dated}}, {_PATCH} SELECT d.frame, d.label, ok.frame IS NOT NULL AS verified FROM (SELECT CASE WHEN frame % 11 = 0 THEN NULL ELSE frame END AS frame, label FROM dated) d LEFT JOIN ok ON ok.frame = d.frame LEFT JOIN bad ON bad.frame = d.frame WHERE d.frame IS NOT NULL AND (bad.frame IS NULL OR ok.frame IS NOT NULL)")
def verify_patch(spark, sf):
    d = v(spark, sf, "dated")
    e = d.select(F.when(F.col("frame") % 11 != 0, F.col("frame")).alias("frame"), "label")
    bad = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"))
    return review.patch_verified(e, v(spark, sf, "dated").where("label = 'shot'").select("frame"), bad)


@query("""{dated}, l AS (SELECT l_orderkey AS frame, max_by(CASE WHEN l_returnflag = 'A' THEN 'CONFIRMED' ELSE 'REJECTED' END, (l_linenumber * 1000000 + l_partkey) * 2 + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS verdict FROM lineitem GROUP BY l_orderkey)
SELECT dated.frame, l.verdict, coalesce(l.verdict = 'CONFIRMED', false) AS verified FROM dated LEFT JOIN l USING (frame)""")
def review_join(spark, sf):
    r = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), F.when(F.col("l_returnflag") == "A", "CONFIRMED").otherwise("REJECTED").alias("verdict"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 2 + (F.col("l_returnflag") == "A").cast("int")).alias("seq"))
    return review.annotate(v(spark, sf, "dated"), r, "seq").select("frame", "review.verdict", "verified")


@query("""{dated} SELECT match_id AS run, frame AS idx, label, 'c' || CAST(frame AS VARCHAR) AS clip, CASE WHEN frame % 2 = 0 THEN 'CONFIRMED' ELSE '—' END AS verdict, CASE WHEN frame % 4 = 0 THEN 'seen' ELSE '—' END AS caption FROM dated WHERE frame % 3 <> 0""")
def review_tasks(spark, sf):
    d = v(spark, sf, "dated").select(F.col("match_id").alias("run"), F.col("frame").alias("idx"), "frame", "label")
    pairs = d.select("run", "idx", F.when(F.col("idx") % 3 != 0, F.concat(F.lit("c"), F.col("idx").cast("string"))).alias("clip"))
    reviews = v(spark, sf, "dated").where("frame % 2 = 0").select("frame", F.lit("CONFIRMED").alias("verdict"), F.when(F.col("frame") % 4 == 0, "seen").alias("caption"))
    return review.tasks(d, pairs, reviews).drop("frame")


# -- documents ----------------------------------------------------------------


@query("{dated} SELECT match_id, label, frame, CAST(trunc(ts * 1000) AS BIGINT) AS position_ms, round(ts / 700, 4) AS confidence FROM dated")
def osl_roundtrip(spark, sf):
    d = v(spark, sf, "dated").withColumn("position_ms", (F.col("ts") * 1000).cast("long")).withColumn("confidence", F.col("ts") / 700)
    docs = documents.osl_documents(d, "match_id", ["label", "frame", "position_ms", "confidence"])
    return documents.osl_events(docs).select(F.col("match_id").cast("long").alias("match_id"), "label", "frame", "position_ms", "confidence")


@query("{samples} SELECT CAST(match_id AS VARCHAR) AS video, frame, round(ts_ms / 1000.0::DOUBLE, 3) AS timestamp_s, CASE WHEN visible THEN px END AS h0, CASE WHEN visible THEN py END AS h5, CASE WHEN visible THEN 1.0::DOUBLE END AS h8 FROM samples")
def homography_cache(spark, sf):
    h = F.when(F.col("visible"), F.array("px", *(F.lit(0.0) for _ in range(4)), "py", F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    s = v(spark, sf, "samples").select("match_id", "frame", (F.col("ts_ms") / 1000.0).alias("timestamp_s"), h.alias("h"))
    back = documents.homographies(documents.homography_document(s, "match_id"))
    return back.select("video", "frame", "timestamp_s", *(F.col("h")[i].alias(f"h{i}") for i in (0, 5, 8)))


@query("{dated} SELECT CAST(match_id AS VARCHAR) AS video, frame, round(ts, 2) AS timestamp_s, lpad(CAST(CAST(floor(ts / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || format('{:04.1f}', ts % 60) AS timestamp_hms, CASE WHEN frame % 2 = 0 THEN 'left' ELSE 'right' END AS goal_zone, CASE WHEN frame % 3 = 0 THEN 2.5::DOUBLE END AS field_x_m FROM dated")
def candidate_document(spark, sf):
    d = v(spark, sf, "dated").select("match_id", "frame", "ts", F.lit(0.5).alias("conf"), F.lit(1.0).alias("px"), F.lit(2.0).alias("py"), F.when(F.col("frame") % 2 == 0, "left").otherwise("right").alias("zone"), F.when(F.col("frame") % 3 == 0, 2.5).alias("fx"), F.lit(None).cast("double").alias("fy"))
    back = documents.candidates(documents.candidates_document(d, "match_id", 30.0, 5.0))
    return back.select("video", "frame", "timestamp_s", "timestamp_hms", "goal_zone", "field_x_m")


@query(f"{{samples}}, {_SEGMENTS} SELECT CAST(match_id AS VARCHAR) AS video, round(start_ms / 1000.0::DOUBLE, 3) AS start_s, round(end_ms / 1000.0::DOUBLE, 3) AS end_s, round((end_ms - start_ms) / 1000.0::DOUBLE, 3) AS duration_s, reason FROM seg")
def cuts_document(spark, sf):
    p = _plan(spark, sf)
    return documents.cuts(documents.cuts_document(p.removed, p.kept, p.totals, "match_id"))


@query("{dated} SELECT label, coalesce(team, 'unknown') AS team, count(*) AS n FROM dated GROUP BY ALL")
def stats_document(spark, sf):
    d = v(spark, sf, "dated")
    doc = documents.stats_document("m", d, metrics.distance(v(spark, sf, "trajectory"), ["track"], "idx", "x", "y"))
    nested = F.from_json("doc", "event_counts_by_team map<string,map<string,bigint>>")["event_counts_by_team"]
    return doc.select(F.explode(nested).alias("label", "teams")).select("label", F.explode("teams").alias("team", "n"))


@query("{boxes} SELECT det AS track, frame, x1, y2 FROM boxes")
def tracks_transpose(spark, sf):
    t = documents.tracks_document(v(spark, sf, "boxes"), "det", "frame", ("x1", "y1", "x2", "y2"))
    return documents.tracks_rows(t).select("track", "frame", F.col("bbox")[0].alias("x1"), F.col("bbox")[3].alias("y2"))


@query("{dated} SELECT frame, label, CASE WHEN frame % 2 = 0 THEN 'throw_in' ELSE label END AS corrected FROM dated WHERE frame % 5 <> 0")
def annotation_export(spark, sf):
    d = v(spark, sf, "dated")
    text = F.concat(
        F.lit('{"data":{"frame":'), F.col("frame").cast("string"), F.lit(',"label":"'), "label", F.lit('","clip":"c"},"annotations":[{"was_cancelled":true,"result":[]}'),
        F.when(F.col("frame") % 5 != 0, F.concat(F.lit(',{"was_cancelled":false,"result":[{"from_name":"notes","value":{}},{"from_name":"label","value":{"choices":["'), F.when(F.col("frame") % 2 == 0, F.lit("throw_in")).otherwise(F.col("label")), F.lit('"]}}]}'))).otherwise(""),
        F.lit("]}"),
    )
    return review.corrected_labels(documents.annotation_tasks(d.select(text.alias("value")))).select("frame", "label", "corrected")


@query("{dated} SELECT frame, frame // 6 + 1 AS sheet, frame % 6 // 3 AS \"row\", frame % 3 AS col FROM (SELECT row_number() OVER (ORDER BY frame) - 1 AS frame FROM dated)")
def sheet_layout(spark, sf):
    d = v(spark, sf, "dated")
    n = d.withColumn("frame", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("frame")).cast("long") - 1)
    return documents.sheet_layout(n, "frame").select("frame", "sheet", "row", "col")


@query("{samples} SELECT match_id, max(ts_ms) / 1000.0::DOUBLE AS duration_s FROM samples GROUP BY match_id")
def track_duration(spark, sf):
    s = v(spark, sf, "samples").withColumn("ts", F.col("ts_ms") / 1000.0)
    return documents.track_duration(s, ["match_id"], "ts")


@query("{dated} SELECT DISTINCT label FROM dated EXCEPT SELECT unnest(['shot', 'foul'])")
def label_drift(spark, sf):
    known = spark.createDataFrame([("shot",), ("foul",)], "label string")
    return v(spark, sf, "dated").select("label").subtract(known)


FLAGSHIP = "cut_list"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set pieces, the player and team at the ball, and the clip to cut for each."""
    return QUERIES[FLAGSHIP](spark, sf_dir)




@query("{dated} SELECT frame, CASE WHEN frame % 2 = 0 THEN ts ELSE trunc(ts * 1000) / 1000.0::DOUBLE END AS timestamp_s FROM dated")
def timestamp_repair(spark, sf):
    d = v(spark, sf, "dated").select("frame", F.when(F.col("frame") % 2 == 0, F.col("ts")).alias("timestamp_s"), (F.col("ts") * 1000).cast("long").alias("position_ms"))
    return documents.with_timestamps(d).select("frame", "timestamp_s")


@query("{samples} SELECT match_id, frame, px FROM samples")
def ball_track_samples(spark, sf):
    doc = v(spark, sf, "samples").groupBy("match_id").agg(F.collect_list(F.struct("match_id", "frame", "px")).alias("samples"))
    return documents.checked_track(doc)


@query("{dated} SELECT match_id, frame, label, 'learned' AS source FROM dated WHERE ts > 300")
def learned_engine(spark, sf):
    engines = detect.default_registry()
    engines.add("learned", lambda: detect.Learned(lambda c: c.balls.where("ts > 300").select("match_id", "frame", "label")))
    return engines.run(detect.Context(v(spark, sf, "dated")), ["learned"]).select("match_id", "frame", "label", "source")
