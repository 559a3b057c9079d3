"""Closed vocabularies and text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The event vocabulary and what other vocabularies map to.
EVENT_LABELS = (
    "goal_kick", "corner_kick", "throw_in", "free_kick", "kickoff", "penalty",
    "goal", "shot", "foul", "tackle", "clearance", "ball_out", "offside",
    "substitution", "yellow_card", "red_card", "halftime",
)
SET_PIECES = ("goal_kick", "corner_kick", "throw_in", "free_kick", "kickoff", "penalty")
DEAD_BALL = (*SET_PIECES, "substitution", "halftime")
BROADCAST_LABELS = {
    "Goal": "goal", "Penalty": "penalty", "Corner": "corner_kick", "Free Kick": "free_kick", "Goal Kick": "goal_kick",
    "Throw-In": "throw_in", "Yellow Card": "yellow_card", "Red Card": "red_card", "Substitution": "substitution",
    "Kick-Off": "kickoff", "Foul": "foul", "Shots on target": "shot", "Shots off target": "shot", "Clearance": "clearance",
    "Ball out of play": "ball_out", "Indirect free-kick": "free_kick", "Direct free-kick": "free_kick",
}
CAPTION_CLASSES = {
    "Ball out of play": "ball_out", "Clearance": "clearance", "Corner": "corner_kick", "Direct free-kick": "free_kick",
    "Foul": "foul", "Goal": "goal", "Indirect free-kick": "free_kick", "Kick-off": "kickoff", "Offside": "offside",
    "Penalty": "penalty", "Red card": "red_card", "Shots off target": "shot", "Shots on target": "shot",
    "Substitution": "substitution", "Throw-in": "throw_in", "Yellow card": "yellow_card",
}
GOAL_KICK_PROXIES = ("Kick-off", "Ball out of play")
OFF_TOPIC_TERMS = (
    "nfl|american football|flag football|gridiron|quarterback|touchdown|pop ?warner|tackle football|friday night lights|"
    "varsity football|7v7 football|madden|end ?zone|wide receiver|running back"
)
OFF_TOPIC_SIGN = "\U0001f3c8"
OPEN_LICENCE = "creative commons"


def mapping(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def phase(label: Column) -> Column:
    return F.when(label.isin(*DEAD_BALL), "dead_ball").otherwise("in_play")


def is_label(label: Column) -> Column:
    return F.coalesce(label.isin(*EVENT_LABELS), F.lit(False))


def map_label(label: Column, known: dict[str, str] = BROADCAST_LABELS) -> Column:
    """The known label, or the lower-cased text with _ for spaces."""
    return F.coalesce(F.element_at(mapping(known), label), F.replace(F.lower(label), F.lit(" "), F.lit("_")))


def open_licence(licence: Column) -> Column:
    return F.contains(F.lower(F.coalesce(licence, F.lit(""))), F.lit(OPEN_LICENCE))


def off_topic(title: Column, description: Column, terms: str = OFF_TOPIC_TERMS) -> Column:
    """A sign or a term in the title or the description's first 400 characters."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(description, F.lit("")), 1, 400))
    return F.contains(text, F.lit(OFF_TOPIC_SIGN)) | text.rlike(rf"(?i)\b({terms})\b")


def normalise_class(text: Column, classes: tuple[str, ...] = tuple(CAPTION_CLASSES)) -> tuple[Column, Column]:
    """(class or null, confidence): 0.9 for the whole text, 0.6 for the first class that it contains, else 0."""
    t = F.lower(F.regexp_replace(F.trim(text), r"^\.+|\.+$", ""))
    names = F.array(*(F.lit(c) for c in classes))
    exact = F.filter(names, lambda c: F.lower(c) == t)
    inside = F.filter(names, lambda c: F.contains(t, F.lower(c)))
    found = F.coalesce(F.get(exact, F.lit(0)), F.get(inside, F.lit(0)))
    sure = F.when(F.size(exact) > 0, 0.9).when(F.size(inside) > 0, 0.6).otherwise(0.0)
    return found, sure


def verdict(candidate: Column, seen_class: Column, seen_label: Column) -> Column:
    return (
        F.when(seen_label.isNull(), "UNKNOWN")
        .when(seen_label == candidate, "CONFIRMED")
        .when((candidate == "goal_kick") & seen_class.isin(*GOAL_KICK_PROXIES), "PLAUSIBLE")
        .otherwise("REJECTED")
    )


def verdict_reason(candidate: Column, seen_class: Column, seen_label: Column) -> Column:
    v = verdict(candidate, seen_class, seen_label)
    return (
        F.when(v == "UNKNOWN", "no class recognised")
        .when(v == "CONFIRMED", F.concat(F.lit("agrees: "), seen_class))
        .when(v == "PLAUSIBLE", F.concat(seen_class, F.lit(" may stand for a goal kick")))
        .otherwise(F.concat(F.lit("predicts "), seen_class, F.lit(" ("), seen_label, F.lit("), not "), candidate))
    )


def parse_number(text: Column, confidences: Column) -> tuple[Column, Column]:
    """One or two digits of a text as a number with their least confidence; else null and 0."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    ok = F.length(digits).isin(1, 2)
    chars = F.split(text, "")
    kept = F.filter(F.zip_with(chars, confidences, lambda c, p: F.when(c.rlike("^[0-9]$"), p)), lambda p: p.isNotNull())
    return F.when(ok, digits.cast("int")), F.when(ok, F.coalesce(F.array_min(kept), F.lit(1.0))).otherwise(0.0)


def clip_name(prefix: Column, index: Column, label: Column, ts: Column) -> Column:
    """prefix_001_label_12s.mp4; seconds are rounded half to even."""
    return F.concat(prefix, F.lit("_"), F.lpad(index.cast("string"), 3, "0"), F.lit("_"), label, F.lit("_"), F.bround(ts).cast("long").cast("string"), F.lit("s.mp4"))


CLIP_NAME = r"^(.+?)_(\d{3,})_(.+)_(\d+)s\.mp4$"


def parse_clip_name(name: Column) -> list[Column]:
    """prefix, index, label, seconds; nulls if it isn't such a name."""
    ok = name.rlike(CLIP_NAME)
    kinds = ("string", "int", "string", "int")
    return [F.when(ok, F.regexp_extract(name, CLIP_NAME, i + 1).cast(k)) for i, k in enumerate(kinds)]


def clock(ts: Column) -> Column:
    """mm:ss.s"""
    tenths = F.round(ts * 10).cast("long")
    return F.format_string("%02d:%02d.%d", F.floor(tenths / 600), F.floor(tenths / 10) % 60, tenths % 10)


def clock_hms(ts: Column) -> Column:
    """HHhMMmSS"""
    s = ts.cast("long")
    return F.format_string("%02dh%02dm%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def colour_name(b: Column, g: Column, r: Column) -> Column:
    """A coarse name by hue (half degrees), saturation and value of 0..255."""
    top, low = F.greatest(b, g, r).cast("double"), F.least(b, g, r).cast("double")
    spread = top - low
    s = F.when(top > 0, spread / top * 255).otherwise(0.0)
    degrees = F.when(spread == 0, 0.0).when(top == r, (g - b) / spread * 60).when(top == g, (b - r) / spread * 60 + 120).otherwise((r - g) / spread * 60 + 240)
    h = F.round(F.when(degrees < 0, degrees + 360).otherwise(degrees) / 2) % 180
    # The upper limits of hues, and of value and saturation below.
    names = ((10, "red"), (25, "orange"), (35, "yellow"), (85, "green"), (100, "cyan"), (130, "blue"), (160, "purple"), (170, "pink"))
    out = F.when(top < 50, "black").when(F.round(s) < 45, F.when(top > 150, "white").otherwise("gray"))
    for limit, name in names:
        out = out.when(h < limit, name)
    return out.otherwise("red")
