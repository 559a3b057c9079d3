"""Admission of candidate videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import off_topic, open_licence


def admission(candidates: DataFrame, manifest: DataFrame, order: str, per_channel: int = 2, target: int = 200, min_duration: float = 300.0) -> DataFrame:
    """candidates with reason: seen, unresolvable, license, off_topic, too_short, channel_cap, kept or target.

    candidates: id, title, description, channel, license, duration (null if it can't be
    resolved); manifest: id, channel of what was kept before, which counts toward the
    caps. The first reason that fits counts; an id counts as seen from its second row on.
    """
    # judged by its own columns first: titles and descriptions needn't go through the shuffles
    own = (
        F.when(F.col("duration").isNull(), "unresolvable")
        .when(~open_licence(F.col("license")), "license")
        .when(off_topic(F.col("title"), F.col("description")), "off_topic")
        .when(F.col("duration") < min_duration, "too_short")
    )
    known = manifest.select(F.col("id").alias("_mid")).distinct().withColumn("_seen", F.lit(True))
    w = Window.partitionBy("id").orderBy(order)
    # a row's own number tells apart rows of one id, also where order has ties
    c = candidates.withColumn("_own", own).withColumn("_nth", F.row_number().over(w)).join(known, F.col("id") == F.col("_mid"), "left").drop("_mid")
    c = c.withColumn("_early", F.when(F.coalesce("_seen", F.lit(False)) | (F.col("_nth") > 1), "seen").otherwise(F.col("_own")))
    before = manifest.groupBy(F.col("channel").alias("_mc")).agg(F.count("*").alias("_had"))
    c = c.join(before, c["channel"].eqNullSafe(F.col("_mc")), "left")
    turn = F.row_number().over(Window.partitionBy("channel", F.col("_early").isNull()).orderBy(order, "id"))
    c = c.withColumn("_ok", F.col("_early").isNull() & (turn + F.coalesce("_had", F.lit(0)) <= per_channel))
    # the first target rows that pass, with their turn: at most target rows; the ledger's size is one row
    passed = c.where("_ok").select(F.col("id").alias("_pid"), order).orderBy(order, "_pid").limit(target)
    passed = passed.withColumn("_in", F.row_number().over(Window.orderBy(order, "_pid"))).select("_pid", "_in")
    c = c.join(passed, F.col("_ok") & (F.col("id") == F.col("_pid")), "left").crossJoin(F.broadcast(manifest.agg(F.count("*").alias("_all"))))
    reason = F.coalesce("_early", F.when(~F.col("_ok"), "channel_cap").when(F.col("_in").isNotNull() & (F.col("_in") + F.col("_all") <= target), "kept").otherwise("target"))
    return c.select(*candidates.columns, reason.alias("reason"))


def counters(admitted: DataFrame) -> DataFrame:
    """One row: how many candidates, and how many for each reason."""
    kinds = ("seen", "unresolvable", "license", "off_topic", "too_short", "channel_cap", "kept")
    return admitted.agg(F.count("*").alias("candidates"), *(F.count_if(F.col("reason") == k).alias(k) for k in kinds))


def channel_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(F.coalesce("channel_id", "channel").alias("channel")).agg(F.count("*").alias("n"))


def attribution_lines(manifest: DataFrame) -> DataFrame:
    """id, line: a credit of each source."""
    return manifest.select("id", F.concat(F.lit("- **"), "title", F.lit("** — "), "channel", F.lit(" (["), F.col("id").cast("string"), F.lit("]("), "url", F.lit(")), "), "license").alias("line"))
