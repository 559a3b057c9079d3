"""Votes, sampling and colours per track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import lab_colour
from ..functions.labels import colour_name


def weighted_vote(reads: DataFrame, key: list[str], number: str = "number", conf: str = "conf", min_votes: int = 3, min_share: float = 0.5, min_margin: float = 0.15) -> DataFrame:
    """key, jersey, confidence, n_obs, legible_frac.

    Numbers weigh the sum of their confidences (negative ones count 0). jersey is null with
    too few reads (confidence 0), without weight, or if the first number's share or its
    lead over the second is too small; the share stays as confidence. Of equal weights the
    smaller number leads.
    """
    per = reads.groupBy(*key, number).agg(F.count("*").alias("_n"), F.sum(F.greatest(F.lit(0.0), F.coalesce(conf, F.lit(0.0)))).alias("_w"))
    heavy = F.when(F.col(number).isNotNull(), F.col("_w"))
    w = Window.partitionBy(*key).orderBy(heavy.desc_nulls_last(), F.col(number))
    r = per.withColumn("_rank", F.row_number().over(w)).withColumn("_w", heavy)
    g = r.groupBy(*key).agg(
        F.sum("_n").alias("n_obs"), F.sum("_w").alias("_total"), F.coalesce(F.sum(F.when(F.col(number).isNotNull(), F.col("_n"))), F.lit(0)).alias("_legible"),
        F.max(F.when(F.col("_rank") == 1, F.col(number))).alias("_top"), F.max(F.when(F.col("_rank") == 1, F.col("_w"))).alias("_w1"), F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("_w"))), F.lit(0.0)).alias("_w2"),
    )
    usable = (F.col("n_obs") >= min_votes) & (F.coalesce("_total", F.lit(0.0)) > 0)
    share, lead = F.col("_w1") / F.col("_total"), (F.col("_w1") - F.col("_w2")) / F.col("_total")
    jersey = F.when(usable & (share >= min_share) & (lead >= min_margin), F.col("_top"))
    return g.select(*key, jersey.alias("jersey"), F.when(usable, share).otherwise(0.0).alias("confidence"), "n_obs", (F.col("_legible") / F.col("n_obs")).alias("legible_frac"))


def stride_sample(df: DataFrame, key: list[str], order: str, most: int = 40) -> DataFrame:
    """Every step-th row of a key, where step is its row count div most (1 at least)."""
    w = Window.partitionBy(*key)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most))
    return df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_step", step).where(F.col("_i") % F.col("_step") == 0).drop("_i", "_step")


def track_colours(samples: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """key, b, g, r (medians), colour of tracks with least samples."""
    g = samples.groupBy(*key).agg(F.median("b").alias("b"), F.median("g").alias("g"), F.median("r").alias("r"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return g.withColumn("colour", colour_name(F.col("b"), F.col("g"), F.col("r")))


def two_teams(medians: DataFrame, key: list[str], columns: tuple[str, str, str] = ("b", "g", "r"), rounds: int = 20) -> DataFrame:
    """key, cluster (team_a, team_b), team: tracks in two clusters of colour, named after the mean colour.

    Two means in L, a, b from fixed starts: the darkest and the lightest track (ties by
    the other axes, then by key); a track as near to both goes with the first. Each round is
    one aggregation to two rows of means. A lone track is team_a.
    """
    axes = ("_l", "_a", "_b")
    # a row per track of one match, read again in each round
    lab = medians.withColumns(dict(zip(axes, lab_colour(*(F.col(c) for c in columns)), strict=True))).persist()
    place = F.struct(*axes, *key)
    ends = lab.agg(F.min(place).alias("a"), F.max(place).alias("b")).first()
    if ends["a"] is None:
        return medians.select(*key, F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("string").alias("team"))
    centres = [[float(ends[n][x]) for x in axes] for n in ("a", "b")]

    def second(c: list[list[float]]) -> F.Column:
        away = [sum((F.col(x) - v) * (F.col(x) - v) for x, v in zip(axes, own, strict=True)) for own in c]
        return away[1] < away[0]

    for _ in range(rounds):
        means = lab.groupBy(second(centres).alias("s")).agg(*(F.avg(x).alias(x) for x in axes)).collect()  # two rows
        new = [next(([float(m[x]) for x in axes] for m in means if m["s"] == side), centres[side]) for side in (False, True)]
        if new == centres:
            break
        centres = new
    c = lab.withColumn("_s", second(centres))
    mean = c.groupBy("_s").agg(*(F.avg(x).alias(x) for x in columns))
    names = mean.select("_s", F.when(F.col("_s"), "team_b").otherwise("team_a").alias("cluster"), colour_name(*(F.col(x) for x in columns)).alias("team"))
    return c.join(F.broadcast(names), "_s").select(*key, "cluster", "team")  # two rows
