"""Pairing events with clips, verdicts and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_clips(events: DataFrame, clips: DataFrame, run: str, most: float = 2.0) -> DataFrame:
    """run, idx, clip: an event's clip has its index and a time within most seconds; events
    left over take, in order, the nearest clip that no one has, within most; else null.

    events has (run, idx, ts), clips (run, idx, ts, name). The first pass is an equi join;
    only what it leaves goes through a loop per run.
    """
    e, c = events.select(run, "idx", "ts"), clips.select(run, F.col("idx").alias("_cidx"), F.col("ts").alias("_cts"), "name")
    j = e.join(c, (e[run] == c[run]) & (e["idx"] == c["_cidx"]) & (F.abs(e["ts"] - c["_cts"]) <= most))
    first = j.groupBy(e[run], e["idx"]).agg(F.min("name").alias("clip"))
    rest = e.join(first, [run, "idx"], "left_anti")
    free = c.join(first.select(run, F.col("clip").alias("name")), [run, "name"], "left_anti")
    item = F.struct(F.lit(0).alias("kind"), "ts", "idx", F.lit(None).cast("string").alias("name"))
    both = rest.select(run, item.alias("x")).unionByName(free.select(run, F.struct(F.lit(1).alias("kind"), F.col("_cts").alias("ts"), F.col("_cidx").alias("idx"), "name").alias("x")))
    kind = dict(e.dtypes)

    def greedy(pdf):
        from bisect import bisect_left

        import pandas as pd

        rows = pdf["x"].tolist()
        free = sorted((r["ts"], r["name"]) for r in rows if r["kind"] == 1)
        times = [t for t, _ in free]
        up, down = list(range(len(free) + 1)), list(range(len(free) + 1))  # next free clip from a place on; number of clips up to the last free one before it

        def root(links: list[int], i: int) -> int:
            while links[i] != i:
                links[i] = links[links[i]]
                i = links[i]
            return i

        out = []
        for r in sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["idx"]):
            at, found = bisect_left(times, r["ts"]), []
            after, before = root(up, at), root(down, at)
            if after < len(free):
                found.append(after)
            if before > 0:  # of clips at one time the first name that is free
                found.append(root(up, bisect_left(times, times[before - 1])))
            best = min(found, key=lambda i: (abs(times[i] - r["ts"]), free[i][1]), default=None)
            if best is not None and abs(times[best] - r["ts"]) <= most:
                up[best], down[best + 1] = best + 1, best
            else:
                best = None
            out.append((pdf[run].iloc[0], r["idx"], free[best][1] if best is not None else None))
        return pd.DataFrame(out, columns=[run, "idx", "clip"])

    second = both.groupBy(run).applyInPandas(greedy, f"{run} {kind[run]}, idx {kind['idx']}, clip string")
    return first.unionByName(second)


def patch_verified(events: DataFrame, verified: DataFrame, rejected: DataFrame) -> DataFrame:
    """Events whose frame isn't null and wasn't rejected, or was verified too; verified is set for verified frames."""
    v = verified.select("frame").distinct().withColumn("_v", F.lit(True))
    r = rejected.select("frame").distinct().withColumn("_r", F.lit(True))
    j = events.where("frame is not null").join(v, "frame", "left").join(r, "frame", "left")
    return j.where("_r is null or _v").withColumn("verified", F.coalesce("_v", F.lit(False))).drop("_v", "_r")


def annotate(events: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """events with the last result of their frame as a struct; verified if it was CONFIRMED."""
    rest = [c for c in results.columns if c not in ("frame", order)]
    last = results.groupBy("frame").agg(F.max_by(F.struct(*rest), order).alias("review"))
    return events.join(last, "frame", "left").withColumn("verified", F.coalesce(F.col("review.verdict") == "CONFIRMED", F.lit(False)))


def tasks(events: DataFrame, pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review tasks of events that have a clip; missing parts are an en dash."""
    none = F.lit("—")
    j = events.join(pairs.where("clip is not null"), ["run", "idx"]).join(reviews.select("frame", "verdict", "caption"), "frame", "left")
    return j.select("run", "idx", "frame", "label", "clip", F.coalesce("verdict", none).alias("verdict"), F.coalesce("caption", none).alias("caption"))


def corrected_labels(export: DataFrame) -> DataFrame:
    """frame, clip, label, corrected of exported tasks: the first label choice of the first
    annotation that wasn't cancelled; tasks without one are left out.

    export: data struct<frame, label, clip>, annotations array<struct<was_cancelled,
    result array<struct<from_name, value struct<choices array<string>>>>>>.
    """
    done = F.filter("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    picks = F.filter(F.get(done, F.lit(0))["result"], lambda r: r["from_name"] == "label")
    label = F.get(F.get(picks, F.lit(0))["value"]["choices"], F.lit(0))
    return export.withColumn("_label", label).where("_label is not null").select("data.frame", "data.clip", F.col("data.label").alias("label"), F.col("_label").alias("corrected"))


def tally(rows: DataFrame, column: str = "verdict") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
