"""JSON documents: event files, tracks, annotation tasks, manifests, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "label string, frame long, position_ms long, confidence double, team string, track_id long, source string"
DOCUMENT = f"format string, version string, match_id string, metadata map<string,string>, events array<struct<{EVENT.replace(' long', ':bigint').replace(' string', ':string').replace(' double', ':double')}>>"
ANNOTATIONS = "data struct<frame:bigint,label:string,clip:string>, annotations array<struct<was_cancelled:boolean,result:array<struct<from_name:string,value:struct<choices:array<string>>>>>>"
MANIFEST = "video_id string, title string, channel string, channel_id string, url string, license string, duration double, start_s double, end_s double, path string, query string, harvested_at string"


def osl_documents(events: DataFrame, match: str, columns: list[str], metadata: dict[str, Column] | None = None, tracking: Column | None = None) -> DataFrame:
    """A JSON document per match (match, doc); confidence has four digits, null parts are left out.

    metadata names values that are the same for all of a match's rows, such as video_path
    and fps; tracking is an array column of the same kind.
    """
    item = F.struct(*(F.round(c, 4).alias(c) if c == "confidence" else F.col(c) for c in columns))
    facts = {k: F.max(v.cast("string")).alias(f"_m{i}") for i, (k, v) in enumerate((metadata or {}).items())}
    more = [F.max_by(tracking, F.size(tracking)).alias("_tracking")] if tracking is not None else []
    g = events.groupBy(match).agg(F.collect_list(item).alias("events"), *facts.values(), *more)
    pairs = [F.struct(F.lit(k).alias("key"), F.col(f"_m{i}").alias("value")) for i, k in enumerate(facts)]
    known = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    # Name and version of the format.
    doc = F.struct(F.lit("osl-json").alias("format"), F.lit("2.0").alias("version"), F.col(match).cast("string").alias("match_id"), known.alias("metadata"), F.col("events"), (F.col("_tracking") if more else F.array().cast("array<string>")).alias("tracking"))
    return g.select(match, F.to_json(doc).alias("doc"))


def osl_events(docs: DataFrame, column: str = "doc") -> DataFrame:
    """match_id and event columns of documents, a row per event; a missing time is made from position_ms."""
    d = docs.select(F.from_json(column, DOCUMENT).alias("d")).select("d.match_id", F.explode("d.events").alias("e"))
    return d.select("match_id", "e.*")


def osl_metadata(docs: DataFrame, column: str = "doc") -> DataFrame:
    """match_id, format, version, metadata (map) of documents."""
    return docs.select(F.from_json(column, DOCUMENT).alias("d")).select("d.match_id", "d.format", "d.version", "d.metadata")


def with_timestamps(events: DataFrame) -> DataFrame:
    """timestamp_s: as it is, or from position_ms."""
    known = F.col("timestamp_s") if "timestamp_s" in events.columns else F.lit(None).cast("double")
    return events.withColumn("timestamp_s", F.coalesce(known, F.col("position_ms") / 1000.0))


def read_osl(spark: SparkSession, path: str) -> DataFrame:
    return osl_events(spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc"))


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def tracks_document(boxes: DataFrame, track: str, frame: str, sides: tuple[str, ...]) -> DataFrame:
    """track (text), samples: array of (frame, bbox) in order; rows without a box are left out."""
    some = boxes.where(F.col(sides[0]).isNotNull())
    item = F.struct(F.col(frame).alias("frame"), F.array(*sides).alias("bbox"))
    return some.groupBy(F.col(track).cast("string").alias("track")).agg(F.array_sort(F.collect_list(item)).alias("samples"))


def tracks_rows(doc: DataFrame) -> DataFrame:
    return doc.select(F.col("track").cast("long").alias("track"), F.explode("samples").alias("s")).select("track", "s.frame", "s.bbox")


def annotation_tasks(lines: DataFrame, column: str = "value") -> DataFrame:
    """data and annotations of exported tasks, one JSON object per row."""
    return lines.select(F.from_json(column, ANNOTATIONS).alias("t")).select("t.*")


def finetune_records(corrected: DataFrame) -> DataFrame:
    """JSON lines of clips and their corrected labels."""
    return corrected.select(F.to_json(F.struct(F.col("clip").alias("video"), F.col("corrected").alias("label"))).alias("value"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")


def checked_track(doc: DataFrame) -> DataFrame:
    """A ball track document's samples; an error if it has none."""
    ok = F.when(F.col("samples").isNull(), F.raise_error(F.lit("ball track without samples")).cast(doc.schema["samples"].dataType)).otherwise(F.col("samples"))
    return doc.select(F.explode(ok).alias("s")).select("s.*")


def track_duration(samples: DataFrame, key: list[str], ts: str, total_frames: Column | None = None, fps: Column | None = None) -> DataFrame:
    """key, duration_s: frames / fps if both are known and not 0, else the last time, else 0."""
    stated = F.lit(None).cast("double") if total_frames is None or fps is None else F.nullif(F.max(total_frames), F.lit(0)) / F.nullif(F.max(fps), F.lit(0))
    return samples.groupBy(*key).agg(F.coalesce(stated, F.max(ts), F.lit(0.0)).alias("duration_s"))


def sheet_layout(rows: DataFrame, position: str, columns: int = 3, lines: int = 2) -> DataFrame:
    """sheet (from 1), row, col of thumbnails numbered from 0."""
    p, per = F.col(position), columns * lines
    return rows.withColumn("sheet", F.floor(p / per) + 1).withColumn("row", F.floor((p % per) / columns)).withColumn("col", p % columns)


def choices_xml(labels: DataFrame) -> DataFrame:
    """position, line: a choice element for each label, with its hint; markup is escaped."""

    def safe(c: Column) -> Column:
        out = c
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return labels.select("position", F.concat(F.lit('<Choice value="'), safe(F.col("label")), F.lit('" hint="'), safe(F.coalesce("hint", F.lit(""))), F.lit('"/>')).alias("line"))


def ordered_lines(rows: DataFrame, order: str, line: str) -> DataFrame:
    """One text with the lines in order; for reports of bounded length."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias("text"))


def sampled(frames: DataFrame, frame: str, every: int, start: int = 0, end: int | None = None) -> DataFrame:
    """Every n-th frame from start; end 0 or None means all."""
    out = frames.where((F.col(frame) >= start) & ((F.col(frame) - start) % every == 0))
    return out.where(F.col(frame) < end) if end else out


def numbered(rows: DataFrame, key: list[str], order: str, out: str = "position") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1)


# Documents of other makers and of the command line, one JSON text each.

HOMOGRAPHIES = "video string, fps double, source string, homographies array<struct<frame:bigint,timestamp_s:double,H:array<array<double>>>>"
JERSEYS = "video string, model string, tracks map<string,struct<jersey:int,confidence:double,n_obs:bigint,legible_frac:double,name:string>>"
CANDIDATES = "video string, fps double, sample_fps double, sample_interval bigint, total_candidates bigint, candidates array<struct<frame:bigint,timestamp_s:double,timestamp_hms:string,ball_conf:double,ball_px:double,ball_py:double,goal_zone:string,field_x_m:double,field_y_m:double>>"
CUTS = "video string, duration_s double, kept_s double, removed_s double, removed array<struct<start_s:double,end_s:double,duration_s:double,reason:string>>, keep array<struct<start_s:double,end_s:double,duration_s:double>>"
_KEEP_NULLS = {"ignoreNullFields": "false"}


def homography_document(rows: DataFrame, key: str, frame: str = "frame", ts: str = "timestamp_s", h: str = "h", fps: Column | None = None) -> DataFrame:
    """key, doc: a match's homographies (nine numbers, or null where registration failed) in order of frames, as rows of three."""
    nested = F.when(F.col(h).isNotNull(), F.array(*(F.slice(F.col(h), i, 3) for i in (1, 4, 7))))
    item = F.struct(F.col(frame).cast("long").alias("frame"), F.round(ts, 3).alias("timestamp_s"), nested.alias("H"))
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("homographies"), F.max(F.lit(None).cast("double") if fps is None else fps).alias("fps"))
    # Fixed value: the name that readers of this format expect as its source.
    doc = F.struct(F.col(key).cast("string").alias("video"), "fps", F.lit("KpSFR").alias("source"), "homographies")
    return g.select(key, F.to_json(doc, _KEEP_NULLS).alias("doc"))


def homographies(docs: DataFrame, column: str = "doc") -> DataFrame:
    """video, frame, timestamp_s, h (nine numbers or null) of homography documents."""
    d = docs.select(F.from_json(column, HOMOGRAPHIES).alias("d")).select("d.video", F.explode("d.homographies").alias("e"))
    return d.select("video", "e.frame", "e.timestamp_s", F.flatten("e.H").alias("h"))


def jerseys_document(votes: DataFrame, video: str, model: str = "parseq") -> DataFrame:
    """video, doc: a video's voted jerseys by track; shares have three digits, a jersey that isn't known is null."""
    item = F.struct("jersey", F.round("confidence", 3).alias("confidence"), "n_obs", F.round("legible_frac", 3).alias("legible_frac"), "name")
    tracks = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("track").cast("string").alias("key"), item.alias("value")))))
    g = votes.groupBy(video).agg(tracks.alias("tracks"))
    return g.select(video, F.to_json(F.struct(F.col(video).cast("string").alias("video"), F.lit(model).alias("model"), "tracks"), _KEEP_NULLS).alias("doc"))


def jerseys(docs: DataFrame, column: str = "doc") -> DataFrame:
    """track, jersey, confidence, n_obs, legible_frac, name of jersey documents."""
    d = docs.select(F.explode(F.from_json(column, JERSEYS)["tracks"]).alias("track", "e"))
    return d.select(F.col("track").cast("long").alias("track"), "e.*")


def stats_document(match_id: str, events: DataFrame, distances: DataFrame, teams: dict[str, str] | None = None) -> DataFrame:
    """doc: a match's event counts, by label and by label and team, and distances (one digit) by player."""
    e = events.withColumn("team", F.coalesce("team", F.lit("unknown")))
    per = e.groupBy("label", "team").agg(F.count("*").alias("n"))
    by_team = per.groupBy("label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("team", "n")))).alias("teams"), F.sum("n").alias("n"))
    counts = by_team.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("event_counts"), F.map_from_entries(F.collect_list(F.struct("label", "teams"))).alias("event_counts_by_team"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"))
    far = distances.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("track").cast("string").alias("k"), F.round("distance", 1).alias("v"))))).alias("distance_per_player"))
    known = F.map_from_arrays(F.array(*map(F.lit, teams)), F.array(*map(F.lit, teams.values()))) if teams else F.create_map().cast("map<string,string>")
    doc = F.struct(F.lit(match_id).alias("match_id"), "total_events", "event_counts", "event_counts_by_team", known.alias("teams"), "distance_per_player")
    return counts.crossJoin(far).select(F.to_json(doc).alias("doc"))  # one row each


def cuts_document(removed: DataFrame, kept: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """key, doc: the edit list of each match in seconds (three digits), from what a trim plan holds in milliseconds."""
    s = lambda c: F.round(F.col(c) / 1000.0, 3)
    span = [s("start_ms").alias("start_s"), s("end_ms").alias("end_s"), F.round((F.col("end_ms") - F.col("start_ms")) / 1000.0, 3).alias("duration_s")]
    r = removed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*span, "reason"))).alias("removed"))
    k = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*span))).alias("keep"))
    t = totals.join(r, key, "left").join(k, key, "left")
    doc = F.struct(F.col(key).cast("string").alias("video"), s("total_ms").alias("duration_s"), s("kept_ms").alias("kept_s"), s("removed_ms").alias("removed_s"), F.coalesce("removed", F.array()).alias("removed"), F.coalesce("keep", F.array()).alias("keep"))
    return t.select(key, F.to_json(doc).alias("doc"))


def cuts(docs: DataFrame, column: str = "doc") -> DataFrame:
    """video, start_s, end_s, duration_s, reason of the removed parts of edit lists."""
    d = docs.select(F.from_json(column, CUTS).alias("d")).select("d.video", F.explode("d.removed").alias("e"))
    return d.select("video", "e.*")


def candidates_document(rows: DataFrame, key: str, fps: float, sample_fps: float) -> DataFrame:
    """key, doc: candidate set pieces (frame, ts, conf, px, py, zone, fx, fy) as the older tools exchange them."""
    ts = F.col("ts")
    clock = F.concat(F.lpad(F.floor(ts / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.format_number(ts % 60, 1), 4, "0"))
    item = F.struct(
        F.col("frame").cast("long").alias("frame"), F.round(ts, 2).alias("timestamp_s"), clock.alias("timestamp_hms"), F.round("conf", 3).alias("ball_conf"),
        F.round("px", 1).alias("ball_px"), F.round("py", 1).alias("ball_py"), F.col("zone").alias("goal_zone"), F.round("fx", 2).alias("field_x_m"), F.round("fy", 2).alias("field_y_m"),
    )
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    doc = F.struct(F.col(key).cast("string").alias("video"), F.lit(fps).alias("fps"), F.lit(sample_fps).alias("sample_fps"), F.greatest(F.lit(1), F.bround(F.lit(fps / sample_fps)).cast("int")).alias("sample_interval"), F.size("candidates").alias("total_candidates"), "candidates")
    return g.select(key, F.to_json(doc).alias("doc"))


def candidates(docs: DataFrame, column: str = "doc") -> DataFrame:
    """video and the columns of each candidate of candidate documents."""
    d = docs.select(F.from_json(column, CANDIDATES).alias("d")).select("d.video", F.explode("d.candidates").alias("e"))
    return d.select("video", "e.*")


def write_tracklets(rows: DataFrame, manifest: DataFrame, path: str, game: str = "game_key") -> None:
    """The tracklet table as Parquet by game, and its manifest (a row per game) as JSON lines beside it."""
    rows.write.mode("append").partitionBy(game).parquet(f"{path}/tracklets")
    manifest.write.mode("append").json(f"{path}/manifest")


def read_tracklets(spark: SparkSession, path: str, game: str | None = None) -> DataFrame:
    """The tracklet table, or one game's part of it."""
    rows = spark.read.parquet(f"{path}/tracklets")
    return rows if game is None else rows.where(F.col("game_key") == game)
