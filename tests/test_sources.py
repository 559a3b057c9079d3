"""Round trips of documents and the store, plug-ins and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchlake.operators.sequence import greedy_dedup
from pitchlake.sources import documents, plugins, profiles
from pitchlake.sources.store import Store
from pitchlake.streaming import online


def test_event_document_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(1, "shot", 5, 1234, 0.123456), (1, "goal", None, 99, None)], "match_id long, label string, frame long, position_ms long, confidence double")
    docs = documents.osl_documents(e, "match_id", ["label", "frame", "position_ms", "confidence"])
    assert '"frame"' in docs.first().doc and docs.first().doc.count('"confidence"') == 1
    docs.select("doc").write.text(f"file://{tmp_path}/osl")
    back = documents.with_timestamps(documents.read_osl(spark, f"file://{tmp_path}/osl/*.txt")).collect()
    assert sorted((r.label, r.frame, r.confidence, r.timestamp_s) for r in back) == [("goal", None, None, 0.099), ("shot", 5, 0.1235, 1.234)]


def test_tracks_round_trip(spark):
    b = spark.createDataFrame([(3, 2, 1.0, 2.0), (3, 0, 5.0, 6.0), (4, 1, None, None)], "track long, frame long, x double, y double")
    doc = documents.tracks_document(b, "track", "frame", ("x", "y"))
    assert [s.frame for s in doc.first().samples] == [0, 2]
    assert sorted((r.track, r.frame, r.bbox) for r in documents.tracks_rows(doc).collect()) == [(3, 0, [5.0, 6.0]), (3, 2, [1.0, 2.0])]


def test_track_needs_samples(spark):
    doc = spark.createDataFrame([(None,)], "samples array<struct<frame:bigint>>")
    with pytest.raises(Exception, match="without samples"):
        documents.checked_track(doc).collect()


def test_manifest_and_queries(spark, tmp_path):
    path = f"file://{tmp_path}/manifest"
    row = spark.createDataFrame([("a", "t", "c", None, "u", "CC", 9.0, 0.0, 9.0, "p", "q", "2024")], documents.MANIFEST)
    documents.append_manifest(row, path)
    documents.append_manifest(row.withColumn("video_id", F.lit("b")), path)
    assert sorted(r.video_id for r in documents.read_manifest(spark, path).collect()) == ["a", "b"]
    (tmp_path / "q.txt").write_text(" one \n\n two\n")
    assert sorted(r.query for r in documents.read_queries(spark, f"file://{tmp_path}/q.txt").collect()) == ["one", "two"]


def test_choices_are_escaped(spark):
    rows = spark.createDataFrame([(0, "a<b", 'say "x" & y'), (1, "c", None)], "position int, label string, hint string")
    text = documents.ordered_lines(documents.choices_xml(rows), "position", "line").first().text
    assert text.split("\n") == ['<Choice value="a&lt;b" hint="say &quot;x&quot; &amp; y"/>', '<Choice value="c" hint=""/>']


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    m = spark.createDataFrame([("m1", "raw")], "match_id string, raw_path string")
    s.append("matches", m)
    with pytest.raises(ValueError):
        s.append("matches", m)
    e = spark.createDataFrame([("m1", "shot", 900, "Red"), ("m1", "goal", 100, "blue"), ("m2", "shot", 5, "red")], "match_id string, label string, position_ms long, team string")
    s.append("events", e)
    rows = s.events("m1").collect()
    assert [r.label for r in rows] == ["goal", "shot"] and all(len(r.id) == 16 and r.verified is False for r in rows)
    assert s.events("m1", team="RED").count() == 1 and s.match("m1").count() == 1 and s.clips("m1").count() == 0


def test_profiles(spark):
    assert profiles.roster(spark, {"roster": [{"jersey": 7, "name": "A"}]}).first().jersey == 7
    assert profiles.roster(spark, None).count() == 0 and profiles.run_paths("runs", "m")["stats"] == "runs/m/stats.json"


def test_plugins(spark, tmp_path):
    for n in ("b.mp4", "a.mp4", "c.txt"):
        (tmp_path / n).write_bytes(b"xyz")
    files = plugins.listing(spark, f"file://{tmp_path}")
    assert sorted(r.name for r in files.collect()) == ["a.mp4", "b.mp4"]
    images = spark.createDataFrame([("p", bytearray(b"12")), ("q", bytearray(b""))], "path string, content binary")

    def load():
        return lambda images: [[{"number": len(x), "conf": 0.5}] if len(x) else [] for x in images]

    assert [tuple(r) for r in plugins.infer(images, load, plugins.READS).collect()] == [("p", 2, 0.5)]
    meta = plugins.video_metadata(files, lambda p: {"fps": 30.0, "total_frames": 300, "width": 9, "height": 5}).collect()
    assert {r.duration for r in meta} == {10.0}
    replies = spark.createDataFrame([('{"ok": true}',), ('Sure: {"ok": false} done',), ("none",)], "t string")
    assert [r.reply.ok if r.reply else None for r in plugins.classify_reply(replies, "t", "ok boolean").collect()] == [True, False, None]
    cuts = spark.createDataFrame([("in.mp4", "out.mp4", -2.0, 35.0)], "path string, out string, start_s double, duration_s double")
    assert plugins.cut_commands(cuts).first().args == ["-ss", "0.000", "-i", "in.mp4", "-t", "35.000", "out.mp4"]


def test_stream_matches_batch(spark, tmp_path):
    rows = [(k, t, t // 10) for k in (1, 2) for t in range(0, 40_000, 1700 * k)]
    src = tmp_path / "in"
    src.mkdir()
    cut = 20_000
    for i, part in enumerate(([r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut])):
        pd.DataFrame(part, columns=["match_id", "ts_ms", "frame"]).to_parquet(src / f"{i}.parquet")
    stream = spark.readStream.schema("match_id long, ts_ms long, frame long").option("maxFilesPerTrigger", 1).parquet(f"file://{src}")
    q = online.greedy_dedup(stream).writeStream.format("memory").queryName("taken").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = greedy_dedup(spark.createDataFrame(rows, "match_id long, ts_ms long, frame long"), ["match_id"])
    assert sorted(map(tuple, spark.table("taken").collect())) == sorted(map(tuple, batch.select("match_id", "ts_ms", "frame").collect()))


def run_stream(spark, rows, schema, make, tmp_path, name):
    """Rows in two files, then one that moves the watermark past everything."""
    src = tmp_path / name
    src.mkdir()
    cut = len(rows) // 2
    for i, part in enumerate((rows[:cut], rows[cut:], [(9, pd.Timestamp("2030-01-01"), False)])):
        pd.DataFrame(part, columns=["match_id", "ts", "visible"]).astype({"ts": "datetime64[us]"}).to_parquet(src / f"{i}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{src}")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return sorted(map(tuple, spark.table(name).where("match_id < 9").collect()))


def test_windows_and_sessions_match_batch(spark, tmp_path):
    start = pd.Timestamp("2024-05-01 10:00:00")
    rows = [(k, start + pd.Timedelta(milliseconds=700 * i), (i // 9 + k) % 3 != 0) for i in range(60) for k in (1, 2)]
    schema = "match_id long, ts timestamp, visible boolean"
    batch = spark.createDataFrame([(k, t.to_pydatetime(), v) for k, t, v in rows], schema)
    for name, make in (("spans", online.windows), ("dead", online.sessions)):
        assert run_stream(spark, rows, schema, make, tmp_path, name) == sorted(map(tuple, make(batch).collect())) != []


def test_document_metadata(spark):
    e = spark.createDataFrame([(1, "shot", 5, "v.mp4"), (2, "goal", 6, None)], "match_id long, label string, position_ms long, video string")
    docs = documents.osl_documents(e, "match_id", ["label", "position_ms"], {"video_path": F.col("video"), "fps": F.lit(25.0)})
    got = {r.match_id: r for r in documents.osl_metadata(docs).collect()}
    assert got["1"].metadata == {"video_path": "v.mp4", "fps": "25.0"} and got["2"].metadata == {"fps": "25.0"}
    assert got["1"].format == "osl-json" and got["1"].version == "2.0" and '"tracking":[]' in docs.first().doc


def test_yaml_profile(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text("team_name: A\nroster:\n  - name: Ada\n    jersey: 7\n    role: mid\n  - name: Zoe\n")
    (tmp_path / "empty.yaml").write_text("")
    p = profiles.read_yaml(str(tmp_path / "p.yaml"))
    assert sorted((r.name, r.jersey, r.role) for r in profiles.roster(spark, p).collect()) == [("Ada", 7, "mid"), ("Zoe", None, None)]
    assert profiles.read_yaml(str(tmp_path / "empty.yaml")) == {}


def test_tracklets_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("g1", 1, 2.0), ("g2", 1, 3.0)], "game_key string, frame long, x double")
    path = f"file://{tmp_path}/t"
    documents.write_tracklets(rows, spark.createDataFrame([("g1", 30.0)], "game_key string, fps double"), path)
    assert documents.read_tracklets(spark, path).count() == 2 and documents.read_tracklets(spark, path, "g2").first().x == 3.0


def test_reels(spark):
    parts = spark.createDataFrame([("r", 2, "b's.mp4"), ("r", 1, "a.mp4"), ("s", 1, "c.mp4")], "reel string, n int, path string")
    got = {r.reel: r for r in plugins.concat_commands(parts, ["reel"], "n").collect()}
    assert got["r"].list == "file 'a.mp4'\nfile 'b'\\''s.mp4'" and got["r"].args[:2] == ["-f", "concat"]
    assert got["s"].args == ["-i", "c.mp4", "-c", "copy", "s.mp4"]
    assert not plugins.ADAPTERS["sam3"].is_available()
    e = spark.createDataFrame([(3, "shot")], "frame long, label string")
    assert '"label":"shot"' in plugins.ask_context(e).first().prompt and plugins.frame(e, 4).count() == 0
