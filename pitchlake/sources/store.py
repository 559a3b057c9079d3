"""The match store: Parquet tables by match, appended to, with ids that follow from content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "matches": "match_id string, raw_path string, proxy_path string, processed_at timestamp, osl_path string, stats_path string",
    "players": "id string, name string, jersey int, team string, profile_id string",
    "events": "id string, match_id string, label string, position_ms long, frame long, confidence double, team string, track_id long, player_id string, source string, phase string, verified boolean",
    "clips": "id string, match_id string, event_id string, player_id string, track_id long, team string, path string, pre_s double, post_s double",
    "idp_links": "player_id string, focus_skill string, clip_id string, notes string",
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str) -> DataFrame:
        if not self._exists(table):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(self._path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        """Columns that rows lack are null; missing ids are hashes of the row's identity."""
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        if table == "matches":
            known = self.read(table).select("match_id")
            if not rows.join(known, "match_id", "left_semi").isEmpty():
                raise ValueError("a match with this id is stored already")
        if "id" in schema.names and "id" not in rows.columns:
            parts = [c for c in ("match_id", "label", "frame", "position_ms", "event_id", "path", "name", "jersey") if c in rows.columns]
            rows = rows.withColumn("id", F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16))
        out = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        if "verified" in schema.names:
            out = out.withColumn("verified", F.coalesce("verified", F.lit(False)))
        w = out.write.mode("append")
        (w.partitionBy("match_id") if "match_id" in schema.names and table != "matches" else w).parquet(self._path(table))

    def events(self, match_id: str, label: str | None = None, team: str | None = None, track_id: int | None = None) -> DataFrame:
        """A match's events in order of time; team ignores case. The match prunes partitions."""
        e = self.read("events").where(F.col("match_id") == match_id)
        if label is not None:
            e = e.where(F.col("label") == label)
        if team is not None:
            e = e.where(F.lower("team") == team.lower())
        if track_id is not None:
            e = e.where(F.col("track_id") == track_id)
        return e.orderBy("position_ms", "id")

    def clips(self, match_id: str) -> DataFrame:
        return self.read("clips").where(F.col("match_id") == match_id)

    def match(self, match_id: str) -> DataFrame:
        return self.read("matches").where(F.col("match_id") == match_id)
