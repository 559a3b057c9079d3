"""Where pixels and models plug in: they give or take rows, the rest is relational.

No weights, codecs or network come with this package; tests use stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

DETECTIONS = "path string, frame long, det long, class_id int, x1 double, y1 double, x2 double, y2 double, confidence double"
READS = "path string, number int, conf double"


@runtime_checkable
class FrameModel(Protocol):
    """Loaded once per worker; called with a batch of images' bytes."""

    def __call__(self, images: list[bytes]) -> list[list[dict[str, Any]]]: ...


def infer(images: DataFrame, load: Callable[[], FrameModel], schema: str, carry: tuple[str, ...] = ("path",)) -> DataFrame:
    """Rows that a model finds in images (columns carry and content)."""

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            rows = b.to_pylist()
            found = [{**{c: r[c] for c in carry}, **x} for r, own in zip(rows, model([r["content"] for r in rows]), strict=True) for x in own]
            yield pa.RecordBatch.from_pylist(found, arrow)

    return images.select(*carry, "content").mapInArrow(run, schema)


def listing(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """path and name of files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def video_metadata(files: DataFrame, probe: Callable[[str], dict[str, float]]) -> DataFrame:
    """path, fps, total_frames, width, height, duration by a probe that workers can call; it raises FileNotFoundError for a file that isn't there."""

    schema = "path string, fps double, total_frames long, width int, height int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"path": p, **probe(p)} for p in b.column(0).to_pylist()], arrow)

    return files.select("path").mapInArrow(run, schema).withColumn("duration", F.col("total_frames") / F.col("fps"))


def cut_commands(cuts: DataFrame) -> DataFrame:
    """cuts (path, out, start_s, duration_s) with the arguments of an external cutter."""
    start = F.format_string("%.3f", F.greatest(F.lit(0.0), "start_s"))
    return cuts.withColumn("args", F.array(F.lit("-ss"), start, F.lit("-i"), "path", F.lit("-t"), F.format_string("%.3f", "duration_s"), "out"))


def concat_commands(parts: DataFrame, key: list[str], order: str) -> DataFrame:
    """key, list, args: how an external tool joins the clips of each key in order; a single clip is copied."""
    g = parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "path"))), lambda p: p["path"]).alias("_paths"))
    quoted = F.transform("_paths", lambda p: F.concat(F.lit("file '"), F.replace(p, F.lit("'"), F.lit("'\\''")), F.lit("'")))
    out = F.concat(*(F.col(k).cast("string") for k in key), F.lit(".mp4"))
    joined = F.array(F.lit("-f"), F.lit("concat"), F.lit("-safe"), F.lit("0"), F.lit("-i"), F.lit("list.txt"), F.lit("-c"), F.lit("copy"), out)
    return g.select(*key, F.array_join(quoted, "\n").alias("list"), F.when(F.size("_paths") == 1, F.array(F.lit("-i"), F.col("_paths")[0], F.lit("-c"), F.lit("copy"), out)).otherwise(joined).alias("args"))


def frame(frames: DataFrame, n: int, column: str = "frame") -> DataFrame:
    """One frame of a table of decoded frames; no row if it isn't there."""
    return frames.where(F.col(column) == n)


def ask_context(events: DataFrame, columns: tuple[str, ...] = ("frame", "label", "timestamp_s", "confidence")) -> DataFrame:
    """events with prompt: what a language model is told of each event, and the form of its reply."""
    facts = F.to_json(F.struct(*(c for c in columns if c in events.columns)))
    return events.withColumn("prompt", F.concat(F.lit("Event: "), facts, F.lit('\nReply with JSON: {"verified": true or false, "reason": "..."}')))


class Unavailable:
    """A model that has a place here but doesn't come with the package."""

    def __init__(self, name: str, module: str):
        self.name, self.module = name, module

    def is_available(self) -> bool:
        from importlib.util import find_spec

        return find_spec(self.module) is not None


#: Adapters of outside trackers and segmenters.
ADAPTERS = {"gamestate": Unavailable("gamestate", "tracklab"), "sam3": Unavailable("sam3", "sam3")}


def classify_reply(replies: DataFrame, column: str, schema: str) -> DataFrame:
    """A model's reply as a struct: the JSON between its outer braces, null if there is none."""
    inner = F.regexp_extract(column, r"(?s)\{.*\}", 0)
    return replies.withColumn("reply", F.when(inner != "", F.from_json(inner, schema)))
