"""Views of the driver's tables in the shapes that the operators take, as SQL for either engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import load

_K = {"spark": "CAST(get_json_object(props, '$.k') AS BIGINT)", "duck": "CAST(json_extract_string(props, '$.k') AS BIGINT)"}
_ARRAY = {"spark": "transform(slice(embedding, 1, 9), x -> CAST(x AS DOUBLE))", "duck": "[CAST(x AS DOUBLE) for x in embedding[1:9]]"}

#: view: (tables it reads, SQL)
VIEWS = {
    "samples": (("events",), """
        SELECT CAST(user_id % 8 AS BIGINT) AS match_id, event_id AS frame,
          CAST((row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1) * 200 AS BIGINT) AS ts_ms,
          event_type <> 'error' AS visible, value AS px, CAST({k} AS DOUBLE) AS py, value % 55 AS fx, CAST({k} % 36 AS DOUBLE) AS fy,
          CAST(0.5 AS DOUBLE) AS conf FROM events"""),
    "players": (("lineitem",), """
        SELECT l_orderkey AS frame, l_suppkey AS track, min(l_quantity) AS fx, CAST(min(l_partkey % 36) AS DOUBLE) AS fy
        FROM lineitem GROUP BY l_orderkey, l_suppkey"""),
    "teams": (("supplier", "nation"), "SELECT s_suppkey AS track, n_name AS team FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "boxes": (("lineitem",), """
        SELECT l_orderkey AS frame, l_suppkey AS det,
          min(CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 WHEN l_linenumber % 2 = 0 THEN 2 ELSE 3 END) AS class_id,
          CAST(min(l_partkey % 1900) AS DOUBLE) AS x1, min(l_quantity) * 20 AS y1,
          CAST(min(l_partkey % 1900) AS DOUBLE) + 20 + 10 * min(l_linenumber) AS x2, min(l_quantity) * 20 + 40 + 15 * max(l_linenumber) AS y2,
          round(max(l_discount) * 10, 2) AS conf FROM lineitem GROUP BY l_orderkey, l_suppkey"""),
    "trajectory": (("events",), "SELECT user_id AS track, event_id AS idx, value % 55 AS x, CAST({k} % 36 AS DOUBLE) AS y, event_type FROM events"),
    "reads": (("orders",), """
        SELECT o_custkey AS track, CASE o_orderstatus WHEN 'O' THEN 7 WHEN 'F' THEN 11 END AS number, o_totalprice / 500000 AS conf FROM orders"""),
    "candidates": (("documents",), """
        SELECT doc_id AS id, source AS title, text AS description, source AS channel,
          CASE lang WHEN 'en' THEN 'Creative Commons Attribution' WHEN 'fr' THEN 'creative commons' ELSE 'Standard' END AS license,
          CAST(CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars END AS DOUBLE) AS duration FROM documents"""),
    "manifest": (("documents", "labels"), "SELECT d.doc_id AS id, d.source AS channel FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0"),
    "reports": (("conversations",), """
        SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' Indirect free-kick. ' WHEN 1 THEN concat('It looks like a Corner: ', text) WHEN 2 THEN 'KICK-OFF' ELSE text END AS said,
          CASE conv_id % 3 WHEN 0 THEN 'goal_kick' WHEN 1 THEN 'corner_kick' ELSE 'free_kick' END AS label FROM conversations"""),
    "class_scores": (("embeddings",), "SELECT CAST(label AS BIGINT) AS slot, vec_id AS frame, {scores} AS scores FROM embeddings"),
    "colours": (("lineitem",), """
        SELECT l_suppkey AS track, CAST(l_partkey % 256 AS BIGINT) AS b, CAST((l_quantity * 5) AS BIGINT) AS g, CAST(l_orderkey % 256 AS BIGINT) AS r FROM lineitem"""),
    "dated": (("events",), """
        SELECT event_id AS frame, user_id AS track, CAST(user_id % 8 AS BIGINT) AS match_id, value AS ts,
          CASE event_type WHEN 'click' THEN 'throw_in' WHEN 'view' THEN 'corner_kick' WHEN 'signup' THEN 'shot' WHEN 'purchase' THEN 'goal_kick' ELSE 'foul' END AS label,
          CASE user_id % 4 WHEN 0 THEN 'Home' WHEN 1 THEN 'AWAY' WHEN 2 THEN 'away' END AS team FROM events"""),
}


def text(name: str, engine: str) -> str:
    return VIEWS[name][1].replace("{k}", _K[engine]).replace("{scores}", _ARRAY[engine])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_bound(text(name, "spark"), VIEWS[name][0]), args=None, **{t: load(spark, sf_dir, t) for t in VIEWS[name][0]})


def _bound(sql: str, tables: tuple[str, ...]) -> str:
    """Table names as parameters that spark.sql fills in with DataFrames."""
    for t in tables:
        for word in ("FROM ", "JOIN "):
            sql = sql.replace(f"{word}{t}", f"{word}{{{t}}}")
    return sql


def ctes(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({text(n, 'duck')})" for n in names)
