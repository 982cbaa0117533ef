"""Inputs of the queries, derived from the driver's tables by integer rules.

The tables hold no roofs, detections or rasters, so each input is a list of expressions over
one table. The text is plain SQL, the same for Spark and for the SQL that checks the queries.
Coordinates are multiples of 1/8, so that areas are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solarweave.operators.fusion import source_set
from solarweave.storage import table

#: name: (table, expressions, filter)
FIXTURES: dict[str, tuple[str, list[str], str]] = {
    # Rectangular faces; slope and aspect are unknown for some, steep for others.
    "faces": ("part", [
        "p_partkey AS face_id", "CAST(floor(p_partkey / 4) AS BIGINT) AS building_id",
        "CAST(5 + p_size % 20 AS DOUBLE) AS w", "CAST(4 + p_partkey % 13 AS DOUBLE) AS h",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(1 + (p_size * 7) % 90 AS DOUBLE) END AS slope",
        "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(90 * (p_partkey % 4) AS DOUBLE) END AS aspect",
        "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(900 + p_partkey % 300 AS DOUBLE) END AS irradiance",
    ], "TRUE"),
    # Boxes of detections, spread so that their density doesn't grow with the tables.
    "boxes": ("lineitem", [
        "l_orderkey * 8 + l_linenumber AS id", "l_orderkey AS analysis", "l_linenumber AS seq",
        "CASE l_linenumber % 4 WHEN 0 THEN 'pv_installation' WHEN 1 THEN 'chimney' WHEN 2 THEN 'skylight' ELSE 'shadow' END AS kind",
        "CASE l_partkey % 5 WHEN 0 THEN 'swiss' WHEN 1 THEN 'rid' WHEN 2 THEN 'rid' WHEN 3 THEN 'height' ELSE 'survey' END AS source",
        "CASE l_partkey % 15 WHEN 0 THEN 'rid,swiss' WHEN 1 THEN 'height,rid' WHEN 3 THEN 'rid' WHEN 5 THEN 'swiss' ELSE NULL END AS listed",
        "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey % 100 AS DOUBLE) / 100 END AS confidence",
        "CAST((l_orderkey * 37 + l_linenumber * 11) % 2000 AS DOUBLE) / 2 AS x1", "CAST((l_partkey * 7) % 100000 AS DOUBLE) / 8 AS y1",
        "CAST((l_orderkey * 37 + l_linenumber * 11) % 2000 AS DOUBLE) / 2 + 1 + l_suppkey % 4 AS x2", "CAST((l_partkey * 7) % 100000 AS DOUBLE) / 8 + 1 + l_partkey % 3 AS y2",
    ], "TRUE"),
    # Boxes close together within one order.
    "order_boxes": ("lineitem", [
        "l_orderkey * 8 + l_linenumber AS id", "l_orderkey AS analysis", "l_linenumber AS seq",
        "CASE l_partkey % 2 WHEN 0 THEN 'pv_installation' ELSE 'chimney' END AS kind",
        "CASE l_partkey % 5 WHEN 0 THEN 'swiss' WHEN 1 THEN 'rid' WHEN 2 THEN 'rooflight' WHEN 3 THEN 'height' ELSE 'survey' END AS source",
        "CASE l_partkey % 7 WHEN 0 THEN 'rid,swiss' WHEN 1 THEN 'height,rid' WHEN 2 THEN 'rid' ELSE NULL END AS listed",
        "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey % 100 AS DOUBLE) / 100 END AS confidence",
        "CAST(l_partkey % 8 AS DOUBLE) / 2 AS x1", "CAST(l_suppkey % 8 AS DOUBLE) / 2 AS y1",
        "CAST(l_partkey % 8 AS DOUBLE) / 2 + 1 + l_suppkey % 3 AS x2", "CAST(l_suppkey % 8 AS DOUBLE) / 2 + 1 + l_linenumber % 3 AS y2",
    ], "TRUE"),
    "raw_detections": ("events", [
        "event_id AS id", "user_id AS analysis", "event_id AS seq",
        "CASE event_id % 9 WHEN 0 THEN 'existing_pv' WHEN 1 THEN 'solar_panel' WHEN 2 THEN 'pv' WHEN 3 THEN 'window' WHEN 4 THEN 'unknown_obstacle' WHEN 5 THEN 'chimney' WHEN 6 THEN 'car' WHEN 7 THEN 'tree' ELSE 'dormer' END AS name",
        "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 31 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 37 = 0 THEN 2.0E0 ELSE CAST(event_id % 101 AS DOUBLE) / 100 END AS confidence",
        "CASE event_id % 6 WHEN 0 THEN 'swiss' WHEN 1 THEN 'rid' WHEN 2 THEN 'height' WHEN 3 THEN 'survey' WHEN 4 THEN 'rooflight' ELSE NULL END AS source",
        "CASE WHEN event_id % 2 = 0 THEN 'm1' ELSE NULL END AS model",
        "CAST(event_id % 40 AS DOUBLE) AS x1", "CAST(user_id % 40 AS DOUBLE) AS y1", "CAST(event_id % 40 + event_id % 5 AS DOUBLE) AS x2", "CAST(user_id % 40 + 1 + event_id % 3 AS DOUBLE) AS y2",
    ], "TRUE"),
    # Chips of a data set on a 20 m grid, with their split.
    "chips": ("customer", [
        "c_custkey AS id", "CAST(c_custkey * 137 % 500 * 20 AS DOUBLE) AS x", "CAST(c_custkey * 71 % 1000 * 20 AS DOUBLE) AS y",
        "CASE c_custkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split", "CAST(floor(c_custkey / 500) AS BIGINT) AS block",
    ], "TRUE"),
    "label_lines": ("lineitem", [
        "l_orderkey AS file", "l_linenumber AS line_no", "l_partkey % 12 AS cls",
        "concat_ws(' ', CAST(l_suppkey % 3 AS STRING), CAST(l_partkey % 2 AS STRING), '1', '0.5', CASE l_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN '0 x' ELSE '0.5 1' END) AS coords",
    ], "TRUE"),
    # Parts of houses in a row: one box an order, one house number a customer.
    "parts": ("orders", [
        "o_orderkey AS id", "CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE o_custkey END AS egid",
        "CAST(o_orderkey * 13 % 64 AS DOUBLE) AS x1", "CAST(o_orderkey * 29 % 16 AS DOUBLE) AS y1", "CAST(o_orderkey * 13 % 64 + 4 AS DOUBLE) AS x2", "CAST(o_orderkey * 29 % 16 + 4 AS DOUBLE) AS y2",
    ], "TRUE"),
    "files": ("events", ["event_id AS id", "CAST(floor(event_id / 20) AS BIGINT) AS folder", "ts AS mtime", "CAST(floor(abs(value)) AS BIGINT) + 1 AS size", "event_type"], "TRUE"),
    "tiles": ("events", ["event_id AS id", "user_id AS origin", "ts", "event_type", "concat('swissalti_', CAST(user_id AS STRING), CASE WHEN event_id % 3 = 0 THEN '_2_' ELSE '_0.5_' END, CAST(event_id AS STRING), CASE WHEN event_id % 5 = 0 THEN '.zip' ELSE '.tif' END) AS name"], "TRUE"),
    "states": ("events", [
        "event_id AS id", "user_id AS model", "ts", "CASE event_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN NULL WHEN 2 THEN 'outside_coverage' ELSE 'failed' END AS state", "event_id % 3 <> 0 AS available",
    ], "TRUE"),
    "windows": ("part", ["p_partkey AS id", "CAST(p_size * 4 + p_partkey % 7 AS DOUBLE) AS extent", "CAST(300 + p_partkey % 1700 AS INT) AS px_w", "CAST(300 + p_size * 30 AS INT) AS px_h"], "TRUE"),
    "scores": ("part", [
        "p_partkey AS id", "CAST(p_size + p_partkey % 40 AS DOUBLE) AS best", "CAST(p_partkey % 37 AS DOUBLE) AS base", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 61 AS DOUBLE) END AS rival",
        "CAST(p_partkey % 17 AS DOUBLE) / 4 AS shift", "p_partkey % 5 AS support",
    ], "TRUE"),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input; only the columns that a plan uses are read."""
    source, columns, where = FIXTURES[name]
    return table(spark, sf_dir, source).filter(where).selectExpr(*columns)


def sourced(boxes: DataFrame) -> DataFrame:
    """boxes with sources as a set: what listed says, else their source."""
    return boxes.withColumn("sources", source_set(F.split("listed", ","), F.col("source"), F.lit(None).cast("string")))


def fixture_sql(name: str) -> str:
    source, columns, where = FIXTURES[name]
    text = ", ".join(columns).replace("AS STRING", "AS VARCHAR")
    return f"SELECT {text} FROM {source} WHERE {where}"


#: Sources of a box as a sorted list, from its own list or its source, in DuckDB.
SOURCES_SQL = "string_split(coalesce(listed, source), ',')"
RASTER_SQL = "SELECT vec_id AS image, ((i - 1) // 8)::INTEGER AS r, ((i - 1) % 8)::INTEGER AS c, embedding[i]::DOUBLE AS z FROM embeddings, (SELECT unnest(range(1, 65))::INTEGER AS i)"
