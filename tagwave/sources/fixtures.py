"""Test input: map edits derived from the driver's ``events`` table (FIXTURES.md section 2).

The same expression text runs in Spark SQL and in DuckDB, so the oracle sees identical payloads.
Work grows with ``events``: one payload per event row.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Fixed text: the JSON payload of one edit, built from one events row (FIXTURES.md).
PAYLOAD_SQL = r"""concat('{"type":"', CASE WHEN event_type = 'error' THEN 'node' WHEN event_type = 'signup' THEN 'relation' ELSE 'way' END,
 '","id":"w', CAST(event_id AS STRING),
 '","user":"u', CAST(user_id AS STRING),
 '","action":"', CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'modify' ELSE 'delete' END,
 '","tags":{', CASE event_id % 4 WHEN 0 THEN '"building":"yes"' WHEN 1 THEN '"highway":"track"' WHEN 2 THEN '"building":"no","highway":"path"' ELSE '"landuse":"farm"' END,
 '},"metadata":{"id":"c', CAST(event_id % 500 AS STRING),
 '","created_at":"', CAST(date_trunc('hour', ts) AS STRING), '"',
 CASE WHEN event_id % 11 = 0 THEN '' ELSE concat(',"comment":"',
   CASE WHEN event_id % 5 = 0 THEN 'Import ' ELSE 'Mapping  ' END,
   '#region', CAST(user_id % 7 AS STRING), CASE WHEN event_id % 13 = 0 THEN ',' ELSE '' END,
   ' #project', CAST(user_id % 20 AS STRING),
   CASE event_id % 10 WHEN 1 THEN ' ##double' WHEN 2 THEN ' #,' WHEN 3 THEN ' ##' WHEN 4 THEN ' # a#b' WHEN 5 THEN ' #a#b (#nope)' WHEN 6 THEN ' #Region1,,' WHEN 7 THEN ' #pipe|tail' WHEN 8 THEN concat(' #region', CAST(user_id % 7 AS STRING), ',') ELSE '' END, '"') END,
 '},"nodes":[', concat_ws(',',
   CASE WHEN event_id % 6 > 0 THEN concat('{"lon":"', CAST(event_id * 37 % 360 - 180 AS STRING), '.25","lat":"', CAST(event_id * 53 % 170 - 85 AS STRING), '.5"}') END,
   CASE WHEN event_id % 6 > 1 THEN concat('{"lon":"', CAST(event_id * 37 % 360 - 180 AS STRING), '.5","lat":"', CAST(event_id * 53 % 170 - 85 AS STRING), '.5"}') END,
   CASE WHEN event_id % 6 > 2 THEN '{"ref":"missing-coordinates"}' END,
   CASE WHEN event_id % 6 > 2 THEN concat('{"lon":"', CAST(event_id * 37 % 360 - 180 AS STRING), '.5","lat":"', CAST(event_id * 53 % 170 - 85 AS STRING), '.75"}') END,
   CASE WHEN event_id % 6 > 3 THEN concat('{"lon":"', CAST(event_id * 37 % 360 - 180 AS STRING), '.25","lat":"', CAST(event_id * 53 % 170 - 85 AS STRING), '.75"}') END),
 ']}')"""

# The events columns the recipe reads; a declared schema skips footer-based inference.
EVENTS_READ = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING"

EDITS_SQL = f"SELECT event_id AS edit_id, ts, {PAYLOAD_SQL} AS payload FROM events"


def events_path(sf_dir: str) -> str:
    return os.path.join(sf_dir, "events.parquet")


def arrival_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrival clock column alone, straight off the scan (for bounds of ``ts``)."""
    return spark.read.schema(EVENTS_READ).parquet(events_path(sf_dir)).select("ts")


def load_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edits ``(edit_id, ts, payload)``: one JSON payload per events row.

    Only the four events columns the recipe needs are read; a filter on ``ts`` placed above
    this reaches the parquet scan.
    """
    events = spark.read.schema(EVENTS_READ).parquet(events_path(sf_dir))
    return events.selectExpr("event_id AS edit_id", "ts", f"{PAYLOAD_SQL} AS payload")
