"""The event table as trajectories, tiles, boxes and motion, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# user: an episode; its run: seven runs; step: order of ts, event_id.
TRAJ = """
  SELECT user_id % 7 AS run_id, user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, ts,
         event_type AS obs, CAST(event_id % 3 AS INT) AS action, value - 60 AS reward, CAST(floor(value) AS DOUBLE) AS elapsed,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS done,
         event_type = 'error' AS forbidden, event_id % 5 = 0 AS off_track, event_id % 11 = 0 AS crash, value > 100 AS success
  FROM events"""
# 960 tiles a map, and as many maps as the events fill.
TILE = """
  SELECT CAST(CAST(floor(event_id / 960) AS BIGINT) AS STRING) AS map_id, CAST(event_id % 960 AS INT) AS pos, CAST((event_id * 7 + user_id) % 10 AS INT) AS code
  FROM events"""
MOTION = """
  SELECT user_id % 7 AS run_id, user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id,
         CAST(CAST(floor(event_id / 960) AS BIGINT) AS STRING) AS map_id, (value * 13) % 960 AS x, CAST((user_id * 7) % 960 AS DOUBLE) AS y, value AS heading,
         value / 10 AS vx, user_id / 20 - 3 AS vy, CAST(event_id % 3 AS INT) AS action, event_id % 2 = 0 AS slow
  FROM events"""
# The zone of a frame, which STAGE has for each frame but errors.
KIND = "CASE obs WHEN 'view' THEN 'checkpoint1' WHEN 'click' THEN 'checkpoint2' WHEN 'signup' THEN 'checkpoint3' WHEN 'purchase' THEN 'finish' END"
STAGE = f"""
  SELECT run_id, episode_id, step, ts, elapsed,
         {KIND} AS kind
  FROM traj WHERE obs <> 'error'"""


def _sql(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(sql.replace(" events", " {events}").replace(" traj ", " {traj} "), events=events.withColumn("ts", F.col("ts").cast("timestamp_ntz")), **more)


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TRAJ)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TILE)


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, MOTION)


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, STAGE, traj=traj(spark, sf_dir))
