"""Reading frame logs and writing episode logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajq import schemas
from trajq.operators.episodes import format_episodes


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FRAME).parquet(path)


def stream_frames(spark: SparkSession, path: str, max_files: int | None = None, watermark: str | None = None) -> DataFrame:
    """Frames of the files that come to path. With a watermark, a frame (run, episode, step) that comes again no later than
    that after its first is dropped, so that files that are written twice do no harm; state holds the keys for that time."""
    reader = spark.readStream.schema(schemas.FRAME)
    frames = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)
    return frames if watermark is None else frames.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(schemas.FRAME_KEYS)


def write_episode_log(episodes: DataFrame, path: str, text: bool = False) -> None:
    """A folder per run, in Parquet, or as lines of text with the reward and epsilon formatted."""
    if not text:
        episodes.write.mode("overwrite").partitionBy("run_id").parquet(path)
        return
    line = F.format_string("episode %d, reward %s, epsilon %s", F.col("episode_id"), F.col("reward_text"), F.col("epsilon_text"))
    format_episodes(episodes).select("run_id", line.alias("value")).write.mode("overwrite").partitionBy("run_id").text(path)
