"""Reading tile maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajq.operators.tiles import add_tile_xy


def read_tile_grid(spark: SparkSession, path: str, ncols: int = 32, tile: int = 32, line_sep: str | None = None) -> DataFrame:
    """TILE_GRID of every map file under path: white-space separated codes in scan order; map_id is the file's path.

    A map is one row until its tokens are exploded, so many maps are read in parallel. Tokens that are no numbers get a
    null code, which no rule matches.

    Maps too large for a row are read in splits if line_sep is given, the string at which Spark may cut a file: a line break,
    or a space for a map without lines. A split's lines are numbered within it, and its tokens counted; what comes before
    a split is a sum over one row a split. The result is the same.
    """
    if line_sep is None:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("map_id"), _one_blank("value").alias("body"))
        tokens = files.where("body <> ''").select("map_id", F.posexplode(F.split("body", " ")).alias("pos", "code"))
    else:
        place = [F.col("_metadata.file_path").alias("map_id"), F.col("_metadata.file_block_start").alias("split")]
        lines = spark.read.text(path, lineSep=line_sep).select(*place, _one_blank("value").alias("body"), F.monotonically_increasing_id().alias("line"))
        lines = lines.where("body <> ''").withColumn("words", F.split("body", " ")).withColumn("n", F.size("words"))
        earlier = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        splits = lines.groupBy("map_id", "split").agg(F.sum("n").alias("n"))
        splits = splits.select("map_id", "split", earlier(["map_id"], "split").alias("before"))
        within = lines.withColumn("first", earlier(["map_id", "split"], "line"))
        tokens = within.join(splits, ["map_id", "split"]).select("map_id", (F.col("before") + F.col("first")).alias("first"), F.posexplode("words").alias("at", "code"))
        tokens = tokens.select("map_id", (F.col("first") + F.col("at")).cast("int").alias("pos"), "code")
    return add_tile_xy(tokens.withColumn("code", F.col("code").try_cast("int")), ncols, tile).select("map_id", "pos", "code", "x", "y")


def _one_blank(column: str) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))
