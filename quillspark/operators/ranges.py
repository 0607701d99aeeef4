"""Lookups by position: which page, block or heading level of a file holds a character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valued(positions: DataFrame, ranges: DataFrame, key: str = "file_id") -> DataFrame:
    """Adds ``value`` of the range (key, start, end, value) that holds (key, position): start <= position < end, else null.

    Ranges of a key don't overlap but may leave gaps; of ranges with the same start the last by end counts. One sort per key
    brings the ranges and positions together, so that neither side is searched for the other; null positions have no value.
    """
    columns = positions.columns
    a = positions.select(key, F.col("position").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<end:long,value:string>").alias("_range"), F.struct(*columns).alias("_row"))
    b = ranges.select(key, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("end").cast("long").alias("end"), F.col("value").cast("string").alias("value")).alias("_range"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("_at", "_kind", F.col("_range.end")).rowsBetween(Window.unboundedPreceding, 0)
    rows = a.withColumn("_at", F.col("_at").cast("long")).unionByName(b).withColumn("_held", F.last("_range", ignorenulls=True).over(w)).filter("_kind = 1")
    kind = ranges.schema["value"].dataType
    return rows.select("_row.*", F.when(F.col("_at") < F.col("_held.end"), F.col("_held.value")).cast(kind).alias("value"))


def spans(chunks: DataFrame, ranges: DataFrame, key: str = "file_id", chunk: str = "chunk_id") -> DataFrame:
    """Adds ``start_value`` and ``end_value`` to chunks (key, chunk, start, end): the ranges of the first and last character.

    An empty chunk, or one of a file without ranges, has neither.
    """
    ends = F.array(F.struct(F.lit("start").alias("side"), F.col("start").alias("position")), F.struct(F.lit("end").alias("side"), (F.col("end") - 1).alias("position")))
    asked = chunks.filter("end > start").select(key, chunk, F.explode(ends).alias("x")).select(key, chunk, "x.side", F.col("x.position").cast("long").alias("position"))
    found = valued(asked, ranges, key)
    side = lambda x: F.max(F.when(F.col("side") == x, F.col("value"))).alias(f"{x}_value")
    return chunks.join(found.groupBy(key, chunk).agg(side("start"), side("end")), [key, chunk], "left")


def range_value(chunks: DataFrame, ranges: DataFrame, name: str, position: Column, key: str = "file_id") -> DataFrame:
    """Adds the value of the range that holds a position of each chunk, such as its first character's block type."""
    return valued(chunks.withColumn("position", position.cast("long")), ranges, key).drop("position").withColumnRenamed("value", name)
