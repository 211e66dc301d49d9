"""Lines read from a label picture, aligned into printed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = "struct<x:string,y:string,width:string,height:string>"


def lines_of_payloads(decisions: DataFrame, id_column: str, payload: str) -> DataFrame:
    """(id, text, x, y, width, height) of the lines with a box in JSON payloads; the candidate's, else the payload's own."""
    wrapped = F.when(F.col(payload).startswith('"'), F.get_json_object(F.concat(F.lit("["), payload, F.lit("]")), "$[0]")).otherwise(F.col(payload))
    once = decisions.select(F.col(id_column).alias("id"), wrapped.alias("json")).where(F.col("id").isNotNull() & F.try_parse_json("json").isNotNull()).distinct()
    lines = F.coalesce(F.get_json_object("json", "$.candidate.lines"), F.get_json_object("json", "$.lines"))
    each = once.select("id", F.explode(F.from_json(lines, f"array<struct<text:string,boundingBox:{BOX}>>")).alias("line"))
    sides = [F.col(f"line.boundingBox.{s}").try_cast("double").alias(s) for s in ("x", "y", "width", "height")]
    return each.select("id", "line.text", *sides).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def align_rows(lines: DataFrame, tolerance: float) -> DataFrame:
    """(id, row, text): lines whose middles follow each other within ``tolerance`` form a row, read from left to right.

    A row begins where the step to the next middle is larger; counting the beginnings numbers the rows. The windows
    run within one picture, whose lines are few.
    """
    middle = F.col("y") + F.coalesce("height", F.lit(0.0)) / 2
    down = Window.partitionBy("id").orderBy("middle", "x", "text")
    step = F.col("middle") - F.lag("middle").over(down)
    begun = lines.withColumn("middle", middle).withColumn("begins", F.when(F.coalesce(step <= tolerance, F.lit(False)), 0).otherwise(1))
    numbered = begun.withColumn("row", (F.sum("begins").over(down.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"])
    return numbered.groupBy("id", "row").agg(F.array_join(words, " ").alias("text"))


def row_value(text: Column) -> Column:
    """struct(name, value, unit) of a row such as 'Protein 24,5 g'; null if it isn't one."""
    pattern = r"(?i)^\s*([\p{L}][\p{L} ]*?)\s*[:.|\-]*\s*(\d+(?:[.,]\d+)?)\s*(kcal|kj|mg|g)\b"
    value = F.replace(F.regexp_extract(text, pattern, 2), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value.isNotNull(), F.struct(F.lower(F.regexp_extract(text, pattern, 1)).alias("name"), value.alias("value"), F.lower(F.regexp_extract(text, pattern, 3)).alias("unit")))
