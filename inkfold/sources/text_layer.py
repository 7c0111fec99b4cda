"""Text boxes from the text layer of pages, as nested spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def text_boxes(spans: DataFrame, keys: list[str], dpi: int = 300) -> DataFrame:
    """Boxes of spans that aren't blank, scaled to dpi, in stored order, with space_before.

    spans: keys, block, line, span, text, x0, y0, x1, y1 (points). A box has a space before it if it begins with a blank, a blank
    span came before it, or it begins a block or line.
    """
    w = Window.partitionBy(*keys).orderBy("block", "line", "span")
    blank = F.trim("text") == ""
    moved = F.coalesce((F.lag("block").over(w) != F.col("block")) | (F.lag("line").over(w) != F.col("line")), F.lit(False))
    marked = spans.withColumns({"__blank": blank, "__after": F.coalesce(F.lag(blank | F.col("text").rlike(r"\s$")).over(w), F.lit(False)), "__moved": moved})
    # blanks between two boxes pass on to the next box
    marked = marked.withColumn("__group", F.sum((~F.col("__blank")).cast("int")).over(w) - (~F.col("__blank")).cast("int"))
    passed = F.max(F.col("__after") | F.col("__moved")).over(Window.partitionBy(*keys, "__group"))
    kept = marked.withColumn("space_before", passed | F.col("text").rlike(r"^\s")).where("not __blank")
    scale = dpi / 72
    sized = [(F.col(c) * scale).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return kept.select(*keys, (F.row_number().over(w) - 1).alias("ord"), F.trim("text").alias("text"), *sized, "space_before")
