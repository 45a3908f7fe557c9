"""Blocks of laid-out pages: reading order, headings, page numbers, body size. No page is decoded here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reading_order(blocks: DataFrame, keys: list[str], y: str, x: str, tie: str) -> DataFrame:
    """Adds ix: the place of each block on its page, by rows of five points, then from the left."""
    w = Window.partitionBy(*keys).orderBy(F.bround(F.col(y) / 5, 0), x, tie)
    return blocks.withColumn("ix", F.row_number().over(w))


def body_size(blocks: DataFrame, keys: list[str], size: str, chars: str) -> DataFrame:
    """(keys, body): the median size of a document's characters."""
    return blocks.where(F.col(chars) > 0).groupBy(*keys).agg(F.percentile(size, F.lit(0.5), F.col(chars)).alias("body"))


def heading(chars: Column, size: Column, bold: Column, body: Column) -> Column:
    """h1 or h2 for short blocks clearly larger than the body, or bold and a little larger; else null."""
    large = size >= 1.25 * body
    strong = (bold > 0.7) & (size >= 1.05 * body) & (chars <= 80)
    return F.when((chars <= 120) & (large | strong), F.when(size >= 1.6 * body, "h1").otherwise("h2"))


def page_number(text: Column) -> Column:
    """A line of at most four characters that are digits, dots aside."""
    return (F.char_length(text) <= 4) & F.replace(text, F.lit("."), F.lit("")).rlike("^[0-9]+$")


def page_budget(chars: Column, images: Column, chapters: Column) -> Column:
    """Pages that a rendering may have at most."""
    return F.lit(50) + F.floor(chars / 1200) + 2 * images + 2 * chapters


def fitted(width: Column, height: Column, most_width: float, most_height: float) -> Column:
    """struct(width, height): a picture scaled down, never up, into a frame; one pixel at least each way."""
    scale = F.least(F.lit(float(most_width)) / width, F.lit(float(most_height)) / height, F.lit(1.0))
    side = lambda x: F.greatest(F.floor(x * scale).cast("long"), F.lit(1))
    return F.struct(side(width).alias("width"), side(height).alias("height"))
