"""Consistency of the rows of a page: labels and short titles that look alike should be treated alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geom
from ..functions.geom import Box, box
from .sequences import tolerance_rows
from .spatial import by_shuffle, touching


def _first(rows: DataFrame, column: str, position: Column) -> Column:
    return F.first(column).over(Window.partitionBy("page", "row_no").orderBy(position, "id"))


def _even(rows: DataFrame, along: Column) -> DataFrame:
    """Adds n and even: at least three centers along the row whose gaps differ by half at most."""
    w = Window.partitionBy("page", "row_no")
    gaps = rows.withColumn("gap_", along - F.lag(along).over(w.orderBy(along, "id")))
    low, high = F.min("gap_").over(w), F.max("gap_").over(w)
    return gaps.withColumn("n", F.count("*").over(w)).withColumn("even", (F.col("n") >= 3) & (low > 0) & (high <= 1.5 * low))


def _icon_beside(items: DataFrame, icons: DataFrame, width: float, above: bool) -> DataFrame:
    """(page, id) of items with another icon above, or to the left."""
    a, b = box("a_"), box("b_")
    if above:
        reach, reach_left = Box(b.x, b.y, b.w, b.h + F.lit(int(0.1 * width) + 1)), a
        gap, slack, most = a.y - b.bottom, 0.3 * b.h, F.lit(0.1 * width)
        beside = (b.x < a.right) & (b.right > a.x)
    else:
        # The allowed distance is in proportion to the larger height: each side reaches out by its own.
        reach = Box(b.x, b.y, b.w + (2.5 * b.h + 1).cast("long"), b.h)
        grown = (2.5 * a.h + 1).cast("long")
        reach_left = Box(a.x - grown, a.y, a.w + grown, a.h)
        gap, slack, most = a.x - b.right, 0.3 * b.w, 2.5 * F.greatest(a.h, b.h)
        beside = (b.y < a.bottom) & (b.bottom > a.y)
    other = (a.x != b.x) | (a.y != b.y) | (a.w != b.w) | (a.h != b.h)
    pairs = touching(items, icons, reach, reach_left=reach_left).where(other & (gap >= -slack) & (gap <= most) & beside)
    return pairs.select(F.col("a_page").alias("page"), F.col("a_id").alias("id")).distinct()


def inconsistent(texts: DataFrame, icons: DataFrame, width: float) -> DataFrame:
    """(page, x, y, w, h, reason): items of a row that are unlike the others.

    texts: page, id, x, y, w, h, text. icons: page, id, x, y, w, h. Flat icons are labels. 'text': of labels of one size,
    those whose text is treated unlike the majority's. 'icon': of evenly spaced items, most with an icon, those without.
    """
    b = box("")
    labels = icons.where((b.w >= 1.8 * b.h) & (b.w >= 0.06 * width)).select("page", "id", "x", "y", "w", "h")
    shorts = texts.where((b.h <= 0.05 * width) & (F.length("text") <= 12) & ~F.contains("text", F.lit("\n"))).select("page", "id", "x", "y", "w", "h")
    tol = 0.012 * width
    w = Window.partitionBy("page", "row_no")

    cy = b.y + b.h / 2
    rows = tolerance_rows(labels, cy, tol)
    rows = rows.withColumn("w0", _first(rows, "w", cy)).withColumn("h0", _first(rows, "h", cy))
    same = rows.where((F.abs(F.col("w") - F.col("w0")) <= 0.08 * F.col("w0")) & (F.abs(F.col("h") - F.col("h0")) <= 0.12 * F.col("h0")))
    hits = touching(texts.drop("text"), labels).where(geom.center_in(box("a_"), box("b_"))).select(F.col("b_page").alias("page"), F.col("b_id").alias("id")).distinct().withColumn("flag", F.lit(1))
    flagged = same.join(by_shuffle(hits), ["page", "id"], "left").withColumn("flag", F.coalesce("flag", F.lit(0))).withColumn("n", F.count("*").over(w)).withColumn("got", F.sum("flag").over(w))
    odd = flagged.where((F.col("n") >= 3) & (F.col("got") > 0) & (F.col("got") < F.col("n")) & (F.col("flag") != (2 * F.col("got") >= F.col("n")).cast("int")))
    out = odd.select("page", "x", "y", "w", "h", F.lit("text").alias("reason"))

    # Labels come before short texts where both stand at one place, as ids are only unique within their table.
    items = labels.withColumn("src", F.lit(0)).unionByName(shorts.withColumn("src", F.lit(1))).withColumn("id", 2 * F.col("id") + F.col("src")).drop("src")
    for above in (True, False):
        across, along = (b.y + b.h / 2, b.x + b.w / 2) if above else (b.x + b.w / 2, b.y + b.h / 2)
        rows = tolerance_rows(items, across, tol)
        rows = rows.withColumn("h0", _first(rows, "h", across)).where(F.abs(F.col("h") - F.col("h0")) <= 0.3 * F.col("h0"))
        even = _even(rows, along)
        flagged = even.join(by_shuffle(_icon_beside(items, icons, width, above).withColumn("flag", F.lit(1))), ["page", "id"], "left").withColumn("flag", F.coalesce("flag", F.lit(0))).withColumn("got", F.sum("flag").over(w))
        lone = flagged.where(F.col("even") & (F.col("got") >= 2) & (F.col("got") >= 0.6 * F.col("n")) & (F.col("got") < F.col("n")) & (F.col("flag") == 0))
        out = out.unionByName(lone.select("page", "x", "y", "w", "h", F.lit("icon").alias("reason")))
    return out.groupBy("page", "x", "y", "w", "h").agg(F.max("reason").alias("reason"))
