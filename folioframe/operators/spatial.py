"""Joins of boxes on the same page, by way of a grid so that no page is compared box by box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geom
from ..functions.geom import Box, box

#: Pixels of a grid cell's side. A pair is joined in every cell that both boxes touch and kept in one of them.
CELL = 128


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly: a small file has few splits, and costly work on each of its rows would have as few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the pages. Its size is estimated by that of compressed files, a small part of the real
    one, so that Spark would broadcast it and hold it whole on the driver."""
    return df.hint("merge")


def _cells(df: DataFrame, prefix: str, reach: Box, cell: int) -> DataFrame:
    span = lambda low, high: F.sequence(F.floor(low / cell), F.floor(high / cell))
    named = df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])
    return named.withColumn("cx_", F.explode(span(reach.x, reach.right))).withColumn("cy_", F.explode(span(reach.y, reach.bottom)))


def touching(left: DataFrame, right: DataFrame, reach_right: Box | None = None, cell: int = CELL, reach_left: Box | None = None) -> DataFrame:
    """Pairs of boxes of one page that share area, with columns a_* and b_*.

    Pages are joined by cell, so a page of any number of boxes spreads over many keys. A pair that meets in several
    cells is kept in the cell of its intersection's upper left corner. reach_right and reach_left enlarge the boxes of a side
    for the meeting alone; their columns have the prefixes b_ and a_.
    """
    a, b = reach_left or box("a_"), reach_right or box("b_")
    one = _cells(left, "a_", a, cell)
    other = _cells(right, "b_", b, cell).withColumnsRenamed({"cx_": "dx_", "cy_": "dy_"})
    corner = (F.floor(F.greatest(a.x, b.x) / cell) == F.col("cx_")) & (F.floor(F.greatest(a.y, b.y) / cell) == F.col("cy_"))
    keys = (F.col("a_page") == F.col("b_page")) & (F.col("cx_") == F.col("dx_")) & (F.col("cy_") == F.col("dy_"))
    return one.join(by_shuffle(other), keys & corner & (geom.meet(a, b) > 0)).drop("cx_", "cy_", "dx_", "dy_")


def best_match(left: DataFrame, right: DataFrame, above: float) -> DataFrame:
    """Of each left box that has one, the right box of largest IoU over `above`; the first by id wins ties."""
    pairs = touching(left, right).withColumn("iou", geom.iou(box("a_"), box("b_")))
    best = pairs.groupBy("a_page", "a_id").agg(F.max_by(F.struct("b_id", "iou"), F.struct("iou", -F.col("b_id"))).alias("m"))
    return best.select(F.col("a_page").alias("page"), F.col("a_id").alias("id"), F.col("m.b_id").alias("match_id"), F.col("m.iou").alias("iou")).where(F.col("iou") > above)


def with_overlap(left: DataFrame, right: DataFrame, least: float, anti: bool = False) -> DataFrame:
    """Left boxes that (don't) overlap some right box by `least` of the smaller one."""
    hits = touching(left, right).where(geom.overlap_smaller(box("a_"), box("b_")) >= least).select(F.col("a_page").alias("page"), F.col("a_id").alias("id")).distinct()
    return left.join(by_shuffle(hits), ["page", "id"], "left_anti" if anti else "left_semi")


def neighbour_above(items: DataFrame, icons: DataFrame, width: float) -> DataFrame:
    """Items with an icon above: from 0.3 of its height inside to a tenth of the page's width apart, sharing columns."""
    b = box("b_")
    reach = Box(b.x, b.y, b.w, b.h + F.lit(int(0.1 * width) + 1))
    gap = F.col("a_y") - b.bottom
    near = touching(items, icons, reach).where((F.col("a_id") != F.col("b_id")) & (gap >= -0.3 * b.h) & (gap <= 0.1 * width))
    near = near.where((b.x < F.col("a_x") + F.col("a_w")) & (b.right > F.col("a_x")))
    hits = near.select(F.col("a_page").alias("page"), F.col("a_id").alias("id")).distinct()
    return items.join(by_shuffle(hits), ["page", "id"], "left_semi")


def previous_line(lines: DataFrame, of: DataFrame | None = None, first: str = "id") -> DataFrame:
    """(page, id, prev_id): the line with the largest baseline that is less than 2.2 sizes above and 0.8 sizes aside.

    of: the lines that look for theirs, all by default. On a tie the smallest in column `first` wins, then the first by id. Baselines are bucketed by `CELL`, so lines are held against those of two buckets and not of the whole page; a line of a
    larger size looks back over more of them.
    """
    of = lines if of is None else of
    now = of.select(*[F.col(c).alias(f"a_{c}") for c in of.columns])
    now = now.withColumn("k", F.explode(F.sequence(F.floor((F.col("a_baseline") - 2.2 * F.col("a_size")) / CELL), F.floor(F.col("a_baseline") / CELL))))
    old = lines.select(*[F.col(c).alias(f"b_{c}") for c in lines.columns]).withColumn("j", F.floor(F.col("b_baseline") / CELL))
    step = F.col("a_baseline") - F.col("b_baseline")
    near = (step > 0) & (step < 2.2 * F.col("a_size")) & (F.abs(F.col("a_x") - F.col("b_x")) < 0.8 * F.col("a_size"))
    pairs = now.join(by_shuffle(old), (F.col("a_page") == F.col("b_page")) & (F.col("k") == F.col("j")) & near)
    last = pairs.groupBy("a_page", "a_id").agg(F.max_by("b_id", F.struct("b_baseline", -F.col(f"b_{first}"), -F.col("b_id"))).alias("prev_id"))
    return last.select(F.col("a_page").alias("page"), F.col("a_id").alias("id"), "prev_id")


def covered_glyph(arrows: DataFrame, glyphs: DataFrame, rows: float = 0.30, columns: float = 0.35) -> DataFrame:
    """(page, id, glyph_id, share): of each arrow, the glyph that it covers most along x; the later one wins ties."""
    a, b = box("a_"), box("b_")
    share = geom.interval_share(a.x, a.right, b.x, b.right)
    pairs = touching(arrows, glyphs).where(geom.interval_share(a.y, a.bottom, b.y, b.bottom) >= rows).withColumn("share", share).where(F.col("share") >= columns)
    best = pairs.groupBy("a_page", "a_id").agg(F.max(F.struct("share", "b_id")).alias("m"))
    return best.select(F.col("a_page").alias("page"), F.col("a_id").alias("id"), F.col("m.b_id").alias("glyph_id"), F.col("m.share").alias("share"))


def ranked(df: DataFrame, by: list[Column], partition: list[str], most: int) -> DataFrame:
    """The first `most` rows of each partition in the order given."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*partition).orderBy(*by))).where(F.col("rank_") <= most).drop("rank_")
