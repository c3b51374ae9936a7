"""Arrows drawn on a page against the glyphs that recognition made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geom
from ..functions.text import char_weight, chars, let
from .spatial import by_shuffle, spread, touching

#: Arrow characters, and dashes that an arrow is often read as.
ARROWS, DASHES = "↑↓←→↖↗↘↙⇧⇩⇦⇨➔➜➝➞➤", "一—–-"
#: Shares by which a drawn box must cover a line's height and a glyph's width, and the latter for other glyphs than arrows.
ROWS, COLUMNS, DASH, TALL = 0.30, 0.35, 0.72, 0.85


def glyph_spans(lines: DataFrame) -> DataFrame:
    """Adds letters and spans, [(x0, x1)] of each character: as recognised (chars), if there is one for each, else the width shared out by weights."""
    lines = spread(lines).withColumn("letters", chars(F.col("text")))
    weights = F.transform("letters", char_weight)
    total = F.aggregate(weights, F.lit(0.0), lambda t, w: t + w)
    start = F.struct(F.col("x").cast("double").alias("at"), F.expr("cast(array() as array<struct<x0:bigint,x1:bigint>>)").alias("out"))
    whole = lambda c: F.bround(c).cast("long")

    def step(acc: Column, w: Column) -> Column:
        end = acc["at"] + F.greatest(F.col("w"), F.lit(1)) * w / total
        return let(end, lambda e: F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(whole(acc["at"]).alias("x0"), whole(e).alias("x1")))).alias("out")))

    shared = F.aggregate(weights, start, step, lambda acc: acc["out"])
    return lines.withColumn("spans", F.when(F.size("chars") == F.size("letters"), F.col("chars").cast("array<struct<x0:bigint,x1:bigint>>")).otherwise(shared))


def glyph_meetings(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, region, id, edge, blocked) of regions and lines that share rows: the place of the end glyph that the region is, and if it is none but covers some.

    Of the glyphs that a region covers by COLUMNS, the one that it covers most counts, the last on a tie. It must be the
    line's first or last, and an arrow; or a dash that is covered by DASH; or 个 under a tall region, by TALL. A region over an
    arrow inside a line is punctuation, and so blocked as well.
    """
    spanned = glyph_spans(lines.where("text is not null and text <> ''")).select("page", "id", "x", "y", "w", "h", "letters", "spans")
    pairs = touching(regions.select("page", "id", "x", "y", "w", "h"), spanned)
    a, b = geom.box("a_"), geom.box("b_")
    pairs = pairs.where(geom.interval_share(a.y, a.bottom, b.y, b.bottom) >= ROWS)
    wide = lambda s: F.greatest(F.lit(0), F.least(a.right, s["x1"]) - F.greatest(a.x, s["x0"]))
    share = lambda s: wide(s) / F.greatest(F.lit(1), F.least(a.w, s["x1"] - s["x0"]))
    n = F.size("b_letters")
    hits = F.filter(F.transform("b_spans", lambda s, i: F.struct(share(s).alias("share"), i.alias("i"))), lambda s: s["share"] >= COLUMNS)
    inner = F.exists(F.transform("b_spans", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda s: s["i"].between(1, n - 2) & F.lit(ARROWS).contains(F.get("b_letters", s["i"])) & (wide(s["s"]) >= COLUMNS * F.least(a.w, s["s"]["x1"] - s["s"]["x0"])))
    pairs = pairs.withColumns({"hit": F.array_max(hits), "inner": inner}).withColumn("letter", F.get("b_letters", F.col("hit.i")))
    like = F.lit(ARROWS).contains(F.col("letter")) | (F.lit(DASHES).contains(F.col("letter")) & (F.col("hit.share") >= DASH)) | ((F.col("letter") == "个") & (a.h >= 1.4 * a.w) & (F.col("hit.share") >= TALL))
    edge = F.when(F.col("hit.i").isin(0) | (F.col("hit.i") == n - 1), F.when(like, F.col("hit.i")))
    return pairs.select(F.col("a_page").alias("page"), F.col("a_id").alias("region"), F.col("b_id").alias("id"), edge.alias("edge"), (F.col("inner") | (F.col("hit").isNotNull() & edge.isNull())).alias("blocked"))


def clear_regions(regions: DataFrame, meetings: DataFrame) -> DataFrame:
    """The regions that are no part of a line's text."""
    return regions.join(by_shuffle(meetings.where("blocked").select("page", F.col("region").alias("id")).distinct()), ["page", "id"], "left_anti")


def _trims(lines: DataFrame, meetings: DataFrame) -> DataFrame:
    """lines with letters, spans, and left and right: the letters that stay; null where no region took any."""
    blocked = meetings.where("blocked").select("page", "region").distinct()
    taken = meetings.where("edge is not null").join(by_shuffle(blocked), ["page", "region"], "left_anti")
    ends = taken.groupBy("page", "id").agg(F.max(F.col("edge") == 0).alias("first_"), F.max("edge").alias("most_"))
    out = glyph_spans(lines).join(by_shuffle(ends), ["page", "id"], "left")
    n = F.size("letters")
    last = F.col("most_") == n - 1
    left = F.when(F.col("first_"), F.when(last & (n == 2), 2).otherwise(1)).otherwise(0)
    right = F.when(last, F.when(F.col("first_") & (n == 2), 0).otherwise(n - 1)).otherwise(n)
    return out.withColumns({"left": F.when(F.col("most_").isNotNull(), left), "right": F.when(F.col("most_").isNotNull(), right)}).drop("first_", "most_")


def lines_without_arrows(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, id, text, x, w, chars): lines whose end glyphs are arrows that are drawn, without them; lines of nothing else go.

    lines: page, id, box, text, chars (null, or [(x0, x1)]); regions: page, id, box. The new edges are those of the glyphs that went.
    """
    trimmed = _trims(lines, glyph_meetings(lines, regions)).where("left is null or left < right")
    cut = F.col("left").isNotNull()
    text = F.when(cut, F.array_join(F.slice("letters", F.col("left") + 1, F.col("right") - F.col("left")), "")).otherwise(F.col("text"))
    x = F.when(F.col("left") > 0, F.get("spans", F.col("left") - 1)["x1"]).otherwise(F.col("x"))
    end = F.when(F.col("right") < F.size("letters"), F.get("spans", F.col("right"))["x0"]).otherwise(F.col("x") + F.col("w"))
    kept = F.when(cut & (F.size("chars") == F.size("letters")), F.slice("chars", F.col("left") + 1, F.col("right") - F.col("left"))).otherwise(F.col("chars"))
    return trimmed.select("page", "id", text.alias("text"), x.alias("x"), F.when(cut, F.greatest(F.lit(1), end - x)).otherwise(F.col("w")).alias("w"), kept.alias("chars"))


def arrow_text_changes(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, region, id, removed, kept): of each region the lines that lost a glyph to it, with all that they lost and what is left."""
    meetings = glyph_meetings(lines, regions)
    trimmed = _trims(lines, meetings).where("left < right")
    own = meetings.where("edge is not null").select("page", "region", "id").join(by_shuffle(clear_regions(regions, meetings).select("page", F.col("id").alias("region"))), ["page", "region"], "left_semi")
    part = lambda a, n: F.slice("letters", a + 1, n)
    removed = F.concat(part(F.lit(0), F.col("left")), part(F.col("right"), F.size("letters") - F.col("right")))
    changes = trimmed.select("page", "id", F.array_join(removed, "").alias("removed"), F.array_join(part(F.col("left"), F.col("right") - F.col("left")), "").alias("kept"))
    return own.join(by_shuffle(changes), ["page", "id"]).select("page", "region", "id", "removed", "kept")
