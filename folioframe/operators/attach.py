"""What belongs to a line and was not read with it, or was read and is no text: dashes, end marks, glyphs, bars, strips.

Strokes, spots and the shapes of characters are measured on pixels by the caller; what they mean is decided here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geom
from ..functions.geom import Box
from ..functions.text import chars, icon_like_character, short_tall_mixed
from .spatial import touching

HAN = "[一-鿿]"
#: Marks after which a stroke is an ornament, marks that end a line, and signs taken for icons or bars.
CLOSING, ENDING = "！？。!?…", "，。、；：,.;:!?！？"
ICON_GLYPHS = "品田回口日目囗器圆图昌吕串宫国四□■●◆◇○◎☐▢⊞⌗#"
BAR_GLYPHS, BAR_LETTERS = "1Il|丨■▌▍█", "1Il"


def _apart(a: str, b: str) -> Column:
    """Squared distance of two colours."""
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "rgb"), F.lit(0))


def _boxed(df: DataFrame) -> DataFrame:
    """x, y, w, h of a window from its edges xa, xb, ya, yb."""
    return df.withColumns({"x": F.col("xa"), "y": F.col("ya"), "w": F.col("xb") - F.col("xa"), "h": F.col("yb") - F.col("ya")})


def _whole(value: Column) -> Column:
    return F.floor(value).cast("long")


def dashes_attached(lines: DataFrame, strokes: DataFrame, width: int) -> DataFrame:
    """(page, id, text, x0, x1): lines with the dashes that stand before and after them.

    lines: page, id, text, x0, y0, x1, y1 (ink), size, badge, r, g, b. strokes: page, id, box, r, g, b, taken (part of another
    text), alone (nothing above and below). A line of Han text, of size 10 at least and no badge, takes thin strokes of its
    colour at mid height within 5.5 sizes. Those level with the nearest one make a dash of 0.8 to 4.6 sizes that begins
    within 0.8 and ends inside the window; it becomes one to four characters. A line with long strokes on both sides is
    ornamented and takes none; after a closing mark nothing is taken. A dash before a line that was read as one stroke and the
    Han sign for one is two dashes. Lines without ink stay.
    """
    s = F.col("size")
    able = lines.where(~F.col("badge") & (s >= 10) & F.col("text").rlike(HAN) & F.col("x0").isNotNull())
    high = F.col("y1") - F.col("y0")
    side = lambda name, a, b: F.struct(F.lit(name).alias("side"), a.cast("long").alias("xa"), b.cast("long").alias("xb"))
    sides = F.array(side("left", F.greatest(F.lit(0), _whole(F.col("x0") - 5.5 * s)), F.greatest(F.lit(0), F.col("x0") - 2)), side("right", F.least(F.lit(width), F.col("x1") + 2), F.least(F.lit(width), _whole(F.col("x1") + 5.5 * s))))
    windows = able.select("page", "id", "text", "size", "r", "g", "b", _whole(F.col("y0") + 0.25 * high).alias("ya"), _whole(F.col("y0") + 0.8 * high).alias("yb"), F.explode(sides).alias("at")).select("*", "at.*").drop("at")
    windows = _boxed(windows.where((F.col("xb") - F.col("xa") >= 0.8 * s) & (F.col("yb") - F.col("ya") >= 3)))
    a, b = geom.box("a_"), geom.box("b_")
    pairs = touching(windows, strokes).where(_apart("a_", "b_") < 3600)
    size, left = F.col("a_size"), F.col("a_side") == "left"
    cut = {"lo": F.greatest(a.x, b.x), "hi": F.least(a.right, b.right), "top": F.greatest(a.y, b.y), "low": F.least(a.bottom, b.bottom)}
    thin = pairs.withColumns(cut).where(F.col("low") - F.col("top") <= F.greatest(F.lit(3.0), 0.16 * size))
    long_ = thin.where(F.col("hi") - F.col("lo") >= 0.8 * size).groupBy("a_page", "a_id").agg(F.count_distinct("a_side").alias("n")).where("n = 2")
    own = thin.where(~F.col("b_taken") & (F.col("hi") - F.col("lo") >= 0.45 * size) & (left | ~F.lit(CLOSING).contains(F.right("a_text", F.lit(1)))))
    own = own.join(long_, ["a_page", "a_id"], "left_anti").withColumn("mid", (F.col("top") + F.col("low")) / 2)
    key = ["a_page", "a_id", "a_side"]
    nearest = F.max_by("mid", F.struct(F.when(left, F.col("hi")).otherwise(-F.col("lo")), -F.col("b_id"))).over(Window.partitionBy(*key))
    level = own.withColumn("nearest", nearest).where(F.abs(F.col("mid") - F.col("nearest")) <= 2)
    whole = level.groupBy(*key, "a_size", "a_xa", "a_xb").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("hi") - F.col("lo")).alias("total"), F.bool_and("b_alone").alias("alone"))
    gap = F.when(left, F.col("a_xb") - F.col("hi")).otherwise(F.col("lo") - F.col("a_xa"))
    beyond = F.when(left, F.col("lo") - F.col("a_xa") <= 1).otherwise(F.col("hi") >= F.col("a_xb") - 1)
    dash = whole.where(F.col("alone") & (gap <= 0.8 * size) & ~beyond & F.col("total").between(0.8 * size, 4.6 * size))
    n = F.greatest(F.lit(1), F.least(F.lit(4), F.bround((F.col("hi") - F.col("lo")) / size))).cast("int")
    of = lambda name, what: F.max(F.when(F.col("a_side") == name, what))
    found = dash.groupBy(F.col("a_page").alias("page"), F.col("a_id").alias("id")).agg(of("left", F.repeat(F.lit("—"), n)).alias("before"), of("right", F.repeat(F.lit("—"), n)).alias("after"), of("left", F.col("lo")).alias("lo"), of("right", F.col("hi")).alias("hi"))
    text = F.concat(F.coalesce("before", F.lit("")), "text")
    text = F.when(F.col("before").isNotNull() & text.startswith("—一"), F.concat(F.lit("——"), F.substr(text, F.lit(3)))).otherwise(text)
    out = lines.join(found, ["page", "id"], "left")
    return out.select("page", "id", F.concat(text, F.coalesce("after", F.lit(""))).alias("text"), F.coalesce("lo", "x0").alias("x0"), F.coalesce("hi", "x1").alias("x1"))


def end_marks_attached(lines: DataFrame, spots: DataFrame, width: int) -> DataFrame:
    """(page, id, text, x1): lines with the comma, full stop or closing quote that stands after them.

    lines: as for dashes_attached(). spots: page, id, box, r, g, b, taken, area (its pixels), stem (its colour goes on above). A
    line of Han text, of size 14 at least, no badge and without an end mark takes spots of its colour, 0.08 to 0.45 of its size
    and of 6 pixels at least, that stand whole in a window at its end. If a quote is open, one or two spots at its upper half
    close it, more are something else. Else the leftmost spot at its lower half, no stem and no bar, is a full stop if it is a
    ring, and a comma if not.
    """
    s, high = F.col("size"), F.col("y1") - F.col("y0")
    able = lines.where(~F.col("badge") & (s >= 14) & F.col("text").rlike(HAN) & ~F.lit(ENDING).contains(F.right("text", F.lit(1))) & F.col("x1").isNotNull())
    count = lambda sign: F.length("text") - F.length(F.replace("text", F.lit(sign), F.lit("")))
    able = able.withColumn("open", count("“") > count("”"))
    windows = able.select(
        "page", "id", "size", "r", "g", "b", "open", F.least(F.lit(width), F.col("x1") + 1).cast("long").alias("xa"), F.least(F.lit(width).cast("long"), _whole(F.col("x1") + F.when(F.col("open"), 0.75).otherwise(0.9) * s)).alias("xb"),
        F.greatest(F.lit(0), _whole(F.when(F.col("open"), F.col("y0") - 0.1 * s).otherwise(F.col("y0") + 0.35 * high))).alias("ya"), _whole(F.when(F.col("open"), F.col("y0") + 0.5 * high).otherwise(F.col("y1") + 0.3 * s)).alias("yb"),
    )
    windows = _boxed(windows.where((F.col("xb") - F.col("xa") >= 4) & (F.col("yb") - F.col("ya") >= 4)))
    a, b, size = geom.box("a_"), geom.box("b_"), F.col("a_size")
    pairs = touching(windows, spots).where((_apart("a_", "b_") < 4900) & ~F.col("b_taken") & F.greatest(b.w, b.h).between(0.08 * size, 0.45 * size) & (F.col("b_area") >= 6))
    pairs = pairs.where((b.x >= a.x) & (b.right < a.right - 1))
    lower = ~F.col("a_open") & (b.y > a.y) & (b.x - a.x <= 0.55 * size) & (b.h <= 3.2 * F.greatest(F.lit(1), b.w)) & ~F.col("b_stem")
    pairs = pairs.where(lower | (F.col("a_open") & (b.x - a.x <= 0.5 * size)))
    ring = (F.col("b_area") < 0.6 * b.area) & (F.abs(b.w - b.h) <= 0.25 * F.greatest(b.w, b.h))
    mark = F.when(ring, "。").otherwise("，")
    found = pairs.groupBy(F.col("a_page").alias("page"), F.col("a_id").alias("id"), F.col("a_open").alias("open")).agg(F.count("*").alias("n"), F.max(b.right).alias("far"), F.min(F.struct(b.x.alias("x"), b.y.alias("y"), F.col("b_id").alias("by"), mark.alias("mark"), b.right.alias("right"))).alias("m"))
    found = found.where("not open or n <= 2").select("page", "id", F.when(F.col("open"), "”").otherwise(F.col("m.mark")).alias("mark"), F.when(F.col("open"), F.col("far")).otherwise(F.col("m.right")).alias("right"))
    return lines.join(found, ["page", "id"], "left").select("page", "id", F.concat("text", F.coalesce("mark", F.lit(""))).alias("text"), F.coalesce("right", "x1").alias("x1"))


def without_leading_glyph(lines: DataFrame) -> DataFrame:
    """Lines without an icon that was read as their first character; text, x and w change.

    lines: text, x, w, h, ink ([(a, b)] of the columns that hold ink, in order), manual. The text begins with a sign that looks
    like an icon, white space and two characters more. Stretches of ink less than 0.15 of the height apart are one; the first
    is 0.5 to 1.3 heights wide and 0.3 at least before the next. Lines without ink stay.
    """
    h = F.col("h")
    empty = F.expr("cast(null as struct<a:bigint,b:bigint,next:bigint>)")

    def step(acc: Column, run: Column) -> Column:
        fresh = F.struct(run["a"].cast("long").alias("a"), run["b"].cast("long").alias("b"), F.lit(None).cast("long").alias("next"))
        grown = F.struct(acc["a"].alias("a"), run["b"].cast("long").alias("b"), F.lit(None).cast("long").alias("next"))
        ended = F.struct(acc["a"].alias("a"), acc["b"].alias("b"), run["a"].cast("long").alias("next"))
        return F.when(acc.isNull(), fresh).when(acc["next"].isNotNull(), acc).when(run["a"] - acc["b"] < 0.15 * h, grown).otherwise(ended)

    rest = F.regexp_replace(F.substr("text", F.lit(2)), r"(?U)^\s+", "")
    rows = lines.withColumn("first_", F.aggregate("ink", empty, step)).withColumn("rest_", rest)
    wide, gap = F.col("first_.b") - F.col("first_.a"), F.col("first_.next") - F.col("first_.b")
    sign = F.lit(ICON_GLYPHS).contains(F.left("text", F.lit(1))) & F.substring("text", 2, 1).rlike(r"(?U)^\s$") & (F.length("text") >= 4) & (F.length("rest_") >= 2)
    goes = F.coalesce(~F.col("manual") & sign & wide.between(0.5 * h, 1.3 * h) & (gap >= 0.3 * h), F.lit(False))
    rows = rows.withColumn("goes_", goes)
    moved = {"text": F.when(F.col("goes_"), F.col("rest_")).otherwise(F.col("text")), "x": F.col("x") + F.when(F.col("goes_"), F.col("first_.next")).otherwise(0), "w": F.col("w") - F.when(F.col("goes_"), F.col("first_.next")).otherwise(0)}
    return rows.withColumns(moved).drop("first_", "rest_", "goes_")


def without_side_bars(lines: DataFrame) -> DataFrame:
    """Lines without bars that were read as characters; text, chars, x and w change.

    lines: text, x, w, h, chars ([(x0, x1)]), shapes ([(w, h, area)] of each character's largest patch of ink). A sign that looks
    like a bar goes if its patch is 0.6 of the line's height, 0.12 to 0.4 as wide as high and 0.85 filled; letters and digits
    beside other ASCII letters or digits stay. Lines of one character, or without a place for each, stay.
    """
    each = F.transform("c_", lambda c, k: F.struct(c.alias("c"), F.get("chars", k).alias("at"), F.get("shapes", k).alias("s"), F.coalesce(F.get("c_", k - 1), F.lit("")).alias("l"), F.coalesce(F.get("c_", k + 1), F.lit("")).alias("r")))
    word = lambda c: c.rlike("^[A-Za-z0-9]$")
    tall = lambda s: (s["h"] >= 0.6 * F.col("h")) & s["w"].between(0.12 * s["h"], 0.4 * s["h"]) & (s["area"] >= 0.85 * s["w"] * s["h"])
    bar = lambda z: F.coalesce(F.lit(BAR_GLYPHS).contains(z["c"]) & ~(F.lit(BAR_LETTERS).contains(z["c"]) & (word(z["l"]) | word(z["r"]))) & tall(z["s"]), F.lit(False))
    rows = lines.withColumn("c_", chars(F.col("text")))
    usable = F.coalesce((F.size("chars") == F.size("c_")) & (F.size("c_") >= 2), F.lit(False))
    rows = rows.withColumn("each_", F.when(usable, each)).withColumn("kept_", F.filter("each_", lambda z: ~bar(z)))
    drops = F.coalesce(F.size("kept_") < F.size("each_"), F.lit(False))
    rows = rows.withColumn("drops_", drops)
    x = F.col("kept_")[0]["at"]["x0"]
    first = F.col("drops_") & (F.size("kept_") > 0) & bar(F.col("each_")[0])
    text = F.regexp_replace(F.array_join(F.transform("kept_", lambda z: z["c"]), ""), r"(?U)^\s+|\s+$", "")
    out = {
        "text": F.when(F.col("drops_"), text).otherwise(F.col("text")), "chars": F.when(F.col("drops_"), F.transform("kept_", lambda z: z["at"])).otherwise(F.col("chars")),
        "w": F.when(first, F.col("x") + F.col("w") - x).otherwise(F.col("w")), "x": F.when(first, x).otherwise(F.col("x")),
    }
    return rows.withColumns(out).drop("c_", "each_", "kept_", "drops_")


def mixed_lines(lines: DataFrame, strips: DataFrame, least: float = 0.9) -> DataFrame:
    """(page, id, seq, text): lines after a second reading of tall ones in overlapping strips; seq is null for a line itself.

    lines: page, id, box, text, score. strips: page, line, band, seq, box, text, score, what the strips of a line hold. A single
    tall Han sign of low score stays if two bands read it. Of a short tall line with Latin letters, each text's best reading is
    considered, the first of equal ones: under a single letter those with Han signs in two bands, and the letter stays; else
    all if there are two texts and two bands, or the only one if two bands read it and it is part of the line. Readings that
    overlap another line by 0.65 go. A line of which no reading is considered stays.
    """
    texts = strips.groupBy("page", F.col("line").alias("id"), F.col("text").alias("read")).agg(F.collect_set("band").alias("bands"), F.max_by(F.struct("seq", "x", "y", "w", "h"), F.struct("score", -F.col("seq"))).alias("best"))
    of_line = texts.groupBy("page", "id").agg(F.collect_list(F.struct("read", "bands", "best")).alias("texts"))  # of one line's strips
    own = Box(*(F.col(c) for c in "xywh"))
    rows = lines.join(of_line, ["page", "id"], "left").withColumn("texts", F.coalesce("texts", F.array()))
    two = lambda t: F.size(t["bands"]) >= 2
    letter = F.trim("text").rlike("^[A-Za-z]$")
    bands = F.size(F.array_distinct(F.flatten(F.transform("texts", lambda t: t["bands"]))))
    other = F.when((F.size("texts") >= 2) & (bands >= 2), F.col("texts")).when(F.size("texts") == 1, F.filter("texts", lambda t: two(t) & F.col("text").contains(t["read"])))
    found = F.when(letter, F.filter("texts", lambda t: two(t) & t["read"].rlike("[㐀-鿿]"))).otherwise(other)
    rows = rows.withColumn("mixed", short_tall_mixed(F.col("text"), own.w, own.h)).withColumn("found", F.when(F.col("mixed"), F.coalesce(found, F.array())).otherwise(F.array()))
    doubtful = icon_like_character(F.col("text"), own.w, own.h, F.col("score"), least)
    stays = F.when(doubtful, F.exists("texts", lambda t: two(t) & (t["read"] == F.col("text")))).when(F.col("mixed") & (F.size("found") > 0), letter).otherwise(F.lit(True))
    told = rows.where("size(found) > 0").select("page", "id", F.explode("found").alias("t")).select("page", "id", F.col("t.read").alias("text"), "t.best.*")
    met = touching(told, lines.select("page", "id", "x", "y", "w", "h")).where((F.col("a_id") != F.col("b_id")) & (geom.overlap_smaller(geom.box("a_"), geom.box("b_")) >= 0.65))
    met = met.select(F.col("a_page").alias("page"), F.col("a_id").alias("id"), F.col("a_seq").alias("seq")).distinct()
    return rows.where(stays).select("page", "id", F.lit(None).cast("long").alias("seq"), "text").unionByName(told.join(met, ["page", "id", "seq"], "left_anti").select("page", "id", "seq", "text"))


def text_fits(ink: Box, around: Box, margin: int = 2) -> Column:
    """A line's ink lies in a box with a margin, and the box has three times its area at least."""
    solid = (ink.w > 0) & (ink.h > 0) & (around.w > 0) & (around.h > 0)
    return solid & (around.area >= 3 * ink.area) & (around.x + margin <= ink.x) & (around.y + margin <= ink.y) & (ink.right <= around.right - margin) & (ink.bottom <= around.bottom - margin)


def icon_sized(b: Box, width: int, height: int, low: float = 0.011, high: float = 0.12) -> Column:
    """A box of an icon's size, four times as long as wide at most, that does not touch the page's edge."""
    long_, short = F.greatest(b.w, b.h), F.least(b.w, b.h)
    least, most = max(12, int(width * low)), int(width * high)
    return long_.between(least, most) & (short >= 0.6 * least) & (long_ <= 4 * F.greatest(F.lit(1), short)) & (b.x > 1) & (b.y > 1) & (b.right < width - 1) & (b.bottom < height - 1)


def scene_fragment(b: Box, score: Column, kind: Column, why: Column, busy: Column, width: int, height: int) -> Column:
    """Why an element is a piece of an illustration, null if it is none.

    why: how it was found ('manual', 'learned', 'arrow' or other); busy: share of textured pixels around it. Only icons that
    the rules found are judged; arrows by size and score alone.
    """
    long_, short, page = F.greatest(b.w, b.h), F.least(b.w, b.h), width * height
    arrow = F.when(((b.area > 0.012 * page) & (score < 90)) | ((short < 0.012 * width) & (score < 60)), "line of a picture")
    scene = (busy >= 0.42) | ((busy >= 0.3) & (score < 95))
    strip = (long_ > 3 * short) & (score < 90) & (b.area > 0.004 * page)
    large = ((b.area > 0.04 * page) & (score < 70)) | ((b.area > 0.015 * page) & (score < 60))
    other = F.when(short < 0.02 * width, "small part").when(scene, "within a scene").when(strip, "strip of a picture").when(large, "background")
    return F.when((kind == "icon") & ~why.isin("manual", "learned"), F.when(why == "arrow", arrow).otherwise(other))
