"""Layout decisions: what is part of what among found pictures, lines cut at wide gaps, and axes that form an L."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geom
from ..functions.text import chars, let
from .spatial import spread, touching

#: Least score of an icon, and what a demoted one has at most.
KEEP_SCORE, DEMOTED = 55, 40
#: Why a candidate goes, in words of our own.
PART, BAND, CONTAINER, HOLE = "part of the icon around it", "band under a light icon", "only holds another icon", "gap inside the icon around it"


def contained_icons(icons: DataFrame) -> DataFrame:
    """(page, id, score, why, kept): candidates of which one holds another, decided in order of id; a later decision overrules an earlier one.

    icons: page, id, box, score, pale (a pale one that failed), light, fill (pixels filled), rest (own pixels left without what it
    holds), r, g, b (median colour), rest_r, rest_g, rest_b (that of its rest). A candidate that passes holds those that lie
    in it by over 0.4 and have 0.6 of its area at most, save pale ones. If some of those are light and it isn't, it is a band
    and goes. If under 20 pixels of its own are left, or all have its colour, they are its parts and go. If none has, it is a
    container and goes if one has a shape (fills less than 0.86 of its box, or is light); else they are gaps and go.
    """
    a, b = geom.box("a_"), geom.box("b_")
    pairs = touching(icons.where(F.col("score") >= KEEP_SCORE), icons.where("not pale")).where("a_id <> b_id")
    pairs = pairs.where((geom.meet(a, b) / b.area > 0.4) & (b.area <= 0.6 * a.area))
    gap = sum(((F.col(f"b_{c}") - F.col(f"a_rest_{c}")) * (F.col(f"b_{c}") - F.col(f"a_rest_{c}")) for c in "rgb"), F.lit(0))
    shaped = (F.col("b_fill") < 0.86 * b.area) | F.col("b_light")
    own = pairs.groupBy("a_page", "a_id").agg(
        F.max(F.col("b_light") & ~F.col("a_light")).alias("band"), F.max(F.col("a_rest") < 20).alias("bare"), F.min(gap < 70 * 70).alias("all_same"), F.max(gap < 70 * 70).alias("some_same"), F.max(shaped).alias("shaped"), F.collect_set("b_id").alias("held")
    )
    outer = F.when(F.col("band"), BAND).when(~F.col("bare") & ~F.col("some_same") & F.col("shaped"), CONTAINER)
    inner = F.when(F.col("band"), None).when(F.col("bare") | F.col("all_same"), PART).when(~F.col("some_same") & ~F.col("shaped"), HOLE)
    said = own.select(F.col("a_page").alias("page"), F.col("a_id").alias("turn"), F.explode(F.when(outer.isNotNull(), F.array("a_id")).otherwise(F.col("held"))).alias("id"), F.coalesce(outer, inner).alias("why")).where("why is not null")
    last = said.groupBy("page", "id").agg(F.max_by("why", "turn").alias("why"))
    out = icons.join(last, ["page", "id"], "left")
    score = F.when(F.col("why").isNotNull(), F.least("score", F.lit(DEMOTED))).otherwise(F.col("score"))
    return out.select("page", "id", score.alias("score"), "why", (F.col("why").isNull() & (F.col("score") >= KEEP_SCORE)).alias("kept"))


def without_photo_cards(photos: DataFrame) -> DataFrame:
    """(page, id) of photos that are no cards around other photos, and of those that meet by over 0.6 of the smaller one the largest.

    photos: page, id, box, free (share of the box left without inner photos and text), drawn (share of what is left that is not
    the page's background, null if nothing is), plain (share of it near its commonest colour). A photo holds those that lie in
    it by over 0.9 and have less than 0.8 of its area. If it holds some it stays if little is left (under 0.15) and that is
    drawn, or if much is left that is not plain (0.45 at most).
    """
    from .folds import greedy_dedupe

    a, b = geom.box("a_"), geom.box("b_")
    pairs = touching(photos, photos).where("a_id <> b_id").where((geom.meet(a, b) > 0.9 * b.area) & (b.area < 0.8 * a.area))
    holders = pairs.select(F.col("a_page").alias("page"), F.col("a_id").alias("id")).distinct().withColumn("holds", F.lit(True))
    one_photo = F.when(F.col("free") < 0.15, F.coalesce(F.col("drawn") >= 0.5, F.lit(False))).otherwise(F.col("plain") <= 0.45)
    kept = photos.join(holders, ["page", "id"], "left").where(F.col("holds").isNull() | one_photo)
    return greedy_dedupe(kept, 0.6, largest_first=True)


#: Marks after which, and before which, a line is open anyway.
OPEN_AFTER, OPEN_BEFORE = "，。、；：！？,.;:!?）)”’》」』】…—丨|·", "（(“‘《「『【丨|·"


def _middle(values: Column) -> Column:
    """The median of an array, null if it is empty."""
    return let(F.array_sort(values), lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)


def _share(values: Column, part: float) -> Column:
    """The percentile of an array, between two values in proportion."""
    at = lambda v: (F.size(v) - 1) * F.lit(part)
    low = lambda v: F.get(v, F.floor(at(v)).cast("int"))
    return let(F.array_sort(values), lambda v: low(v) + (F.coalesce(F.get(v, F.floor(at(v)).cast("int") + 1), low(v)) - low(v)) * (at(v) - F.floor(at(v))))


def split_at_gaps(lines: DataFrame) -> DataFrame:
    """(page, id, part, text, x, w, chars): lines cut where two parts were read as one, and with a space at lesser gaps.

    lines: page, id, x, w, h, text, chars ([(x0, x1)] of each character), gaps (clear width between neighbours, less what the
    characters leave by themselves), apart (how far the colours on either side are). Gaps are held against the line's
    median gap, those beside punctuation aside; a line that is spaced out as a whole (of four gaps or more the 30th
    percentile is 0.35 of a character) stays. 0.9 of a character more than the median, and three times it, cuts, as does
    less in large type between parts of other colours; 0.45 of a character makes a space, but not between ASCII characters.
    Lines without a place for each character stay as they are.
    """
    rows = spread(lines).withColumn("c", chars(F.col("text")))
    usable = F.col("chars").isNotNull() & (F.size("chars") == F.size("c")) & (F.size("c") >= 2)
    code = lambda x, pattern: F.coalesce(x.rlike(pattern), F.lit(False))
    wide = F.transform(F.filter(F.arrays_zip("c", "chars"), lambda z: code(z["c"], "^[一-鿿]$") & (z["chars"]["x1"] > z["chars"]["x0"])), lambda z: (z["chars"]["x1"] - z["chars"]["x0"]).cast("double"))
    rows = rows.withColumn("em", F.when(F.size(wide) >= 3, F.least(0.8 * F.col("h"), _middle(wide))).otherwise(0.8 * F.col("h")))
    beside = lambda i: F.lit(OPEN_AFTER).contains(F.get("c", i)) | F.lit(OPEN_BEFORE).contains(F.get("c", i + 1))
    normal = F.transform(F.filter(F.transform("gaps", lambda g, i: F.struct(g.alias("g"), beside(i).alias("open"))), lambda z: ~z["open"]), lambda z: z["g"])
    rows = rows.withColumn("normal", normal).withColumn("base", F.coalesce(_middle(F.col("normal")), F.lit(0.0)))
    spaced = (F.size("normal") >= 4) & (_share(F.col("normal"), 0.3) >= 0.35 * F.col("em"))
    em, base = F.col("em"), F.col("base")
    both = lambda i, pattern: code(F.get("c", i), pattern) & code(F.get("c", i + 1), pattern)

    def kind(g: Column, i: Column) -> Column:
        blank = (F.get("c", i) == " ") | (F.get("c", i + 1) == " ")
        far = g >= 3 * F.greatest(base, F.lit(1.0))
        styles = (em >= 36) & both(i, r"^[\p{L}\p{N}]$") & (g >= F.greatest(0.3 * em, 2.5 * F.greatest(base, F.lit(1.0)))) & (F.get("apart", i) > 90)
        return F.when(beside(i) | blank, 0).when(((g - base >= 0.9 * em) & far) | styles, 2).when((g - base >= 0.45 * em) & far & ~both(i, r"^[\x00-\x7f]$"), 1).otherwise(0)

    rows = rows.withColumn("spaced", spaced).withColumn("kinds", F.when(usable & ~F.col("spaced"), F.transform("gaps", kind)))
    rows = rows.withColumn("cut", F.coalesce(F.exists("kinds", lambda k: k > 0), F.lit(False)))
    ends = F.concat(F.filter(F.transform("kinds", lambda k, i: F.when(k == 2, i + 1)), lambda i: i.isNotNull()), F.array(F.size("c")))
    begins = F.concat(F.array(F.lit(0)), F.filter(F.transform("kinds", lambda k, i: F.when(k == 2, i + 1)), lambda i: i.isNotNull()))
    place = lambda x0, x1: F.struct(x0.alias("x0"), x1.alias("x1"))
    each = F.transform("c", lambda ch, k: F.when(F.get("kinds", k - 1) == 1, F.struct(F.concat(F.lit(" "), ch).alias("t"), F.array(place(F.get("chars", k - 1)["x1"], F.get("chars", k)["x0"]), F.get("chars", k)).alias("s"))).otherwise(F.struct(ch.alias("t"), F.array(F.get("chars", k)).alias("s"))))
    rows = rows.withColumns({"each": each, "ends": ends})
    row = lambda part, text, x, w, spans: F.struct(part.alias("part"), text.alias("text"), x.alias("x"), w.alias("w"), spans.alias("chars"))
    x = lambda spans: F.get(spans, F.lit(0))["x0"]
    held = lambda i, own: let(F.flatten(F.transform(own, lambda e: e["s"])), lambda spans: row(i, F.array_join(F.transform(own, lambda e: e["t"]), ""), x(spans), F.element_at(spans, -1)["x1"] - x(spans), spans))
    parts = F.transform(begins, lambda a, i: let(F.slice("each", a + 1, F.get("ends", i) - a), lambda own: held(i, own)))
    # Cut or not is decided within the row: a filter would be pushed below and work out median and gaps anew at every gap.
    out = rows.select("page", "id", F.explode(F.when(F.col("cut"), parts).otherwise(F.array(row(F.lit(0), *map(F.col, ("text", "x", "w", "chars")))))).alias("p"))
    return out.select("page", "id", "p.*")


#: Words of an axis in order.
GRADES = {"低": 0, "中": 1, "高": 2, "Low": 0, "Medium": 1, "High": 2}


def axis_corners(lines: DataFrame) -> DataFrame:
    """(page, column_id, row_id, x, y, w, h): a column of grades and a row of grades that form an L, by their first lines, and the box around both.

    lines: page, id, box, text. Each grade word gathers those whose centers lie within 0.6 of its height (8 at least) of its
    own axis; three different ones, high to low downwards or low to high to the right, at least two heights apart and about
    evenly, are an axis; the first found of those with the same first line counts. The row starts below the column and right
    of it: by up to a line's height before, and by less than 5 and 6 after.
    """
    grade = F.create_map(*[F.lit(v) for pair in GRADES.items() for v in pair])
    marks = lines.withColumn("grade", F.element_at(grade, F.trim("text"))).where("grade is not null and h > 0")
    pages = marks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "grade", "x", "y", "w", "h", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy")))).alias("marks"))

    def axes(key: str, pos: str, down: bool) -> DataFrame:
        def axis(seed: Column) -> Column:
            near = F.filter("marks", lambda m: F.abs(m[key] - seed[key]) <= F.greatest(F.lit(8.0), 0.6 * seed["h"]))
            by_place = F.array_sort(F.transform(near, lambda m: F.struct(m[pos].alias("at"), m["id"].alias("no"), m.alias("m"))))
            return F.struct(seed["id"].alias("seed"), seed["h"].alias("tall"), F.transform(by_place, lambda z: z["m"]).alias("of"))

        found = pages.select("page", F.explode(F.transform("marks", axis)).alias("a")).select("page", "a.*")
        grades = F.transform("of", lambda m: m["grade"])
        step = lambda i: F.get("of", F.lit(i + 1))[pos] - F.get("of", F.lit(i))[pos]
        even = (F.least(step(0), step(1)) >= 2 * F.col("tall")) & (F.greatest(step(0), step(1)) <= 1.5 * F.least(step(0), step(1)))
        found = found.where((F.size("of") == 3) & (grades == F.array(*map(F.lit, (2, 1, 0) if down else (0, 1, 2)))) & even)
        return found.groupBy("page", F.get("of", F.lit(0))["id"].alias("first")).agg(F.min_by("of", "seed").alias("of"))

    least = lambda ms, f: F.array_min(F.transform(ms, f))
    most = lambda ms, f: F.array_max(F.transform(ms, f))
    pairs = axes("cx", "cy", True).select("page", F.col("first").alias("column_id"), F.col("of").alias("col")).join(axes("cy", "cx", False).select("page", F.col("first").alias("row_id"), F.col("of").alias("row")), "page")
    pairs = pairs.withColumns({"tall": _middle(F.transform(F.concat("col", "row"), lambda m: m["h"].cast("double"))), "right": most("col", lambda m: m["x"] + m["w"]), "low": most("col", lambda m: m["y"] + m["h"]), "left": least("row", lambda m: m["x"]), "top": least("row", lambda m: m["y"])})
    down, across = F.col("top") - F.col("low"), F.col("left") - F.col("right")
    pairs = pairs.where((down >= -F.col("tall")) & (down < 5 * F.col("tall")) & (across >= -F.col("tall")) & (across < 6 * F.col("tall")))
    x, y = least("col", lambda m: m["x"]), least("col", lambda m: m["y"])
    return pairs.select("page", "column_id", "row_id", x.alias("x"), y.alias("y"), (most("row", lambda m: m["x"] + m["w"]) - x).alias("w"), (most("row", lambda m: m["y"] + m["h"]) - y).alias("h"))


#: A row or column of this share of background is empty; a cut between panels needs this much.
EMPTY, SEAM = 0.995, 0.55
#: Width by height of a panel, and how many there may be in a band.
SHAPE, PANELS = (1.15, 2.2), 8


def sheet_panels(cells: DataFrame) -> DataFrame:
    """(page, panel, x, y, w, h): the pages that a contact sheet shows, in reading order; nothing for a single page.

    cells: page, r, c, pure (background or not), a row for each pixel of a coarse image. Empty rows cut a sheet into bands; a band
    is cut into as many equally wide panels as their shape allows, each cut at the emptiest column near its place. Panels
    lose their empty margins. A sheet has two bands at least, panels of much the same shape, and they cover 0.4 of it.
    """
    from .sequences import segments

    share = F.avg(F.col("pure").cast("double"))
    size = cells.groupBy("page").agg((F.max("r") + 1).alias("H"), (F.max("c") + 1).alias("W"))
    rows = cells.groupBy("page", "r").agg((share >= EMPTY).alias("gap"))
    bands = segments(rows, "page", "r", "gap", 3, 0).join(size, "page").where(F.col("stop") - F.col("start") >= F.floor(0.08 * F.col("H")))
    bands = bands.select("page", F.col("start").alias("y0"), F.col("stop").alias("y1"))
    several = bands.groupBy("page").agg(F.count("*").alias("n")).where("n >= 2").select("page")
    bands = bands.join(several, "page", "left_semi")
    inside = cells.join(bands, "page").where("r >= y0 and r < y1")
    columns = inside.groupBy("page", "y0", "y1", "c").agg(share.alias("s")).groupBy("page", "y0", "y1").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "s"))), lambda z: z["s"]).alias("cs"))
    full = F.filter(F.transform("cs", lambda s, i: F.when(s < EMPTY, i)), lambda i: i.isNotNull())
    columns = columns.withColumns({"a": F.array_min(full), "b": F.array_max(full) + 1}).where("a is not null")
    a, b, tall = F.col("a"), F.col("b"), F.col("y1") - F.col("y0")

    tried = columns.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(PANELS)))).withColumn("wide", (b - a) / F.col("k")).where((F.col("wide") / tall).between(*SHAPE))
    reach = F.greatest(F.lit(3), F.floor(0.04 * F.col("wide")).cast("int"))

    def seam(i: Column) -> Column:
        """The emptiest column near the i-th cut's place, the first on a tie; null if it is not empty enough."""
        place = F.floor(a + i * F.col("wide")).cast("int")
        first = lambda c: F.greatest(a, c - reach)
        best = lambda c, near: F.when(F.array_max(near) >= SEAM, first(c) + F.array_position(near, F.array_max(near)).cast("int") - 1)
        return let(place, lambda c: let(F.slice("cs", first(c) + 1, F.least(b, c + reach) - first(c)), lambda near: best(c, near)))

    seams = F.when(F.col("k") > 1, F.transform(F.sequence(F.lit(1), F.col("k") - 1), seam)).otherwise(F.expr("cast(array() as array<int>)"))
    tried = tried.withColumn("seams", seams).where(~F.exists("seams", lambda c: c.isNull()))
    parts = tried.groupBy("page", "y0", "y1").agg(F.max_by(F.concat(F.array("a"), "seams", F.array("b")), "k").alias("cuts"))
    parts = parts.select("page", "y0", "y1", F.explode(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("x0"), F.get("cuts", i + 1).alias("x1")))).alias("p")).select("page", "y0", "y1", "p.*")
    held = cells.join(parts, "page").where("r >= y0 and r < y1 and c >= x0 and c < x1")
    panel = ["page", "y0", "y1", "x0", "x1"]
    edges = lambda by, low, high: held.groupBy(*panel, by).agg(share.alias("s")).where(F.col("s") < EMPTY).groupBy(*panel).agg(F.min(by).alias(low), F.max(by).alias(high))
    boxes = edges("c", "x", "right").join(edges("r", "y", "low"), panel).select("page", "y0", "x0", "x", "y", (F.col("right") - F.col("x") + 1).alias("w"), (F.col("low") - F.col("y") + 1).alias("h"))
    shape = F.col("w") / F.col("h")
    sums = boxes.groupBy("page").agg(F.count("*").alias("n"), F.min(shape).alias("narrow"), F.max(shape).alias("broad"), F.sum(F.col("w") * F.col("h")).alias("area")).join(size, "page")
    real = sums.where((F.col("n") >= 2) & (F.col("broad") <= 1.25 * F.col("narrow")) & (F.col("area") >= 0.4 * F.col("W") * F.col("H"))).select("page")
    order = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0"))
    return boxes.join(real, "page", "left_semi").select("page", order.alias("panel"), "x", "y", "w", "h")
