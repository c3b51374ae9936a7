"""Joins and aggregates over the marks of a page: discs, edges, peers, block outlines, fitted widths and planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geom
from ..functions.text import let
from .spatial import touching


def texts_in_discs(discs: DataFrame, lines: DataFrame, share: float = 0.7) -> DataFrame:
    """(page, disc_id, line_id, distance): lines whose center is nearer to a disc's center than `share` of its radius.

    discs: page, id, cx, cy, r; lines: page, id, x, y, w, h. A center is a box of one pixel's width that meets the disc's box.
    """
    r = F.col("r")
    around = discs.select("page", "id", "cx", "cy", "r", (F.col("cx") - r).alias("x"), (F.col("cy") - r).alias("y"), (2 * r).alias("w"), (2 * r).alias("h"))
    centers = lines.select("page", "id", (F.col("x") + F.col("w") / 2 - 0.5).alias("x"), (F.col("y") + F.col("h") / 2 - 0.5).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    far = F.hypot(F.col("b_x") + 0.5 - F.col("a_cx"), F.col("b_y") + 0.5 - F.col("a_cy"))
    near = touching(around, centers).withColumn("distance", far).where(F.col("distance") < share * F.col("a_r"))
    return near.select(F.col("a_page").alias("page"), F.col("a_id").alias("disc_id"), F.col("b_id").alias("line_id"), "distance")


def edge_pairs(edges: DataFrame, least: int, cell: int = 128) -> DataFrame:
    """(page, left_id, right_id, x, y, w, h): pairs of vertical edges at least `least` apart that face each other for as long.

    Edges (page, id, x, y, w, h) are joined by horizontal bands of the page; a pair is kept in the band where its common
    stretch begins.
    """
    mid = F.col("x") + F.floor(F.col("w") / 2)
    band = lambda p: edges.select(F.col("page").alias(f"{p}page"), F.col("id").alias(f"{p}id"), mid.alias(f"{p}m"), F.col("y").alias(f"{p}y"), (F.col("y") + F.col("h")).alias(f"{p}low"), F.explode(F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("h")) / cell))).alias(f"{p}band"))
    top, low = F.greatest("a_y", "b_y"), F.least("a_low", "b_low")
    keys = (F.col("a_page") == F.col("b_page")) & (F.col("a_band") == F.col("b_band")) & (F.floor(top / cell) == F.col("a_band"))
    pairs = band("a_").join(band("b_"), keys & (F.col("b_m") - F.col("a_m") >= least) & (low - top >= least))
    return pairs.select(F.col("a_page").alias("page"), F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), F.col("a_m").alias("x"), top.alias("y"), (F.col("b_m") - F.col("a_m")).alias("w"), (low - top).alias("h"))


def family_of_peers(lines: DataFrame, rounds: int = 2, most: float = 28.0) -> DataFrame:
    """(page, id, family) of all lines: small ones of a clear minority take the family of their peers.

    lines: page, id, size, r, g, b, family ('serif' or 'sans', or none), text. Lines of ASCII alone, or without a family, take no part. Peers
    are lines of the page whose size is within 6 % and whose colour is near, at least three with the line itself; a line of
    size 0 has none. Serif lines change where serif has under 45 % of the peers' characters, others where it has over 55 %.
    All change at once, `rounds` times.
    """
    part = (F.col("size") < most) & F.col("text").rlike(r"[^\x00-\x7f]") & F.col("family").isNotNull()
    small = lines.where(part).select("page", "id", "size", "r", "g", "b", F.length("text").alias("n"), "family")
    step = lambda c: F.floor(F.log(c) / F.log(F.lit(1.07)))  # noqa: E731  sizes within 6 % lie in neighbouring steps
    for _ in range(rounds):
        one = small.withColumnsRenamed({c: f"a_{c}" for c in small.columns}).withColumn("step", F.explode(F.array(*[step("a_size") + k for k in (-1, 0, 1)])))
        two = small.withColumnsRenamed({c: f"b_{c}" for c in small.columns}).withColumn("step_", step("b_size"))
        alike = (F.abs(F.col("b_size") - F.col("a_size")) < 0.06 * F.col("a_size")) & geom.color_close([F.col(f"a_{c}") for c in "rgb"], [F.col(f"b_{c}") for c in "rgb"])
        peers = one.join(two, (F.col("a_page") == F.col("b_page")) & (F.col("step") == F.col("step_")) & alike)
        counts = peers.groupBy(F.col("a_page").alias("page"), F.col("a_id").alias("id")).agg(F.count("*").alias("peers"), F.sum("b_n").alias("all"), F.sum(F.when(F.col("b_family") == "serif", F.col("b_n")).otherwise(0)).alias("serif"))
        share = F.try_divide(F.col("serif"), F.col("all"))
        to = F.when((F.col("family") == "serif") & (share < 0.45), "sans").when((F.col("family") == "sans") & (share > 0.55), "serif").otherwise(F.col("family"))
        small = small.join(counts, ["page", "id"], "left").withColumn("family", F.when(F.col("peers") >= 3, to).otherwise(F.col("family"))).select("page", "id", "size", "r", "g", "b", "n", "family")
    return lines.join(small.select("page", "id", F.col("family").alias("new")), ["page", "id"], "left").select("page", "id", F.coalesce("new", "family").alias("family"))


def wire_blocks(lines: DataFrame) -> DataFrame:
    """(page, block, x, y, w, h, score, text): each block's outline, its least score in hundredths, and its lines' texts."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n")
    left, top = F.min("x"), F.min("y")
    return lines.groupBy("page", "block").agg(left.alias("x"), top.alias("y"), (F.max(F.col("x") + F.col("w")) - left).alias("w"), (F.max(F.col("y") + F.col("h")) - top).alias("h"), F.bround(F.min("score") * 100).cast("long").alias("score"), texts.alias("text"))


def any_all(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """(key, any, all): whether some and whether every row of a key has the flag; a null flag is passed over."""
    return df.groupBy(key).agg(F.bool_or(flag).alias("any"), F.bool_and(flag).alias("all"))


def refitted(lines: DataFrame, widths: DataFrame) -> DataFrame:
    """(page, id, fit, size): letter spacing and size with which a line's text takes 98.5 % of its ink's width.

    lines: page, id, text, ink (its width), size; widths: ch, width of each character in units of the size, others 1. The
    spacing stays between -0.06 and 0.03, up to 1.6 for text spaced out widely; what is too wide even then gets smaller, to 86 %.
    """
    chars = lines.where((F.col("size") > 0) & (F.length("text") > 0)).select("page", "id", "text", "ink", "size", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    sums = chars.join(F.broadcast(widths), "ch", "left").groupBy("page", "id", "text", "ink", "size").agg(F.sum(F.coalesce("width", F.lit(1.0))).alias("units"))  # widths is a font's table
    n, target = F.length("text"), F.col("ink") * 0.985
    dash = F.startswith("text", F.lit("—"))
    wide = sums.withColumn("need", (target - F.col("units") * F.col("size")) / n / F.col("size"))
    wide = wide.withColumn("fit", F.greatest(F.lit(-0.06), F.least(F.col("need"), F.when(dash, 0.01).when(F.col("need") > 0.1, 1.6).otherwise(0.03))))
    shrink = F.greatest(F.lit(0.86), F.least(F.lit(1.0), target / (F.col("units") * F.col("size") + F.col("fit") * n * F.col("size"))))
    return wide.select("page", "id", "fit", F.when(F.col("need") < -0.06, F.col("size") * shrink).otherwise(F.col("size")).alias("size"))


def fitted_planes(points: DataFrame, key: str) -> DataFrame:
    """(key, c0, cu, cv): least squares of z on 1, u and v, by sums; null where the points lie on a line or are under three."""
    names = {"n": F.count("z").cast("double"), "u": F.sum("u"), "v": F.sum("v"), "uu": F.sum(F.col("u") * F.col("u")), "uv": F.sum(F.col("u") * F.col("v")), "vv": F.sum(F.col("v") * F.col("v")), "z": F.sum("z"), "uz": F.sum(F.col("u") * F.col("z")), "vz": F.sum(F.col("v") * F.col("z"))}
    sums = points.where("z is not null").groupBy(key).agg(*[s.alias(f"s_{k}") for k, s in names.items()])
    c = lambda k: F.col(f"s_{k}")
    # Sums about the means leave two equations.
    about = lambda k, a, b: c(k) - c(a) * c(b) / c("n")
    uu, uv, vv, uz, vz = about("uu", "u", "u"), about("uv", "u", "v"), about("vv", "v", "v"), about("uz", "u", "z"), about("vz", "v", "z")
    det = uu * vv - uv * uv
    real = (c("n") >= 3) & (det > 1e-9 * uu * vv)
    out = sums.withColumn("cu", F.when(real, (uz * vv - vz * uv) / det)).withColumn("cv", F.when(real, (vz * uu - uz * uv) / det))
    return out.select(key, ((c("z") - F.col("cu") * c("u") - F.col("cv") * c("v")) / c("n")).alias("c0"), "cu", "cv")


#: The powers of u and v in the terms of a surface: 1, u, v, u u, u v and v v.
TERMS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))


def _solved(rows: Column) -> Column:
    """The solution of linear equations, [(coefficients.., right side)], by elimination with row pivots; null without a clear one."""
    n = len(TERMS)
    cell = lambda m, r, c: F.get(F.get(m, r), c)

    def cleared(m: Column, k: Column, p: Column) -> Column:
        swapped = F.transform(m, lambda row, r: F.when(r == k, F.get(m, p)).when(r == p, F.get(m, k)).otherwise(row))
        top = lambda s: F.transform(F.get(s, k), lambda v: v / cell(s, k, k))
        below = lambda s, t: F.transform(s, lambda row, r: F.when(r == k, t).otherwise(F.zip_with(row, t, lambda a, b: a - F.get(row, k) * b)))
        return let(swapped, lambda s: let(top(s), lambda t: below(s, t)))

    def step(m: Column, k: Column) -> Column:
        largest = F.array_max(F.transform(F.sequence(k, F.lit(n - 1)), lambda r: F.struct(F.abs(cell(m, r, k)).alias("size"), (-r).alias("less"))))
        return let(largest, lambda z: F.when(z["size"] > 1e-9 * F.get(F.get(rows, F.lit(0)), F.lit(0)), cleared(m, k, -z["less"])))

    done = F.aggregate(F.array(*map(F.lit, range(n))), rows, step)
    return F.transform(done, lambda row: F.get(row, F.lit(n)))


def fitted_surfaces(points: DataFrame, key: str) -> DataFrame:
    """(key, c): least squares of z on 1, u, v, u u, u v and v v, by sums; the plane with three zeros where that has no clear
    solution or points are under six, and null where there is no plane either. u and v should be scaled to about -1 .. 1."""
    power = lambda i, j: F.pow("u", F.lit(i)) * F.pow("v", F.lit(j))
    sums = {f"m_{i}_{j}": F.sum(power(i, j)) for i in range(5) for j in range(5 - i)} | {f"z_{i}_{j}": F.sum(power(i, j) * F.col("z")) for i, j in TERMS}
    rows = points.where("z is not null").groupBy(key).agg(F.count("*").alias("n"), *[s.alias(k) for k, s in sums.items()])
    equations = F.array(*[F.array(*[F.col(f"m_{a + c}_{b + d}") for c, d in TERMS], F.col(f"z_{a}_{b}")) for a, b in TERMS])
    solved = rows.withColumn("rows", equations).withColumn("c", F.when(F.col("n") >= len(TERMS), _solved(F.col("rows"))))
    planes = fitted_planes(points, key)
    plane = F.when(F.col("cu").isNotNull(), F.array("c0", "cu", "cv", *[F.lit(0.0)] * 3))
    return solved.join(planes, key, "left").select(key, F.coalesce("c", plane).alias("c"))


CJK = "^[\\u4e00-\\u9fff]+$"


def without_lone_glyphs(lines: DataFrame, least: float = 0.9) -> DataFrame:
    """Lines less single CJK characters of a score under `least` that have no line beside them: those are icons.

    Beside is a center within 0.6 of the character's height, and an edge within 1.5 of it.
    """
    lone = lines.where((F.length("text") == 1) & F.rlike("text", F.lit(CJK)) & (F.col("score") < least)).select("page", "id", "x", "y", "w", "h")
    a, b = geom.box("a_"), geom.box("b_")
    reach = geom.Box(a.x - 1.5 * a.h - 1, a.y - 0.2 * a.h - 1, a.w + 3 * a.h + 2, 1.4 * a.h + 2)
    level = F.abs(b.y + b.h / 2 - a.y - a.h / 2) < 0.6 * a.h
    beside = F.least(F.abs(b.x - a.right), F.abs(a.x - b.right)) < 1.5 * a.h
    near = touching(lone, lines.select("page", "id", "x", "y", "w", "h"), reach_left=reach).where((F.col("a_id") != F.col("b_id")) & level & beside)
    gone = lone.join(near.select(F.col("a_page").alias("page"), F.col("a_id").alias("id")).distinct(), ["page", "id"], "left_anti")
    return lines.join(gone.select("page", "id"), ["page", "id"], "left_anti")


def vertical_split(lines: DataFrame) -> DataFrame:
    """(page, id, i, text, x, y, w, h): upright CJK lines as one line for each character; others as they are, with i 0.

    A line is upright if it is 2.2 times as high as wide, and 0.8 of its width high for each character.
    """
    n = F.length("text")
    upright = (n >= 2) & F.rlike("text", F.lit(CJK)) & (F.col("h") >= 2.2 * F.col("w")) & (F.col("h") >= 0.8 * n * F.col("w"))
    step = F.col("h") / n
    one = lambda i: F.struct(i.alias("i"), F.substr("text", i + 1, F.lit(1)).alias("text"), F.bround(F.col("y") + i * step).cast("long").alias("y"), F.bround(step).cast("long").alias("h"))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.col("text"), F.col("y").cast("long").alias("y"), F.col("h").cast("long").alias("h")))
    rows = F.when(upright, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(whole)
    return lines.select("page", "id", "x", "w", F.explode(rows).alias("r")).select("page", "id", "r.i", "r.text", "x", "r.y", "w", "r.h")
