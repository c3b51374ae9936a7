"""Weights and colours of lines and runs brought in line with those that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geom
from ..functions.text import let
from .spatial import previous_line

#: A group is of one weight if this share of its characters is bold, or at most that one is.
MOST, LEAST = (2, 3), (1, 3)
#: Two serif lines whose strokes differ by less, in proportion to their sizes, have one weight.
SAME_STROKE = 1.15


def harmonised_bold(lines: DataFrame) -> DataFrame:
    """(page, id, bold, heavy): lines that follow each other in a column, of one size and colour, take the weight of most characters.

    lines: page, id, x0 (left edge of the ink, null without), y, baseline, size, r, g, b, bold, heavy, family, stroke, text, badge, n_runs.
    From left to right, then down, each line that no group has taken starts a chain: going down, every free line that fits the
    chain's last one is added. Chains of three or more take their lines for good; if two thirds of their characters are bold,
    or at most a third are, all lines become so. A chain of two serif lines of unequal weight whose strokes are much the same
    takes both, and neither stays bold. Badges, lines without ink and lines of several runs take no part.
    """
    part = lines.where("not badge and x0 is not null and n_runs <= 1")
    item = F.struct("x0", "y", "id", "baseline", "size", "r", "g", "b", "bold", "family", "stroke", F.length("text").alias("n"))
    pages = part.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("across"), F.array_sort(F.collect_list(F.struct(F.col("y").alias("at"), F.col("x0").alias("from"), F.col("id").alias("no"), item.alias("line")))).alias("down"))
    pages = pages.select("page", "across", F.transform("down", lambda d: d["line"]).alias("down"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("used"), F.expr("cast(array() as array<struct<id:bigint,bold:boolean,regular:boolean>>)").alias("out"))

    def fits(b: Column, last: Column) -> Column:
        near = (F.abs(b["x0"] - last["x0"]) < 0.6 * last["size"]) & (F.abs(b["size"] - last["size"]) < 0.15 * last["size"])
        style = geom.color_close([b[c] for c in "rgb"], [last[c] for c in "rgb"])
        return near & style & (b["y"] > last["y"]) & (b["baseline"] - last["baseline"] < 2.2 * last["size"])

    def chain(used: Column, a: Column) -> Column:
        free = lambda b: (b["id"] != a["id"]) & ~F.array_contains(used, b["id"])
        return F.aggregate("down", F.array(a), lambda g, b: F.when(free(b) & fits(b, F.element_at(g, -1)), F.concat(g, F.array(b))).otherwise(g))

    def taken(acc: Column, g: Column) -> Column:
        ids = F.transform(g, lambda b: b["id"])
        n = F.aggregate(g, F.lit(0), lambda t, b: t + b["n"])
        bold = F.aggregate(g, F.lit(0), lambda t, b: t + F.when(b["bold"], b["n"]).otherwise(0))
        stroke = F.transform(g, lambda b: b["stroke"] / F.greatest(F.lit(1.0), b["size"]))
        apart = F.get(g, F.lit(0))["bold"] != F.get(g, F.lit(1))["bold"]
        alike = (F.array_min(stroke) > 0) & (F.array_max(stroke) < SAME_STROKE * F.array_min(stroke)) & F.forall(g, lambda b: b["family"] == "serif")
        two = (F.size(g) == 2) & apart & alike
        most = bold * MOST[1] >= n * MOST[0]
        says = lambda value, regular: F.transform(ids, lambda i: F.struct(i.alias("id"), value.alias("bold"), F.lit(regular).alias("regular")))
        with_ = lambda more: F.struct(F.concat(acc["used"], ids).alias("used"), F.concat(acc["out"], more).alias("out"))
        return F.when(two, with_(says(F.lit(False), True))).when(F.size(g) < 3, acc).when(most | (bold * LEAST[1] <= n * LEAST[0]), with_(says(most, False))).otherwise(F.struct(F.concat(acc["used"], ids).alias("used"), acc["out"].alias("out")))

    step = lambda acc, a: F.when(F.array_contains(acc["used"], a["id"]), acc).otherwise(let(chain(acc["used"], a), lambda g: taken(acc, g)))
    said = pages.select("page", F.explode(F.aggregate("across", start, step, lambda acc: acc["out"])).alias("o")).select("page", "o.id", F.col("o.bold").alias("new"), "o.regular")
    out = lines.join(said, ["page", "id"], "left")
    return out.select("page", "id", F.coalesce("new", "bold").alias("bold"), (F.col("heavy") & ~F.coalesce("regular", F.lit(False))).alias("heavy"))


#: Squared distances of colours: runs of one colour for the page, accents of a line, and accents of one group.
BODY, ACCENT, GROUP = 60**2, 60**2, 90**2
#: Longest accent that is held against others, in CJK characters, and how much thicker its stroke is if it is clearly bold.
LONGEST, THICKER = 12, 1.2
#: After these a sentence doesn't go on in the next line.
STOPS = "。；！？;!?：:"


def _apart(a: str, b: str) -> Column:
    """Squared distance of two colours, by the prefixes of their columns."""
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "rgb"), F.lit(0))


def _renamed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select("page", *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def body_colours(runs: DataFrame) -> DataFrame:
    """(page, r, g, b): of each page the colour around which most CJK characters have theirs, the first by line and run on a tie."""
    place = F.struct("id", "k")
    each = runs.groupBy("page", "r", "g", "b").agg(F.sum("cjk").alias("n"), F.min(place).alias("first"))
    rgb = ["r", "g", "b"]
    pairs = _renamed(each, "a_", [*rgb, "first"]).join(_renamed(each, "b_", [*rgb, "n"]), "page").where(_apart("a_", "b_") < BODY)
    sums = pairs.groupBy("page", *[F.col(f"a_{c}").alias(c) for c in rgb]).agg(F.sum("b_n").alias("n"), F.first("a_first").alias("first"))
    best = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("n"), "first"))
    return sums.withColumn("best", best).where("best = 1").select("page", *rgb)


def harmonised_accents(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(page, id, k, r, g, b, bold) of every run: short accents of one colour on a page are of one weight and colour.

    lines: page, id, x0 (null without ink), y, baseline, size, badge, has_runs; runs: page, id, k, text, r, g, b, bold, px, stroke. A
    line without runs (has_runs false) has one run that stands for it. Of a line's runs the one nearest to the page's body
    colour is its base; runs of other colours with CJK characters are accents. An accent at a line's start that goes on from
    the last run of the line above takes that run's weight and colour. The others, up to LONGEST characters, form groups
    by colour in order of line and run, each around its first; a clearly bold one makes its group bold, and all take the
    most saturated colour.
    """
    runs = runs.withColumn("cjk", F.length(F.regexp_replace("text", "[^\\u4e00-\\u9fff]", "")))
    inside = Window.partitionBy("page", "id")
    counted = runs.join(lines.select("page", "id", "badge", "has_runs"), ["page", "id"]).withColumn("n_runs", F.count("*").over(inside))
    body = _renamed(body_colours(runs), "p_", ["r", "g", "b"])
    several = counted.where("has_runs and not badge and n_runs >= 2").withColumnsRenamed({c: f"o_{c}" for c in "rgb"}).join(body, "page")
    base = F.first(F.struct("o_r", "o_g", "o_b", "k", "stroke", "px")).over(inside.orderBy(_apart("o_", "p_"), "k"))
    marked = several.withColumn("base", base).withColumns({f"s_{c}": F.col(f"base.o_{c}") for c in "rgb"})
    marked = marked.withColumn("all_strokes", F.count("stroke").over(inside) == F.col("n_runs"))
    thick = F.when(F.col("all_strokes") & (F.col("base.stroke") > 0) & (F.col("stroke") > 0), (F.col("stroke") / F.col("px")) / (F.col("base.stroke") / F.col("base.px")) >= THICKER).otherwise(False)
    accents = marked.where((F.col("k") != F.col("base.k")) & (_apart("o_", "s_") >= ACCENT) & (F.col("cjk") > 0))
    accents = accents.select("page", "id", "k", *[F.col(f"o_{c}").alias(c) for c in "rgb"], (F.col("bold") | thick).alias("clear"), "cjk")

    # Accents at a line's start that go on from the line above.
    starts = accents.where("k = 0").select("page", "id", *[F.col(c).alias(f"a_{c}") for c in "rgb"])
    inked = lines.where("x0 is not null").select("page", "id", F.col("x0").alias("x"), "y", "baseline", "size", "has_runs")
    above = previous_line(inked.where("has_runs").drop("has_runs"), inked.drop("has_runs").join(starts.select("page", "id"), ["page", "id"], "left_semi"), "y")
    last = counted.where(F.col("k") == F.col("n_runs") - 1).join(accents.select("page", "id", "k", F.lit(True).alias("accent")), ["page", "id", "k"], "left")
    goes_on = (F.col("n_runs") == 1) | F.coalesce("accent", F.lit(False))
    open_ = ~F.regexp_replace("text", r"(?U)\s+$", "").rlike(f"[{STOPS}]$")
    last = last.where((F.col("cjk") > 0) & goes_on & open_).select("page", F.col("id").alias("prev_id"), F.col("k").alias("prev_k"), *[F.col(c).alias(f"b_{c}") for c in "rgb"])
    links = above.join(starts, ["page", "id"]).join(last, ["page", "prev_id"]).where(_apart("a_", "b_") < GROUP).select("page", "id", F.lit(0).alias("k"), "prev_id", "prev_k")

    # Groups of the others by colour, each around its first.
    short = accents.where(F.col("cjk") <= LONGEST).join(links.select("page", "id", "k"), ["page", "id", "k"], "left_anti")
    pages = short.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "k", "r", "g", "b", "clear"))).alias("rows"))
    gap = lambda a, b: sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "rgb"), F.lit(0))
    none = F.struct(F.expr("filter(rows, r -> false)").alias("firsts"), F.expr("cast(array() as array<int>)").alias("of"))

    def step(acc: Column, r: Column) -> Column:
        at = F.array_position(F.transform(acc["firsts"], lambda f: gap(f, r) < GROUP), True).cast("int")
        joins = lambda p: F.struct(F.when(p > 0, acc["firsts"]).otherwise(F.concat(acc["firsts"], F.array(r))).alias("firsts"), F.concat(acc["of"], F.array(F.when(p > 0, p).otherwise(F.size(acc["firsts"]) + 1))).alias("of"))
        return let(at, joins)

    dealt = pages.withColumn("of", F.aggregate("rows", none, step, lambda acc: acc["of"]))
    dealt = dealt.select("page", F.posexplode("rows").alias("i", "r"), "of").select("page", "r.*", F.get("of", F.col("i")).alias("group"))
    vivid = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    shared = dealt.groupBy("page", "group").agg(F.max("clear").alias("clear"), F.min(F.struct((-vivid).alias("less"), "id", "k", "r", "g", "b")).alias("colour"))
    of_run = dealt.select("page", "id", "k", "group").join(shared, ["page", "group"]).select("page", "id", "k", "clear", *[F.col(f"colour.{c}").alias(f"n_{c}") for c in "rgb"])
    done = runs.join(of_run, ["page", "id", "k"], "left").select("page", "id", "k", *[F.coalesce(f"n_{c}", c).alias(c) for c in "rgb"], (F.col("bold") | F.coalesce("clear", F.lit(False))).alias("bold"))
    from_above = links.join(done.select("page", F.col("id").alias("prev_id"), F.col("k").alias("prev_k"), *[F.col(c).alias(f"l_{c}") for c in ("r", "g", "b", "bold")]), ["page", "prev_id", "prev_k"]).drop("prev_id", "prev_k")
    return done.join(from_above, ["page", "id", "k"], "left").select("page", "id", "k", *[F.coalesce(f"l_{c}", c).alias(c) for c in ("r", "g", "b", "bold")])
