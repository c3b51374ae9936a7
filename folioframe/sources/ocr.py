"""Recognition results as tables: quads to lines, tiles, character spans, and the table form of a fallback engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import char_weight, chars

#: Lines under this score are dropped; the fallback engine's words under this confidence are.
LEAST_SCORE, LEAST_CONF = 0.7, 50

ITEMS = "page_id long, seq long, quad array<array<double>>, text string, score double, char_quads array<array<array<double>>>, chars array<string>"
TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def lines(items: DataFrame, dx: Column | int = 0, dy: Column | int = 0) -> DataFrame:
    """(page_id, seq, text, x, y, w, h, score, spans): bounding boxes of quads, moved by the tile's offset.

    Character spans are given only where the characters make up the text. Numbers are rounded half to even.
    """
    dx, dy = (F.lit(v) if isinstance(v, int) else v for v in (dx, dy))
    low = lambda q, i: F.array_min(F.transform(q, lambda p: F.get(p, F.lit(i))))
    high = lambda q, i: F.array_max(F.transform(q, lambda p: F.get(p, F.lit(i))))
    whole = lambda c: F.bround(c).cast("int")
    text = F.trim("text")
    spans = F.transform("char_quads", lambda q: F.struct(whole(low(q, 0) + dx).alias("x0"), whole(high(q, 0) + dx).alias("x1")))
    fit = (F.array_join("chars", "") == text) & F.forall("chars", lambda c: F.length(c) == 1) & (F.size("char_quads") > 0)
    q = F.col("quad")
    kept = items.where((F.col("score") >= LEAST_SCORE) & (text != ""))
    return kept.select("page_id", "seq", text.alias("text"), whole(low(q, 0) + dx).alias("x"), whole(low(q, 1) + dy).alias("y"), whole(high(q, 0) - low(q, 0)).alias("w"), whole(high(q, 1) - low(q, 1)).alias("h"), "score", F.when(fit, spans).alias("spans"))


def starts(length: Column, tile: Column, step: Column) -> Column:
    """Where tiles begin along one side: every step, and one that ends with the side."""
    last = length - tile
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), last, step), F.array(last))))


def tiles(pages: DataFrame, width: int, height: int, overlap: float) -> DataFrame:
    """The pages' key columns and x, y, w, h of each tile; pages have width and height."""
    w, h = F.least("width", F.lit(width)), F.least("height", F.lit(height))
    step = lambda side: F.greatest(F.lit(1), F.floor(side * (1 - overlap)).cast("int"))
    keys = [c for c in pages.columns if c not in ("width", "height")]
    sized = pages.select(*keys, w.alias("w"), h.alias("h"), starts(F.col("width"), w, step(w)).alias("xs"), starts(F.col("height"), h, step(h)).alias("ys"))
    return sized.select(*keys, F.explode("xs").alias("x"), "ys", "w", "h").select(*keys, "x", F.explode("ys").alias("y"), "w", "h")


def complete_in_tile(margin: int = 12) -> Column:
    """A line stays clear of its tile's edges, save where they are the page's: columns x, y, w, h, tile_*, width, height."""
    c = F.col
    left = (c("tile_x") == 0) | (c("x") >= c("tile_x") + margin)
    top = (c("tile_y") == 0) | (c("y") >= c("tile_y") + margin)
    right = (c("tile_x") + c("tile_w") == c("width")) | (c("x") + c("w") <= c("tile_x") + c("tile_w") - margin)
    low = (c("tile_y") + c("tile_h") == c("height")) | (c("y") + c("h") <= c("tile_y") + c("tile_h") - margin)
    page = (c("x") >= 0) & (c("y") >= 0) & (c("x") + c("w") <= c("width")) & (c("y") + c("h") <= c("height"))
    return left & top & right & low & page


def character_spans(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, i, stop): where each character ends if a line's width is shared out by character widths, half to even."""
    each = df.select(key, F.posexplode(F.transform(chars(F.col(text)), lambda c: F.bround(char_weight(c) * 100).cast("long"))).alias("i", "wt"))
    upto = F.sum("wt").over(Window.partitionBy(key).orderBy("i"))
    whole = F.sum("wt").over(Window.partitionBy(key))
    return each.select(key, "i", F.bround(F.lit(width) * (upto / whole)).cast("long").alias("stop"))


def strips(recovered: DataFrame) -> DataFrame:
    """(page_id, text, bands, seq): one row per text found in overlapping strips, with its bands and its best line."""
    return recovered.groupBy("page_id", "text").agg(F.sort_array(F.collect_set("band")).alias("bands"), F.max_by("seq", F.struct("score", -F.col("seq"))).alias("seq"))


def fallback_words(spark: SparkSession, path: str) -> DataFrame:
    """The fallback engine's words: tab-separated, never quoted, of enough confidence."""
    words = spark.read.schema(TSV).option("sep", "\t").option("quote", "").option("header", True).csv(path).withColumn("file", F.input_file_name())
    return words.where((F.col("conf") >= LEAST_CONF) & (F.trim("text") != ""))


def fallback_lines(words: DataFrame) -> DataFrame:
    """Words of a line of one file's page, less outliers of 1.8 times the line's median height, cut at gaps of 1.5 times the tallest so far."""
    key = ["file", "page_num", "block_num", "par_num", "line_num"]
    tall = words.withColumn("median", F.median("height").over(Window.partitionBy(*key))).where(F.col("height") < 1.8 * F.col("median"))
    rows = tall.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("left", "top", "width", "height", "text"))).alias("words"))
    empty = F.expr("filter(array(words), x -> false)")

    def step(acc: Column, w: Column) -> Column:
        seg = F.element_at(acc, -1)
        last = F.element_at(seg, -1)
        far = w["left"] - (last["left"] + last["width"]) > 1.5 * F.array_max(F.transform(seg, lambda x: x["height"]))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(seg, F.array(w))))
        return F.when((F.size(acc) == 0) | far, F.concat(acc, F.array(F.array(w)))).otherwise(grown)

    from ..functions.text import joins_with_space

    segs = rows.select(*key, F.posexplode(F.aggregate("words", empty, step)).alias("segment", "seg"))
    joined = F.aggregate("seg", F.lit(""), lambda acc, w: F.concat(acc, F.when((acc != "") & joins_with_space(acc, w["text"]), " ").otherwise(""), w["text"]))
    return segs.select(*key, "segment", joined.alias("text"), F.array_min(F.transform("seg", lambda w: w["left"])).alias("x"), F.array_min(F.transform("seg", lambda w: w["top"])).alias("y"))
