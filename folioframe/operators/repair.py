"""Repair of recognised text by a word list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geom
from ..functions.text import chars
from .spatial import by_shuffle, touching

#: Characters that recognition takes for one another, first for second. Fixed values.
CONFUSABLE = {
    "目": "自", "自": "目", "己": "已", "已": "己", "未": "末", "末": "未", "土": "士", "士": "土", "入": "人", "人": "入", "曰": "日",
    "戍": "戌", "戌": "戍", "鹰": "膺", "膺": "鹰", "茶": "荼", "汨": "汩", "汩": "汨", "拨": "拔", "拔": "拨", "候": "侯", "侯": "候",
    "微": "徽", "徽": "微", "析": "折", "折": "析", "免": "兔", "兔": "免", "治": "冶", "冶": "治", "大": "太", "太": "大", "干": "千",
    "千": "干", "天": "夭", "夭": "天", "间": "问", "问": "间", "货": "贷", "贷": "货", "裁": "栽", "栽": "裁", "历": "厉", "厉": "历",
    "壁": "璧", "璧": "壁", "墨": "黑", "仓": "仑",
}
#: Characters of a word at most, and a repaired word's frequency at least.
LONGEST, LEAST = 4, 50
#: A shorter list of words repairs nothing.
ENOUGH_WORDS = 1000


def _spans(i: Column, n: Column) -> Column:
    """[(a, b)]: stretches of two to LONGEST characters that hold place i of n."""
    starts = F.sequence(F.greatest(F.lit(0), i - (LONGEST - 1)), i)
    ends = lambda a: F.filter(F.sequence(a + 2, a + LONGEST), lambda b: (b > i) & (b <= n))
    return F.flatten(F.transform(starts, lambda a: F.transform(ends(a), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def confusables_repaired(lines: DataFrame, words: DataFrame, pairs: dict[str, str] = CONFUSABLE, key: str = "id") -> DataFrame:
    """(key, text, fixed): a character that makes no word with its neighbours is taken for the one it is confused with, if
    that one makes a word of frequency `LEAST` or more. From left to right; what was repaired counts for what follows.

    words: word, freq; fewer than ENOUGH_WORDS different ones change nothing. All stretches that could come up, with either form of each such character, are looked up in one join;
    a line then holds the few words it needs.
    """
    if words.select("word").distinct().limit(ENOUGH_WORDS).count() < ENOUGH_WORDS:
        return lines.select(key, "text", F.col("text").alias("fixed"))
    other = F.create_map(*[F.lit(c) for pair in pairs.items() for c in pair])
    spread = lines.select(key, "text", chars(F.col("text")).alias("c")).withColumn("alt", F.transform("c", lambda x: F.element_at(other, x)))
    n = F.size("c")
    grown = lambda acc, i: F.flatten(F.transform(acc, lambda p: F.when(F.get("alt", i).isNull(), F.array(F.concat(p, F.get("c", i)))).otherwise(F.array(F.concat(p, F.get("c", i)), F.concat(p, F.get("alt", i))))))
    forms = lambda s: F.aggregate(F.sequence(s["a"], s["b"] - 1), F.array(F.lit("")), grown)
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("alt", i).isNotNull())
    doubtful = spread.where((n > 1) & F.exists("alt", lambda a: a.isNotNull()))
    looked = doubtful.select(key, F.explode(F.array_distinct(F.flatten(F.transform(places, lambda i: F.flatten(F.transform(_spans(i, n), forms)))))).alias("word"))
    known = looked.join(by_shuffle(words.groupBy("word").agg(F.max("freq").alias("freq"))), "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "freq"))).alias("known"))
    best = lambda s, i: F.coalesce(F.array_max(F.transform(_spans(i, F.length(s)), lambda w: F.coalesce(F.element_at(F.col("known"), F.substr(s, w["a"] + 1, w["b"] - w["a"])), F.lit(0)))), F.lit(0))

    def step(s: Column, i: Column) -> Column:
        changed = F.concat(F.substr(s, F.lit(1), i), F.get("alt", i), F.substr(s, i + 2))
        return F.when(best(s, i) > 0, s).when(best(changed, i) >= LEAST, changed).otherwise(s)

    fixed = doubtful.join(by_shuffle(known), key).select(key, F.aggregate(places, F.col("text"), step).alias("fixed_"))
    return lines.join(by_shuffle(fixed), key, "left").select(key, "text", F.coalesce("fixed_", "text").alias("fixed"))


#: Least IoU of an edit's box and the line that it means.
SAME_LINE = 0.4


def lines_edited(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(page, id, text): lines after a person's edits; a line that an edit deletes is gone.

    lines: page, id, box, text. edits: page, id (their order), box (where the line stood), text; none, or blank, deletes. Each
    edit means the line of largest IoU, the first by id on a tie, among those that no edit before it deleted.
    """
    boxed = edits.where("x is not null").select("page", "id", "x", "y", "w", "h")
    near = touching(boxed, lines.select("page", "id", "x", "y", "w", "h")).withColumn("iou", geom.iou(geom.box("a_"), geom.box("b_"))).where(F.col("iou") >= SAME_LINE)
    found = near.groupBy(F.col("a_page").alias("page"), F.col("a_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("less"), F.col("b_id").alias("line")))).alias("lines"))
    told = found.join(by_shuffle(edits.select("page", "id", F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")), r"(?U)^\s+|\s+$", "").alias("text"))), ["page", "id"])
    rows = told.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "text", F.transform("lines", lambda c: c["line"]).alias("lines")))).alias("rows"))
    empty = F.expr("cast(array() as array<struct<line:bigint,text:string>>)")

    def step(done: Column, e: Column) -> Column:
        deleted = F.transform(F.filter(done, lambda d: d["text"] == ""), lambda d: d["line"])
        line = F.get(F.array_except(e["lines"], deleted), F.lit(0))
        return F.when(line.isNull(), done).otherwise(F.concat(done, F.array(F.struct(line.alias("line"), e["text"].alias("text")))))

    last = rows.select("page", F.posexplode(F.aggregate("rows", empty, step)).alias("at", "d")).groupBy("page", F.col("d.line").alias("id")).agg(F.max_by("d.text", "at").alias("new"))
    out = lines.join(by_shuffle(last), ["page", "id"], "left").where("new is null or new <> ''")
    return out.select("page", "id", F.coalesce("new", "text").alias("text"))


def runs_with_text(runs: Column, text: Column) -> Column:
    """Runs of one style that hold a new text: of the old length it is cut where they were cut, else the longest run's style, the first of such, takes all."""
    size = lambda r: F.length(r["text"])
    total = F.aggregate(runs, F.lit(0), lambda n, r: n + size(r))
    before = lambda i: F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda n, r: n + size(r))
    cut = F.transform(runs, lambda r, i: r.withField("text", F.substr(text, before(i) + 1, size(r))))
    longest = F.array_max(F.transform(runs, size))
    style = F.get(F.filter(runs, lambda r: size(r) == longest), F.lit(0))
    return F.when((F.size(runs) > 1) & (total == F.length(text)), cut).when(F.size(runs) > 0, F.array(style.withField("text", text))).otherwise(runs)
