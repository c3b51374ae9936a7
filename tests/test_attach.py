"""What belongs to a line, by cases written by hand."""

from pyspark.sql import functions as F

from folioframe.functions import geom
from folioframe.operators import attach

LINE = "page int, id long, text string, x0 long, y0 long, x1 long, y1 long, size double, badge boolean, r int, g int, b int"
STROKE = "page int, id long, x long, y long, w long, h long, r int, g int, b int, taken boolean, alone boolean"
SPOT = "page int, id long, x long, y long, w long, h long, r int, g int, b int, taken boolean, area long, stem boolean"


def line(i, text, x0=200, x1=300, size=20.0, badge=False):
    return (1, i, text, x0, 100 * i, x1 if x0 is not None else None, 100 * i + 20, size, badge, 0, 0, 0)


def stroke(i, x, w, of, y=10, h=2, taken=False, alone=True, r=0):
    return (1, i, x, 100 * of + y, w, h, r, 0, 0, taken, alone)


def dashed(spark, lines, strokes):
    out = attach.dashes_attached(spark.createDataFrame(lines, LINE), spark.createDataFrame(strokes, STROKE), 1000)
    return {r.id: (r.text, r.x0, r.x1) for r in out.collect()}


def test_dashes(spark):
    lines = [line(1, "目录"), line(2, "一目录"), line(3, "目录"), line(4, "目录！"), line(5, "page"), line(6, "目录", badge=True), line(7, None), line(8, "目录", x0=None), line(9, "目录"), line(10, "目录"), line(11, "目录")]
    strokes = [stroke(1, 150, 40, 1), stroke(2, 175, 20, 2), stroke(3, 170, 20, 3), stroke(4, 305, 20, 3), stroke(5, 305, 40, 4), stroke(6, 170, 20, 5), stroke(7, 170, 20, 6)]
    strokes += [stroke(8, 305, 60, 9), stroke(9, 90, 105, 10), stroke(10, 170, 22, 11, taken=True), stroke(11, 172, 20, 11, r=90)]
    got = dashed(spark, lines, strokes)
    assert got[1] == ("——目录", 150, 300) and got[2] == ("——目录", 175, 300)  # the second dash was read as the sign for one
    assert got[3] == ("目录", 200, 300)  # strokes on both sides are an ornament
    assert got[4][0] == "目录！" and got[5][0] == "page" and got[6][0] == "目录" and got[7][0] is None and got[8] == ("目录", None, None)
    assert got[9] == ("目录———", 200, 365)
    assert got[10][0] == "目录"  # it goes on outside the window
    assert got[11][0] == "目录"  # of another text, or of another colour
    assert dashed(spark, lines[:1], []) == {1: ("目录", 200, 300)} and dashed(spark, [], strokes) == {}


def test_split_dash_and_level(spark):
    got = dashed(spark, [line(1, "目录"), line(2, "目录")], [stroke(1, 180, 12, 1), stroke(2, 160, 14, 1, y=11), stroke(3, 180, 12, 2), stroke(4, 160, 14, 2, y=14)])
    assert got[1] == ("——目录", 160, 300) and got[2] == ("目录", 200, 300)  # alone, the near one is too short


def test_end_marks(spark):
    lines = [line(1, "目录"), line(2, "目录"), line(3, "目录。"), line(4, "他说“好"), line(5, "他说“好"), line(6, "目录", size=12.0), line(7, None), line(8, "目录")]
    spot = lambda i, of, x, y, w, h, area, stem=False: (1, i, x, 100 * of + y, w, h, 0, 0, 0, False, area, stem)
    spots = [spot(1, 1, 303, 14, 3, 5, 12), spot(2, 2, 303, 14, 6, 6, 18), spot(3, 3, 303, 14, 3, 5, 12), spot(4, 4, 303, 2, 2, 4, 7), spot(5, 4, 307, 2, 2, 4, 7), spot(6, 6, 303, 14, 3, 5, 12), spot(7, 8, 303, 10, 2, 7, 14), spot(8, 8, 305, 12, 3, 5, 12, True)]
    spots += [spot(20 + k, 5, 302 + 3 * k, 2, 2, 4, 7) for k in range(3)]
    run = lambda a, b: {r.id: (r.text, r.x1) for r in attach.end_marks_attached(spark.createDataFrame(a, LINE), spark.createDataFrame(b, SPOT), 1000).collect()}
    got = run(lines, spots)
    assert got[1] == ("目录，", 306) and got[2] == ("目录。", 309) and got[3][0] == "目录。" and got[4] == ("他说“好”", 309)
    assert got[5][0] == "他说“好" and got[6][0] == "目录" and got[7][0] is None and got[8][0] == "目录"  # three spots; small type; a rule and a stem
    assert run(lines, []).keys() == got.keys() and run([], spots) == {}


def test_leading_glyphs(spark):
    schema = "id int, text string, x long, w long, h long, manual boolean, ink array<struct<a:int,b:int>>"
    rows = [(1, "品 目录", 10, 100, 20, False, [(0, 8), (10, 18), (30, 100)]), (2, "品 目录", 10, 100, 20, True, [(0, 18), (30, 100)]), (3, "品目 录", 10, 100, 20, False, [(0, 18), (30, 100)]), (4, "品 目录", 10, 100, 20, False, [(0, 18), (22, 100)]), (5, "品 目录", 10, 100, 20, False, None), (6, None, 1, 1, 1, False, []), (7, "品 目录", 10, 100, 20, False, [(0, 18)])]
    got = {r.id: (r.text, r.x, r.w) for r in attach.without_leading_glyph(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == ("目录", 40, 70) and all(got[i][0] == "品 目录" for i in (2, 4, 5, 7)) and got[3][0] == "品目 录" and got[6] == (None, 1, 1)


def test_side_bars(spark):
    schema = "id int, text string, x long, w long, h long, chars array<struct<x0:long,x1:long>>, shapes array<struct<w:int,h:int,area:int>>"
    bar, thin, wide = (5, 20, 98), (1, 20, 20), (18, 18, 200)
    places = [(10, 15), (30, 50), (50, 70)]
    rows = [(1, "▌目录", 10, 60, 22, places, [bar, wide, wide]), (2, "|目录", 10, 60, 22, places, [thin, wide, wide]), (3, "目1录", 10, 60, 22, places, [wide, bar, wide]), (4, "K1录", 10, 60, 22, places, [wide, bar, wide]), (5, "▌目录", 10, 60, 22, places[:2], [bar, wide, wide]), (6, None, 1, 1, 1, None, None), (7, "▌█", 10, 20, 22, places[:2], [bar, bar])]
    got = {r.id: (r.text, r.x, r.w, len(r.chars or [])) for r in attach.without_side_bars(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == ("目录", 30, 40, 2) and got[2][0] == "|目录" and got[3] == ("目录", 10, 60, 2) and got[4][0] == "K1录"
    assert got[5] == ("▌目录", 10, 60, 2) and got[6] == (None, 1, 1, 0) and got[7] == ("", 10, 20, 0)


def test_strips_of_mixed_lines(spark):
    lines = [(1, 1, 0, 0, 40, 80, "A", 0.8), (1, 2, 100, 0, 40, 80, "A的", 0.8), (1, 3, 200, 0, 40, 80, "的", 0.8), (1, 4, 300, 0, 40, 80, "的", 0.95), (1, 5, 400, 0, 40, 80, "ab", 0.8), (1, 6, 500, 0, 40, 80, None, 0.8)]
    strips = [(1, 1, 0, 10, 0, 40, 30, 20, "的", 5.0), (1, 1, 1, 11, 0, 50, 30, 20, "的", 5.0), (1, 2, 0, 20, 100, 0, 30, 20, "是", 5.0), (1, 2, 1, 21, 305, 0, 30, 20, "在", 5.0), (1, 3, 0, 30, 200, 0, 30, 20, "的", 5.0)]
    run = lambda a, b: sorted((r.id, r.seq or 0, r.text) for r in attach.mixed_lines(spark.createDataFrame(a, "page int, id long, x long, y long, w long, h long, text string, score double"), spark.createDataFrame(b, "page int, line long, band int, seq long, x long, y long, w long, h long, text string, score double")).collect())
    assert run(lines[:5], strips) == [(1, 0, "A"), (1, 10, "的"), (2, 20, "是"), (4, 0, "的"), (5, 0, "ab")]
    assert run(lines[4:5], []) == [(5, 0, "ab")] and run([], strips) == []
    assert run(lines[5:], strips) == [(6, 0, None)]


def test_sizes(spark):
    df = spark.createDataFrame([(10, 10, 60, 60), (0, 10, 60, 60), (10, 10, 60, 12), (10, 10, 8, 8)], "x int, y int, w int, h int")
    assert [r[0] for r in df.select(attach.icon_sized(geom.box(), 1000, 500)).collect()] == [True, False, False, False]
    why = attach.scene_fragment(geom.box(), F.lit(50), F.lit("icon"), F.lit("shape"), F.lit(0.0), 400, 400)
    assert [r[0] for r in df.select(why).collect()] == ["background", "background", "strip of a picture", None]
