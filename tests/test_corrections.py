"""Edit scripts, learned fixes, and weights and colours that belong together, on small literal tables and against the standard library."""

import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from folioframe.operators import arrows, edits, layout, marks, styles, votes
from folioframe.streaming import jobs


def edited(rng, text, alphabet):
    out = list(text)
    for _ in range(rng.randint(0, 4)):
        at, what = rng.randrange(len(out) + 1), rng.random()
        if what < 0.4:
            out[at : at + 1] = rng.choice(alphabet)
        elif what < 0.7:
            out[at:at] = rng.choices(alphabet, k=rng.randint(1, 3))
        else:
            del out[at : at + rng.randint(1, 4)]
    return "".join(out)


def test_edit_scripts_equal_the_library(spark):
    rng = random.Random(1)
    alphabet, pairs = "abcd 漢字😀", [("", ""), ("", "a"), ("a", ""), ("aaaa", "aa"), ("aa", "aaaa"), ("abab", "baba")]
    while len(pairs) < 9_970:
        old = "".join(rng.choices(alphabet, k=rng.randint(0, 16)))
        pairs.append((old, edited(rng, old, alphabet) if rng.random() < 0.8 else "".join(rng.choices(alphabet, k=rng.randint(0, 14)))))
    while len(pairs) < 10_000:  # long texts, with a popular character
        old = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", [20] + [1] * 25, k=rng.randint(150, 240)))
        pairs.append((old, edited(rng, edited(rng, old, "xyz"), "xyz")))
    got = edits.edit_scripts(spark.createDataFrame(pairs, "old string, new string").repartition(8)).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert [tuple(o) for o in r.ops] == difflib.SequenceMatcher(None, r.old, r.new).get_opcodes(), (r.old, r.new)
    nulls = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "old string, new string")
    assert [r.ops for r in edits.edit_scripts(nulls).collect()] == [None] * 3


def test_short_fixes(spark):
    cases = {
        ("目我剖析", "自我剖析"): [("目我", "自我")],
        ("一二三", "一X三"): [("一二三", "一X三")],
        ("a", "b"): [],  # nothing around it
        ("abcdef", "abXYZWVUTdef"): [],  # seven new characters
        ("abcdefgh", "abXgh"): [("bcdefg", "bXg")],
        ("abcdefghi", "abXi"): [],  # six old ones
        ("abcd", "abXcd"): [],  # inserted
        ("abcd", "acd"): [],  # deleted
        ("a1b2c3d4e", "aXbYcZdWe"): [],  # four stretches
        ("a1b2c3d", "aXbYcZd"): [("a1b", "aXb"), ("b2c", "bYc"), ("c3d", "cZd")],
    }
    for (old, new), want in cases.items():
        got = edits.short_fixes(spark.createDataFrame([(old, new)], "old string, new string")).collect()
        assert sorted(map(tuple, got)) == sorted(want), (old, new)


def test_edits_meet_lines(spark):
    box = "page long, id long, x double, y double, w double, h double, text string"
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 20.0, "first"), (1, 2, 0.0, 0.0, 100.0, 20.0, "same box"), (1, 3, 0.0, 50.0, 100.0, 20.0, "third"), (2, 1, 0.0, 0.0, 100.0, 20.0, "other page")], box)
    told = [(1, 1, 0.0, 0.0, 100.0, 20.0, " new \t\n"), (1, 2, 10.0, 52.0, 100.0, 20.0, "near"), (1, 3, 60.0, 60.0, 100.0, 20.0, "far"), (1, 4, None, None, None, None, "no box"), (1, 5, 0.0, 50.0, 100.0, 20.0, None), (1, 6, 0.0, 50.0, 100.0, 20.0, ""), (1, 7, 0.0, 50.0, 100.0, 20.0, "third ")]
    got = edits.edited_lines(lines, spark.createDataFrame(told, box)).collect()
    assert sorted((r.id, r.line, r.old, r.new) for r in got) == [(1, 2, "same box", "new"), (2, 3, "third", "near")]


def test_counts_are_added(spark):
    fixes = spark.createDataFrame([("ab", "ac"), ("ab", "ac"), ("x1", "xl")], "wrong string, right string")
    table = spark.createDataFrame([("ab", "ac", 3), ("q", "r", 1)], "wrong string, right string, n int")
    assert sorted(map(tuple, edits.counted(fixes, table).collect())) == [("ab", "ac", 5), ("q", "r", 1), ("x1", "xl", 1)]
    words = spark.createDataFrame([("xl",), ("r",)], "word string")
    trusted = edits.trusted(edits.counted(fixes, table), words)
    assert sorted(r.wrong for r in trusted.collect()) == ["ab", "x1"]  # one character is no word
    lines = spark.createDataFrame([("x1 ab x1", False), (None, False)], "text string, has_chars boolean")
    assert [r.fixed for r in edits.with_fixes(lines, edits.counted(fixes, table), words).collect()] == ["xl ac xl", None]
    assert [r.fixed for r in edits.with_fixes(lines, table.where("false"), words).collect()] == ["x1 ab x1", None]


def test_a_fix_feeds_the_next_and_keeps_places(spark):
    table = spark.createDataFrame([("abc", "xyz", 2), ("yz", "q", 2)], "wrong string, right string, n int")
    lines = spark.createDataFrame([("1abc", False), ("1abc", True)], "text string, has_chars boolean")
    assert [r.fixed for r in edits.with_fixes(lines, table).orderBy("has_chars").collect()] == ["1xq", "1xyz"]


def test_place_fixes(spark):
    df = spark.createDataFrame([("目我剖析", "自我剖析"), ("abc", "axc"), ("ab", "abc"), ("", "a")], "old string, new string")
    assert sorted(map(tuple, edits.place_fixes(df).collect())) == [("abc", "axc"), ("目我", "自我")]


STYLED = "page long, id long, x0 long, y long, baseline long, size double, r int, g int, b int, bold boolean, heavy boolean, family string, stroke double, text string, badge boolean, n_runs int"


def styled(spark, rows):
    """rows: (x0, y, bold, text and other columns by name)."""
    base = {"size": 20.0, "r": 0, "g": 0, "b": 0, "heavy": False, "family": "sans", "stroke": 2.0, "text": "abcd", "badge": False, "n_runs": 1}
    out = [base | {"page": 1, "id": i, "x0": x, "y": y, "baseline": y + 20, "bold": bold} | more for i, (x, y, bold, more) in enumerate(rows)]
    names = [c.split()[0] for c in STYLED.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in out], STYLED)


def weights(df):
    return {r.id: (r.bold, r.heavy) for r in styles.harmonised_bold(df).collect()}


def test_bold_of_most(spark):
    column = [(10, 30 * i, i == 1, {}) for i in range(4)]
    assert weights(styled(spark, column)) == {i: (False, False) for i in range(4)}
    assert weights(styled(spark, [(10, 30 * i, i != 1, {}) for i in range(4)])) == {i: (True, False) for i in range(4)}
    half = [(10, 30 * i, i < 2, {}) for i in range(4)]
    assert weights(styled(spark, half)) == {0: (True, False), 1: (True, False), 2: (False, False), 3: (False, False)}
    # Far away, of another colour or size, a badge, without ink or of several runs: no part of the column.
    for more in ({"r": 200}, {"size": 30.0}, {"badge": True}, {"x0": None}, {"n_runs": 2}, {"x0": 40}):
        got = weights(styled(spark, [(10, 30 * i, i == 3, more if i == 3 else {}) for i in range(4)]))
        assert got[3][0] is True, more
    # Characters count, not lines.
    got = weights(styled(spark, [(10, 0, True, {"text": "a" * 30}), (10, 30, False, {}), (10, 60, False, {})]))
    assert all(b for b, _ in got.values())


def test_two_serif_lines(spark):
    two = lambda **more: styled(spark, [(10, 0, True, {"family": "serif", "heavy": True} | more), (10, 30, False, {"family": "serif"})])
    assert weights(two()) == {0: (False, False), 1: (False, False)}
    for more in ({"stroke": 2.4}, {"family": "sans"}, {"stroke": 0.0}):
        assert weights(two(**more)) == {0: (True, True), 1: (False, False)}, more


LINE = "page long, id long, x0 long, y long, baseline long, size double, badge boolean, has_runs boolean"
RUN = "page long, id long, k int, text string, r int, g int, b int, bold boolean, px double, stroke double"
RED, RED2, BLACK, BLUE = (200, 20, 20), (220, 10, 10), (10, 10, 10), (10, 10, 200)


def accents(spark, lines):
    """lines: lists of (text, colour, bold, stroke); {(line, run): (colour, bold)}."""
    rows = [(1, i, 10, 30 * i, 30 * i + 20, 20.0, False, True) for i in range(len(lines))]
    runs = [(1, i, k, t, *c, b, 20.0, s) for i, line in enumerate(lines) for k, (t, c, b, s) in enumerate(line)]
    got = styles.harmonised_accents(spark.createDataFrame(rows, LINE), spark.createDataFrame(runs, RUN)).collect()
    return {(r.id, r.k): ((r.r, r.g, r.b), r.bold) for r in got}


def test_accents_share_weight_and_colour(spark):
    got = accents(spark, [[("正文很长很长", BLACK, False, 2.0), ("一等奖", RED, True, 2.0)], [("正文很长很长", BLACK, False, 2.0), ("参赛", RED2, False, 2.0)], [("正文很长很长", BLACK, False, 2.0), ("蓝", BLUE, False, 2.0)]])
    assert got[0, 1] == (RED2, True) and got[1, 1] == (RED2, True)
    assert got[2, 1] == (BLUE, False) and got[0, 0] == (BLACK, False)


def test_a_thick_stroke_makes_bold(spark):
    text = ("正文很长很长", BLACK, False, 2.0)
    assert accents(spark, [[text, ("一等奖", RED, False, 2.5)]])[0, 1] == (RED, True)
    assert accents(spark, [[text, ("一等奖", RED, False, 2.3)]])[0, 1] == (RED, False)
    assert accents(spark, [[(*text[:3], None), ("一等奖", RED, False, 2.5)]])[0, 1] == (RED, False)


def test_an_accent_goes_on_from_the_line_above(spark):
    text = ("正文很长很长" * 3, BLACK, False, 2.0)
    long = ("重点词重点词重点词重点词重点词", RED, True, 2.0)  # too long for a group of its own
    got = accents(spark, [[text, long], [("接着", RED2, False, 2.0), text]])
    assert got[1, 0] == (RED, True)
    stopped = accents(spark, [[text, (long[0] + "。", RED, True, 2.0)], [("接着", RED2, False, 2.0), text]])
    assert stopped[1, 0] == (RED2, False)


def test_empty_tables(spark):
    lines, runs = spark.createDataFrame([], LINE), spark.createDataFrame([], RUN)
    assert styles.harmonised_accents(lines, runs).count() == 0
    assert styles.harmonised_bold(spark.createDataFrame([], STYLED)).count() == 0
    none = spark.createDataFrame([], "old string, new string")
    assert edits.edit_scripts(none).count() == 0 and edits.short_fixes(none).count() == 0
    assert edits.counted(edits.short_fixes(none)).agg(F.count("*")).first()[0] == 0


ARROW_LINE = "page long, id long, text string, x long, y long, w long, h long, chars array<struct<x0:long,x1:long>>"


def without_arrows(spark, lines, regions):
    lines = spark.createDataFrame([(1, i, *r) for i, r in enumerate(lines)], ARROW_LINE)
    regions = spark.createDataFrame([(1, i, *r) for i, r in enumerate(regions)], "page long, id long, x long, y long, w long, h long")
    kept = {r.id: (r.text, r.x, r.w, r.chars and [tuple(c) for c in r.chars]) for r in arrows.lines_without_arrows(lines, regions).collect()}
    changes = sorted((r.region, r.id, r.removed, r.kept) for r in arrows.arrow_text_changes(lines, regions).collect())
    clear = arrows.clear_regions(regions, arrows.glyph_meetings(lines, regions)).select("id").collect()
    return kept, changes, sorted(r.id for r in clear)


THREE, DRAWN = [(20, 45), (45, 70), (75, 101)], (75, 24, 26, 50)


def test_arrows_leave_the_text(spark):
    trimmed = {0: ("库存", 20, 55, THREE[:2])}
    assert without_arrows(spark, [("库存↑", 20, 24, 81, 50, THREE)], [DRAWN]) == (trimmed, [(0, 0, "↑", "库存")], [0])
    assert without_arrows(spark, [("库存一", 20, 24, 81, 50, THREE)], [DRAWN])[0] == trimmed  # a dash under the arrow
    assert without_arrows(spark, [("库存个", 20, 24, 81, 50, THREE)], [DRAWN])[0] == trimmed
    assert without_arrows(spark, [("↑", 75, 24, 26, 50, [(75, 101)])], [DRAWN]) == ({}, [], [0])


def test_arrows_inside_or_beside_text_stay(spark):
    inline = ("75%→80%", 20, 42, 115, 32, [(20, 32), (32, 44), (44, 56), (56, 82), (82, 94), (94, 106), (106, 118)])
    assert without_arrows(spark, [inline], [(56, 43, 26, 30)]) == ({0: ("75%→80%", 20, 115, inline[5])}, [], [])
    below = ("75%→80%", 20, 20, 115, 28, inline[5])
    assert without_arrows(spark, [below], [(75, 82, 60, 30)])[2] == [0]
    # An ordinary end glyph under the region: neither goes.
    assert without_arrows(spark, [("库存量", 20, 24, 81, 50, THREE)], [DRAWN]) == ({0: ("库存量", 20, 81, THREE)}, [], [])
    # A region that is part of one line's text takes nothing from another.
    two = [("库存↑", 20, 24, 81, 50, THREE), ("存货量", 20, 24, 81, 50, THREE)]
    assert without_arrows(spark, two, [DRAWN])[0][0][0] == "库存↑"


def test_arrows_on_both_ends_and_without_places(spark):
    both = ("←库↑", 0, 0, 90, 30, None)
    assert without_arrows(spark, [both], [(0, 0, 30, 30), (60, 0, 30, 30)]) == ({0: ("库", 30, 30, None)}, [(0, 0, "←↑", "库"), (1, 0, "←↑", "库")], [0, 1])
    assert without_arrows(spark, [("←↑", 0, 0, 60, 30, None)], [(0, 0, 30, 30), (30, 0, 30, 30)])[0] == {}
    assert without_arrows(spark, [("", 0, 0, 60, 30, None), (None, 0, 0, 60, 30, None)], [(0, 0, 30, 30)])[0] == {0: ("", 0, 60, None), 1: (None, 0, 60, None)}


def test_idle_jobs_as_a_stream(spark, tmp_path):
    """Over ten batches the stream tells the same idle jobs as the batch query does over all events."""
    rng = random.Random(3)
    schema = "job string, t double, seq long, state string"
    events = [(f"job{rng.randrange(60)}", 10.0 * k + rng.random(), k, rng.choice(["queued", "running", "done", "error"])) for k in range(300)]
    now = 3600.5
    folder = tmp_path / "events"
    for n in range(10):
        part = events[30 * n : 30 * n + 30] + ([("clock", now, 999, "running")] if n == 9 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(folder))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)).withColumn("at", F.timestamp_seconds("t"))
    query = jobs.idle_jobs(rows, 500.0).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    told = spark.sql("select * from idle").collect()
    assert len(query.recentProgress) >= 10
    last = {}
    for job, t, seq, state in events:
        last[job] = (state, t)
    got = {r.job: (r.state, r.touched) for r in told if last[r.job][1] == r.touched}
    want = {r.job: (r.state, r.touched) for r in votes.idle(spark.createDataFrame(events, schema), now, 500.0).collect()}
    assert got == want and want
    at = {(job, t): state for job, t, _, state in events}
    assert all(at[r.job, r.touched] == r.state not in ("queued", "running") for r in told)  # those that came back later were idle then


def icons(spark, rows):
    """rows: (box, and other columns by name); {id: (score, why)} of contained_icons()."""
    base = {"score": 60, "pale": False, "light": False, "fill": 10, "rest": 100, "r": 0, "g": 0, "b": 0, "rest_r": 0, "rest_g": 0, "rest_b": 0}
    kind = "page long, id long, x long, y long, w long, h long, score long, pale boolean, light boolean, fill long, rest long, r int, g int, b int, rest_r int, rest_g int, rest_b int"
    out = [dict(zip(("x", "y", "w", "h"), box)) | base | more | {"page": 1, "id": i} for i, (box, more) in enumerate(rows)]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in out], kind)
    return {r.id: (r.score, r.why, r.kept) for r in layout.contained_icons(df).collect()}


OUTER, INNER = (0, 0, 100, 100), (20, 20, 40, 40)


def test_icons_in_icons(spark):
    fine, gone = (60, None, True), lambda why: (40, why, False)
    assert icons(spark, [(OUTER, {}), (INNER, {})]) == {0: fine, 1: gone(layout.PART)}
    assert icons(spark, [(OUTER, {"rest": 5}), (INNER, {"r": 200})]) == {0: fine, 1: gone(layout.PART)}
    assert icons(spark, [(OUTER, {}), (INNER, {"r": 200})]) == {0: gone(layout.CONTAINER), 1: fine}
    assert icons(spark, [(OUTER, {}), (INNER, {"r": 200, "fill": 1600})]) == {0: fine, 1: gone(layout.HOLE)}
    assert icons(spark, [(OUTER, {}), (INNER, {"light": True})]) == {0: gone(layout.BAND), 1: fine}
    assert icons(spark, [(OUTER, {}), (INNER, {"pale": True})]) == {0: fine, 1: fine}
    assert icons(spark, [(OUTER, {"score": 50}), (INNER, {})]) == {0: (50, None, False), 1: fine}
    # One of two has its colour: neither part nor container.
    assert icons(spark, [(OUTER, {}), (INNER, {"r": 200}), ((60, 60, 30, 30), {})]) == {0: fine, 1: fine, 2: fine}
    nested = icons(spark, [(OUTER, {"rest": 5}), ((10, 10, 60, 60), {"rest_r": 200}), ((20, 20, 30, 30), {"r": 0, "fill": 900})])
    assert nested == {0: fine, 1: gone(layout.PART), 2: gone(layout.HOLE)}


def split(spark, text, gaps, h=20, apart=None):
    spans = [(20 * i, 20 * i + 18) for i in range(len(text))]
    kind = "page long, id long, x long, w long, h long, text string, chars array<struct<x0:long,x1:long>>, gaps array<double>, apart array<double>"
    row = (1, 1, 0, 20 * len(text), h, text, spans, [float(g) for g in gaps], [float(a) for a in apart or [0] * len(gaps)])
    return [(r.text, r.x, r.w) for r in layout.split_at_gaps(spark.createDataFrame([row], kind)).orderBy("part").collect()]


def test_lines_are_cut_at_wide_gaps(spark):
    assert split(spark, "一二三四五", [1, 30, 1, 1]) == [("一二", 0, 38), ("三四五", 40, 58)]
    assert split(spark, "一二三四五", [1, 10, 1, 1]) == [("一二 三四五", 0, 98)]
    assert split(spark, "abcde", [1, 10, 1, 1]) == [("abcde", 0, 100)]  # no space between ASCII characters
    assert split(spark, "一二，四五", [1, 1, 30, 1]) == [("一二，四五", 0, 100)]  # a comma is open anyway
    assert split(spark, "一二三四五", [9, 9, 30, 9]) == [("一二三四五", 0, 100)]  # spaced out as a whole
    assert split(spark, "05经百战", [1, 20, 1, 1], 60, [0, 120, 0, 0]) == [("05", 0, 38), ("经百战", 40, 58)]
    assert split(spark, "一", []) == [("一", 0, 20)]


def test_axes_form_an_l(spark):
    column = [("高", 50, 100), ("中", 50, 180), ("低", 50, 260)]
    row = [("低", 120, 320), ("中", 220, 320), ("高", 320, 320)]
    found = lambda rows: [tuple(r) for r in layout.axis_corners(spark.createDataFrame([(1, i, x, y, 20, 20, t) for i, (t, x, y) in enumerate(rows)], "page long, id long, x long, y long, w long, h long, text string")).collect()]
    assert found(column + row) == [(1, 0, 3, 50, 100, 290, 240)]
    assert found(column[::-1] + row) == [(1, 2, 3, 50, 100, 290, 240)]
    assert found([(t, x, 360 - y) for t, x, y in column] + row) == []  # low to high downwards
    assert found(column + [(t, x, y + 200) for t, x, y in row]) == []  # too far below
    assert found(column + [("低", 120, 320), ("中", 220, 320), ("高", 420, 320)]) == []  # uneven


def panels(spark, width, height, boxes, noise=()):
    inside = lambda r, c: any(x <= c < x + w and y <= r < y + h for x, y, w, h in boxes)
    cells = [(1, r, c, not inside(r, c) or (r, c) in noise) for r in range(height) for c in range(width)]
    df = spark.createDataFrame(cells, "page long, r int, c int, pure boolean")
    return [tuple(r)[2:] for r in layout.sheet_panels(df).orderBy("panel").collect()]


def test_contact_sheets_in_two_dimensions(spark):
    grid = [(2 + 18 * i, 2 + 14 * j, 16, 10) for j in range(2) for i in range(3)]
    assert panels(spark, 57, 28, grid) == grid
    uneven = [*grid[:3], (2, 16, 25, 12), (29, 16, 25, 12)]  # three above two, of other shapes
    assert panels(spark, 57, 31, uneven) == []
    assert panels(spark, 57, 28, grid[:3]) == []  # one band
    assert panels(spark, 90, 70, grid) == []  # they cover too little
    assert panels(spark, 57, 28, []) == []


def test_surfaces(spark):
    rng = np.random.default_rng(5)
    u, v = rng.uniform(-1, 1, (2, 60))
    cases = {
        "quadratic": (u, v, 3 + 2 * u - v + 0.5 * u * u - 4 * u * v + v * v),
        "noisy": (u, v, rng.normal(size=60)),
        "five points": (u[:5], v[:5], 1 + 2 * u[:5] - 3 * v[:5]),
        "on a grid of two": (np.array([0.0, 0, 1, 1, 0, 1]), np.array([0.0, 1, 0, 1, 0, 1]), np.array([1.0, 2, 3, 4, 1, 4])),
        "on a line": (u[:20], 2 * u[:20], u[:20]),
    }
    rows = [(name, float(a), float(b), float(c)) for name, xyz in cases.items() for a, b, c in zip(*xyz)]
    got = {r.key: r.c for r in marks.fitted_surfaces(spark.createDataFrame(rows, "key string, u double, v double, z double"), "key").collect()}
    for name in ("quadratic", "noisy"):
        x, y, z = cases[name]
        want = np.linalg.lstsq(np.stack([np.ones_like(x), x, y, x * x, x * y, y * y], axis=1), z, rcond=None)[0]
        assert np.allclose(got[name], want, atol=1e-9), name
    assert np.allclose(got["five points"], [1, 2, -3, 0, 0, 0], atol=1e-9)
    assert np.allclose(got["on a grid of two"], [1, 2, 1, 0, 0, 0], atol=1e-9)
    assert got["on a line"] is None


def test_peers_of_all_lines(spark):
    lines = [(1, i, 20.0, 0, 0, 0, "sans", "正文正文") for i in range(4)] + [(1, 4, 20.0, 0, 0, 0, "serif", "正文"), (1, 5, 20.0, 0, 0, 0, "serif", "ascii"), (1, 6, 0.0, 0, 0, 0, "serif", "字"), (1, 7, 40.0, 0, 0, 0, "serif", "大字"), (1, 8, 20.0, 0, 0, 0, None, "字")]
    got = marks.family_of_peers(spark.createDataFrame(lines, "page long, id long, size double, r int, g int, b int, family string, text string")).collect()
    assert {r.id: r.family for r in got} == {**{i: "sans" for i in range(5)}, 5: "serif", 6: "serif", 7: "serif", 8: None}
