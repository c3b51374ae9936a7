"""Page operators on small literal pages with known answers."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.operators import folds, kernels, learning, repair, sequences, spatial
from folioframe.operators.consistency import inconsistent
from folioframe.sources import files, ocr

BOX = "page long, id long, x long, y long, w long, h long"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], BOX)


def test_tick_values(spark):
    cases = {"18,000": 18000.0, "25%": 25.0, "0": 0.0, "2025年": None, "+25.6%x": None, "−1,000": -1000.0}
    df = spark.createDataFrame([(t,) for t in cases], "text string").withColumn("v", tx.tick_value(F.col("text")))
    assert {r.text: r.v for r in df.collect()} == cases


def test_tick_chains(spark):
    zero = [(1, i, v, 400 - 0.05 * v) for i, v in enumerate(range(-3000, 2001, 1000))]
    years = [(2, i, 2021.0 + i, 100.0 + 150 * i) for i in range(5)]
    same = [(3, i, 5.0, 10.0 * i) for i in range(5)]
    df = spark.createDataFrame([(g, i, float(v), float(p)) for g, i, v, p in zero + years + same], "grp int, seq int, v double, p double")
    rows = sequences.tick_chains(df).collect()
    assert [(r.grp, r.n, round(r.k, 6), round(r.zero, 6)) for r in rows] == [(1, 6, -0.05, 400.0)]


LABELS = [(40 + 180 * i, 300, 150, 48) for i in range(5)]


def page_texts(spark, rows):
    return spark.createDataFrame([(1, i, *r, "title") for i, r in enumerate(rows)], f"{BOX}, text string")


def test_row_with_some_texts_missing(spark):
    texts = page_texts(spark, [(60 + 180 * i, 312, 100, 24) for i in (0, 1, 3)])
    assert {r.x for r in inconsistent(texts, boxes(spark, LABELS), 1500.0).collect()} == {400, 760}


@pytest.mark.parametrize("have, lone", [((0, 1, 2, 4), {580}), ((0, 1, 2, 3, 4), set()), ((2,), set())])
def test_row_with_an_icon_missing(spark, have, lone):
    texts = page_texts(spark, [(60 + 180 * i, 312, 100, 24) for i in range(5)])
    icons = boxes(spark, LABELS + [(80 + 180 * i, 230, 50, 50) for i in have])
    assert {r.x for r in inconsistent(texts, icons, 1500.0).collect()} == lone


def test_icon_far_left_of_a_tall_label(spark):
    """A tall label's icon may stand two and a half of its heights away, whatever the page's width."""
    labels = [(600, 100 + 260 * i, 500, 160) for i in range(4)]
    icons = boxes(spark, labels + [(180, 150 + 260 * i, 40, 40) for i in (0, 1, 3)])
    got = inconsistent(page_texts(spark, [(620, 120 + 260 * i, 60, 20) for i in range(4)]), icons, 1500.0).collect()
    assert {(r.y, r.reason) for r in got if r.w == 500} == {(620, "icon")}


def test_paragraphs(spark):
    rows = [(1, 1, 20, 110, 220, 130, 24.0, False, False, 0, 0, 0), (1, 2, 20, 160, 220, 180, 24.0, False, False, 0, 0, 0), (1, 3, 20, 400, 220, 420, 24.0, False, False, 0, 0, 0)]
    df = spark.createDataFrame(rows, "page long, id long, x long, y long, right long, baseline long, size double, bold boolean, badge boolean, r int, g int, b int")
    assert {r.id: r.block for r in folds.paragraphs(df).collect()} == {1: 0, 2: 0, 3: 1}


def test_tile_offsets(spark):
    quad = [[300.0, 200.0], [380.0, 200.0], [380.0, 230.0], [300.0, 230.0]]
    half = lambda a, b: [[a, 200.0], [b, 200.0], [b, 230.0], [a, 230.0]]
    items = [(1, 1, quad, " 数据 ", 0.9, [half(300.0, 340.0), half(340.0, 380.0)], ["数", "据"]), (1, 2, quad, "low", 0.5, None, None), (1, 3, quad, " ", 0.9, None, None), (1, 4, quad, "ab", 0.9, [half(0.0, 1.0)], ["a"])]
    got = {r.seq: r for r in ocr.lines(spark.createDataFrame(items, ocr.ITEMS), 700, 0).collect()}
    assert sorted(got) == [1, 4] and got[4].spans is None
    assert (got[1].x, got[1].y, got[1].w, got[1].h) == (1000, 200, 80, 30) and [tuple(s) for s in got[1].spans] == [(1000, 1040), (1040, 1080)]
    grid = ocr.tiles(spark.createDataFrame([(1, 1700, 1000)], "page int, width int, height int"), 1000, 700, 0.3).collect()
    assert {(r.x, r.y) for r in grid} == {(0, 0), (700, 0), (0, 300), (700, 300)} | {(0, 489), (700, 489)} - {(0, 489), (700, 489)}


def test_overlapping_tiles_give_one_line(spark):
    df = boxes(spark, [(850, 200, 70, 28), (850, 200, 70, 28), (100, 200, 70, 28)])
    assert {r.id for r in folds.greedy_dedupe(df).collect()} == {0, 2}


def test_edge_fragment(spark):
    rows = [(1, 702, 10, 50, 20, 700, 0, 1000, 700), (2, 720, 10, 50, 20, 700, 0, 1000, 700), (3, 2, 10, 50, 20, 0, 0, 1000, 700)]
    df = spark.createDataFrame(rows, "id int, x int, y int, w int, h int, tile_x int, tile_y int, tile_w int, tile_h int").withColumns({"width": F.lit(1700), "height": F.lit(1000)})
    assert {r.id for r in df.where(ocr.complete_in_tile()).collect()} == {2, 3}


def test_strips(spark):
    df = spark.createDataFrame([(1, "P", 0, 1, 0.9), (1, "P", 1, 2, 0.95), (1, "计划", 1, 3, 0.9), (1, "计划", 2, 4, 0.9)], "page_id int, text string, band int, seq int, score double")
    assert {r.text: (r.bands, r.seq) for r in ocr.strips(df).collect()} == {"P": ([0, 1], 2), "计划": ([1, 2], 3)}


def test_fallback_engine(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    words = [(1, 1, 0, 10, 40, 20, 90, 'Say"'), (1, 1, 0, 55, 40, 20, 91, "hi"), (1, 1, 0, 300, 40, 20, 95, "far"), (1, 1, 0, 400, 40, 90, 95, "tall"), (1, 1, 0, 500, 40, 20, 30, "unsure")]
    (tmp_path / "w.tsv").write_text(head + "".join(f"5\t1\t{b}\t{p}\t{n}\t1\t{left}\t5\t{w}\t{h}\t{c}\t{t}\n" for b, p, n, left, w, h, c, t in words))
    got = ocr.fallback_lines(ocr.fallback_words(spark, str(tmp_path / "w.tsv"))).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.segment)] == ['Say" hi', "far"]
    (tmp_path / "w.tsv").write_text(head + "".join(f"5\t{page}\t1\t1\t0\t1\t{left}\t5\t40\t20\t90\t{t}\n" for page, left, t in ((1, 10, "one"), (1, 55, "page"), (2, 20, "other"))))
    got = ocr.fallback_lines(ocr.fallback_words(spark, str(tmp_path / "w.tsv"))).collect()
    assert {(r.page_num, r.text) for r in got} == {(1, "one page"), (2, "other")}


def test_logs_and_words(spark, tmp_path):
    missing = files.log(spark, str(tmp_path / "none.jsonl"), files.HISTORY)
    assert missing.count() == 0
    (tmp_path / "w.txt").write_text("数据 50\nbad\nword 7 n\nx y\n")
    assert {r.word: r.freq for r in files.words(spark, str(tmp_path / "w.txt")).collect()} == {"数据": 50, "word": 7}
    rows = spark.createDataFrame([(1.0, "k", "text", 5, 1)], files.HISTORY)
    for _ in range(2):
        files.append(rows, str(tmp_path / "h"))
    (tmp_path / "h" / "more.json").write_text("\n{broken\n")
    assert files.log(spark, str(tmp_path / "h"), files.HISTORY).count() == 2
    old, new = (spark.createDataFrame(r, "key string, v int") for r in ([("a", 1), ("b", 2)], [("b", 3)]))
    assert {(r.key, r.v) for r in files.upsert(spark, old, new, "key").collect()} == {("a", 1), ("b", 3)}


def test_upload_rules(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"x")
    (tmp_path / "b.exe").write_bytes(b"x")
    good, bad = files.inputs(spark, str(tmp_path))
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["suffix"]


def test_streams(spark, tmp_path):
    from folioframe.streaming import feedback

    rows = spark.createDataFrame([([1.0], 1, "icon", None, 1.0, "edit", 10.0, "a"), ([1.0], 1, "icon", None, 1.0, "edit", 11.0, "a"), ([1.0], 0, "icon", None, 1.0, "edit", 12.0, "b")], files.SAMPLES)
    files.append(rows, str(tmp_path / "s"))
    seen = []
    run = lambda: feedback.retrain(feedback.once_per_key(feedback.stream(spark, str(tmp_path / "s"))), lambda batch, n: seen.extend(r.key for r in batch.collect()), str(tmp_path / "c")).awaitTermination()
    run()
    assert sorted(seen) == ["a", "b"]
    late = spark.createDataFrame([([1.0], 1, "icon", None, 1.0, "edit", 10.0**9, "a"), ([1.0], 1, "icon", None, 1.0, "edit", 1.0, "c")], files.SAMPLES)
    files.append(late, str(tmp_path / "s"))
    run()  # a key seen long ago is known still
    assert sorted(seen) == ["a", "b", "c"]


def test_numbering(spark):
    def fixed(rows):
        df = spark.createDataFrame([(1, i, x, y, h, t) for i, (x, y, h, t) in enumerate(rows)], "page long, id long, x long, y long, h long, text string")
        return [r.fixed for r in sequences.repaired_numbers(df).orderBy("id").collect()]

    column = lambda x, texts: [(x, 30 * i, 20, t) for i, t in enumerate(texts)]
    assert fixed(column(0, ["01", "O2", "03", "1O", "05"])) == ["01", "02", "03", "04", "05"]
    # Ten other texts of the page, and a second column that counts from 7, change nothing.
    both = column(0, ["01", "02", "O9"]) + [(5, 10 + 30 * i, 20, f"text {i}") for i in range(10)] + column(100, ["07", "O8", "90", "10"])
    assert [t for t in fixed(both) if len(t) == 2] == ["01", "02", "03", "07", "08", "09", "10"]
    assert fixed(column(0, ["01", "09", "05", "20"])) == ["01", "09", "05", "20"]  # no start has 60 %
    assert fixed([*column(0, ["01", "02"]), (0, 60, 40, "O9")]) == ["01", "02", "O9"]  # another size
    assert fixed(column(0, ["98", "99", "0O"])) == ["98", "99", "0O"]  # not beyond 99
    # A label that one column has set counts with its new text in the next one.
    assert fixed([(0, 0, 20, "01"), (10, 30, 20, "02"), (16, 60, 20, "O9"), (30, 90, 20, "04"), (32, 120, 20, "05")]) == ["01", "02", "03", "04", "05"]


def test_fit_matches_gradient_and_expression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 16))
    y = (x[:, 0] > 0).astype(float)
    m = learning.fit_logistic(x, y, np.ones(60))
    z = np.column_stack([(x - m["mu"]) / m["sd"], np.ones(60)])
    want = 1 / (1 + np.exp(-(z @ m["beta"])))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, f array<double>")
    got = [r.p for r in df.select("i", learning.probability(m, F.col("f")).alias("p")).orderBy("i").collect()]
    assert np.allclose(got, want) and ((want > 0.5) == (y > 0.5)).mean() > 0.95


def image(page_id, array):
    h, w, c = array.shape
    return (page_id, h, w, c, array.astype(np.uint8).tobytes())


def test_kernels(spark):
    page = np.full((90, 160, 3), (245, 248, 250))
    page[10:20, 10:40] = (20, 40, 200)
    page[50:60, 100:110] = page[60:70, 110:120] = (0, 0, 0)
    other = page.copy()
    other[33, 33] = 0
    schema = "page_id long, height int, width int, channels int, data binary"
    one, two = (spark.createDataFrame([image(1, a)], schema) for a in (page, other))
    got = kernels.components(one).collect()
    assert {(r.x, r.y, r.w, r.h, r.area) for r in got} == {(10, 10, 30, 10, 300), (100, 50, 20, 20, 200)}
    assert sum(r.n for r in kernels.color_codes(one).collect()) == 90 * 160
    assert [(r.bx, r.by) for r in kernels.difference(one, two).collect()] == [(2, 2)]
    assert len(kernels.page_keys(one).first().key) == 16


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31))
def test_component_labels(seed):
    mask = np.random.default_rng(seed).random((12, 14)) < 0.45
    label, n = kernels.labelled(mask)
    assert ((label > 0) == mask).all()
    seen, want = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            want += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 12 and 0 <= b < 14 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = want
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert n == want and len({(p, r) for p, r in zip(label[mask].tolist(), seen[mask].tolist())}) == n


def test_grid_finds_every_pair(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(*(rng.integers(lo, hi, 80) for lo, hi in ((-300, 900), (-300, 900), (1, 400), (1, 400))))]
    df = boxes(spark, rows)
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if max(a[0], b[0]) < min(a[0] + a[2], b[0] + b[2]) and max(a[1], b[1]) < min(a[1] + a[3], b[1] + b[3])}
    got = [(r.a_id, r.b_id) for r in spatial.touching(df, df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fit_against_another_solver():
    """Enough steps lead to the optimum that Newton's method finds."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=200) > 0.3).astype(float)
    w = rng.uniform(0.2, 1.0, 200)
    m = learning.fit_logistic(x, y, w, steps=20_000)
    z = np.column_stack([(x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), np.ones(200)])
    c = np.where(y > 0.5, 0.5 / w[y > 0.5].sum(), 0.5 / w[y < 0.5].sum()) * w
    penalty, beta = np.diag([0.05] * 4 + [0.0]), np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve(z.T @ (z * (c * p * (1 - p))[:, None]) + penalty, z.T @ (c * (p - y)) + penalty @ beta)
    assert np.allclose(m["beta"], beta, atol=1e-6)


@pytest.mark.parametrize("new, old, scores, who", [
    (False, False, {}, "rules"), (True, False, {}, "new"), (False, True, {}, "old"), (True, True, {"rules_only": 0.7, "new": 0.71, "current": 0.71}, "new"), (True, True, {"rules_only": 0.7, "new": 0.705, "current": 0.71}, "old"),
    (True, True, {"rules_only": 0.7, "new": 0.72, "current": 0.73}, "old"), (True, True, {"rules_only": 0.7, "new": 0.726, "current": 0.73}, "new"), (True, True, {"rules_only": 0.7, "new": 0.6, "current": 0.65}, "rules"), (True, False, {"rules_only": 0.9, "new": 0.9}, "rules"),
])
def test_who_decides(new, old, scores, who):
    assert learning.chosen(new, old, scores) == who


def test_training(spark):
    """Adoption, a worse rival that stays out, a pause, and kinds, on samples whose first feature tells the label."""
    rng = np.random.default_rng(6)
    rows = [(float(k), k, [float(k % 2) + rng.normal() * 0.1, float(rng.random())], k % 2, 1.0, "edit", "picture" if k % 6 == 1 else "icon", "icon") for k in range(60)]
    df = spark.createDataFrame(rows, "t double, seq long, f array<double>, keep int, w double, src string, kind string, auto_kind string")
    first = learning.trained(df)
    assert first["adopted"] and first["version"] == 1 and first["exam"]["exam_size"] == 18 and first["exam"]["new"] == 1.0 and first["kind_switches"] == 10 and "kind" in first
    bad = {"mu": [0.0, 0.0], "sd": [1.0, 1.0], "beta": [-9.0, 0.0, 4.5]}
    second = learning.trained(df, {"keep": first["keep"], "version": 1})
    assert second["adopted"] and second["version"] == 2 and second["exam"]["current"] == 1.0
    noise = df.withColumn("f", F.array(F.col("f")[1], F.col("keep").cast("double")))  # the rules, the last feature, are right
    third = learning.trained(noise, {"keep": bad, "version": 4})
    assert not third["adopted"] and third.get("paused") and third["version"] == 4 and "keep" not in third
    log = learning.evolution_row(spark, second, 7.0).first()
    assert (log.t, log.version, log.adopted, log.n, log.current) == (7.0, 2, True, 60, 1.0)


def test_merge_close_replay(spark):
    """Against the plain rule: unite the first pair in order, and start again."""
    rng = np.random.default_rng(9)
    for k in range(3):
        rows = [(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(*(rng.integers(lo, hi, 70) for lo, hi in ((0, 400), (0, 400), (5, 60), (5, 60))))]
        want = [(x, y, x + w, y + h) for x, y, w, h in rows]

        def first_pair():
            for i, a in enumerate(want):
                for j in range(i + 1, len(want)):
                    b = want[j]
                    u = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    gaps = [max(a[d], b[d]) - min(a[d + 2], b[d + 2]) for d in (0, 1)]
                    if max(gaps) <= 4 and max(u[2] - u[0], u[3] - u[1]) <= 150:
                        return i, j, u

        while found := first_pair():
            i, j, want[i] = found[0], found[1], found[2]
            del want[j]
        got = folds.merged_close(boxes(spark, rows), 4, 150).orderBy("seq").collect()
        assert [(r.x, r.y, r.x + r.w, r.y + r.h) for r in got] == want


def test_spread_fit_equals_the_fit(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(300, 5)), rng.random(300)
    y = (x[:, 0] + rng.normal(size=300) > 0.4).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(k), float(v)) for r, k, v in zip(x, y, w)], "f array<double>, keep int, w double").repartition(7)
    want, got = learning.fit_logistic(x, y.astype(float), w, steps=25), learning.spread_fit(df, steps=25)
    for name in ("mu", "sd", "beta"):
        assert np.allclose(got[name], want[name], rtol=0, atol=1e-9), name


def test_training_counts_all_samples(spark, monkeypatch):
    import functools

    monkeypatch.setattr(learning, "spread_fit", functools.partial(learning.spread_fit, steps=3))
    rows = [(k, k, [float(k % 7), float(k % 2)], k % 4 // 3, 1.0, "page") for k in range(200)]
    model = learning.trained(spark.createDataFrame(rows, "t long, seq long, f array<double>, keep int, w double, src string"), max_samples=50)
    assert (model["n"], model["n_keep"], model["n_drop"]) == (200, 50, 150)


def test_confusables(spark):
    """A character that makes a word stays, one that makes none is replaced, and a repair counts for its neighbours."""
    words = spark.createDataFrame([("自我", 900), ("项目", 500), ("目标", 400), ("天天", 60), ("太天", 10), ("大人", 80)], "word string, freq int")
    cases = {"目我剖析": "自我剖析", "项目": "项目", "目标": "目标", "夭天": "天天", "x目": "x目", "": "", "太入": "太入", "大入": "大人"}
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    more = spark.createDataFrame([(f"word{i}", 1) for i in range(994)], "word string, freq int")
    assert {r.text: r.fixed for r in repair.confusables_repaired(df, words.union(more)).collect()} == cases
    assert all(r.text == r.fixed for r in repair.confusables_repaired(df, words.union(more.limit(993))).collect())  # too few words
