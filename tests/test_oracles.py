"""Every registered page query against its SQL in DuckDB, and checks of those that SQL can't express."""

import math
import os

import duckdb
import pytest

from folioframe.plans import queries as q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_equals_sql(spark, duck, name):
    got = q.QUERIES[name](spark, SF)
    cursor = duck.execute(q.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(tuple(plain(v) for v in r) for r in cursor.fetchall())
    assert want, "an empty result proves nothing"
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


def test_group_lines_replay(spark):
    rows = [r.asDict() for r in q.boxes(spark, SF).collect()]
    want = {}
    for page in {r["page"] for r in rows}:
        blocks = []
        for r in sorted((r for r in rows if r["page"] == page), key=lambda r: (r["y"], r["x"], r["id"])):
            base, size, badge = r["y"] + r["h"], r["h"], r["id"] % 17 == 0
            color = [r["id"] % 5 * k for k in (5, 7, 11)]
            for n, b in enumerate(blocks):
                last = b[-1]
                gap = base - last["base"]
                left = abs(last["x"] - r["x"]) < 0.6 * size
                center = abs((last["x"] + last["right"]) - (r["x"] + r["x"] + r["w"])) / 2 < 0.6 * size
                close = sum(abs(a - c) for a, c in zip(last["color"], color)) < 90
                if abs(last["size"] - size) < 0.15 * max(last["size"], size) and close and 0.9 * size < gap < 2.2 * size and (left or center) and not badge and not last["badge"]:
                    break
            else:
                n = len(blocks)
                blocks.append([])
            blocks[n].append({"x": r["x"], "right": r["x"] + r["w"], "base": base, "size": size, "badge": badge, "color": color})
            want[r["id"]] = (n, len(blocks[n]) - 1)
    got = {r.id: (r.block, r.line_no) for r in q.QUERIES["group_lines"](spark, SF).collect()}
    assert got == want


def test_keep_better_replay(spark):
    rows = sorted(((r.page, r.id, r.x, r.y, r.w, r.h, r.w * 7 % 100) for r in q.boxes(spark, SF).collect()), key=lambda r: r[:2])

    def iou(a, b):
        w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        meet = max(0, w) * max(0, h)
        return meet / max(1, a[4] * a[5] + b[4] * b[5] - meet)

    kept = {}
    for r in rows:
        own = kept.setdefault(r[0], [])
        i = next((i for i, o in enumerate(own) if iou(r, o) >= 0.3), None)
        if i is None:
            own.append(r)
        elif r[6] > own[i][6]:
            own[i] = r
    assert {r.id for r in q.QUERIES["keep_better"](spark, SF).collect()} == {r[1] for own in kept.values() for r in own}


def test_merge_close_leaves_no_pair(spark):
    pages = {}
    for r in q.QUERIES["merge_close"](spark, SF).collect():
        pages.setdefault(r.page, []).append(r)
    for own in pages.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                x, y = min(a.x, b.x), min(a.y, b.y)
                w, h = max(a.x + a.w, b.x + b.w) - x, max(a.y + a.h, b.y + b.h) - y
                apart = max(0, w - a.w - b.w) > 4 or max(0, h - a.h - b.h) > 4
                assert apart or max(w, h) > 200


def test_models(spark):
    p = [r.p for r in q.QUERIES["logreg_fit"](spark, SF).collect()]
    assert p and all(0 <= v <= 1 and math.isfinite(v) for v in p)
    r = q.QUERIES["train_adopt"](spark, SF).first()
    assert r.n == r.n_keep + r.n_drop and r.version in (0, 1) and r.adopted == (r.version == 1)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
