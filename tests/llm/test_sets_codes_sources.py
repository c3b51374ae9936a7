"""Set join, vector codes and source divergence: against SQL on a whole table, and against plain Python on awkward ones."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from folioframe.llm import divergence, setjoin, vacodes
from folioframe.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_set_join", "op12_vector_codes", "op13_divergence"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE[name])
    columns, want = [c[0] for c in cursor.description], sorted(map(repr, cursor.fetchall()))
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns) and want
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want


# Set join.


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def linked_sets(rows):
    """{(doc_id, text): (set size, smallest doc_id reachable)} of unique doc_ids."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 10 * min(len(x), len(y)) >= 9 * max(len(x), len(y)) and 100 * len(x & y) >= 90 * len(x | y):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {i: (len(s), top(i)) for i, s in sets}


def held_against_brute(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "'x' as own", "doc_id as doc")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.joined(df, **options).collect() if r.doc_id is not None}
    assert got == linked_sets(rows)
    return got


def variants(rng, n, words, most):
    base = [f"w{k}" for k in rng.sample(range(5000), words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, most)):
            text[rng.randrange(words)] = f"x{rng.randrange(100000)}"
        out.append(" ".join(text))
    return out


def test_set_join_families(spark):
    rng = random.Random(5)
    texts = [t for words, most in ((4, 1), (12, 1), (14, 2), (21, 2), (40, 3), (90, 6), (150, 8), (400, 18)) for t in variants(rng, 25, words, most)]
    # Every size around the borders of the bands, and one element more or less.
    for size in (9, 10, 11, 12, 13, 16, 17, 21, 22, 27, 28, 35):
        base = [f"b{size}_{k}" for k in range(size + 2)]
        texts += [" ".join(base), " ".join(base[1:]), " ".join(base[:-1] + ["end"])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = held_against_brute(spark, rows)
    assert len({c for _, c in got.values()}) < len(got) - 50
    # Chains of texts that each link only with the next one.
    words = [f"c{k}" for k in range(1000)]
    chain = [(i, " ".join(words[8 * i : 8 * i + 200])) for i in range(40)]
    got = held_against_brute(spark, chain)
    assert {c for _, c in got.values()} == {0}


def test_set_join_with_levels_allocated(spark):
    """Many texts share one segment's subset, so that segment is left out and another gets its one-deletion neighbourhood."""
    rng = random.Random(9)
    rows = list(enumerate([t for words, most in ((12, 1), (20, 2), (60, 4), (200, 9)) for t in variants(rng, 40, words, most)]))
    held_against_brute(spark, rows, more_pairs=-100.0)  # every band changes half of its segments


def test_allocation_by_cost():
    of = setjoin.bands(1000)
    first, many = int(of.first[5]), int(of.segments[5])
    gone, raised = setjoin.allocation({first + 2: 1e6, first + 1: 10.0}, {5: 100}, of)
    assert gone == [first + 2] and raised[0] in range(first, first + many) and raised[0] not in (first + 1, first + 2)
    assert setjoin.allocation({first + k: 1e6 for k in range(many)}, {5: 100}, of) == ([], [])  # all alike: nothing is gained


def test_bands_hold_all_partners():
    of = setjoin.bands(5000)
    for b in range(1, len(of.low) - 1):
        sizes = range(int(of.low[b]), int(of.low[b + 1]))
        assert of.segments[b] > 2 * max(sizes) // 19
        assert math.ceil(0.9 * min(sizes)) >= of.low[b - 1]


def test_set_join_awkward(spark):
    text = " ".join(f"q{k}" for k in range(60))
    long = " ".join(f"q{k % 5000}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "one two"), (7, text), (8, text.upper()), (9, text + " tail"), (10, long), (11, long + " end"), (12, "é漢字 😀"), (13, "é漢字 😀")]
    held_against_brute(spark, rows)
    df = spark.createDataFrame([*rows, (None, text), (None, None), (7, text), (9, text + " tail")], "doc_id long, text string")
    got = setjoin.joined(df).collect()
    assert len(got) == len(rows) + 4
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert {r.component_id for r in got if r.doc_id in (7, 8, 9)} == {7}
    assert setjoin.joined(df.where("false")).count() == 0
    assert setjoin.joined(df.where("doc_id is null or doc_id < 4")).count() == 5


def test_set_join_blocks(spark, monkeypatch):
    """A family in which most pairs don't link, dealt out as many small blocks."""
    monkeypatch.setattr(setjoin, "BLOCK_DOCS", 16)
    rng = random.Random(2)
    rows = list(enumerate(variants(rng, 150, 120, 14)))
    got = held_against_brute(spark, rows)
    assert 10 < len({c for _, c in got.values()}) < 150


def test_sketches_never_lose_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 1 << 60, 200).astype(np.uint64)
        b = np.unique(np.concatenate([a[: rng.integers(100, 200)], rng.integers(0, 1 << 60, rng.integers(0, 40)).astype(np.uint64)]))
        a = np.unique(a)
        bits = setjoin.sketches(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 4)
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


# Vector codes.


def codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, _, v in kept) // parts) * parts
    kept = [(i, label, v + [0] * (width - len(v))) for i, label, v in kept]
    m = width // parts
    first = {}
    for i, _, v in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[first[i][p * m : p * m + m] for i in sorted(first)[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = defaultdict(list)
            for _, _, v in kept:
                of[nearest(p, v[p * m : p * m + m])[1]].append(v[p * m : p * m + m])
            new.append([[sum(c) // len(of[e]) for c in zip(*of[e])] if e in of else books[p][e] for e in range(len(books[p]))])
        books = new
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], Counter()
    for i, label, v in kept:
        found = [nearest(p, v[p * m : p * m + m]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        total[label] += out[-1][3]
    return sorted(((i, code, error, total[label], sha) for i, label, code, error in out), key=repr)


def coded(df):
    return sorted((tuple(r) for r in vacodes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, f"vec_id long, label int, embedding array<float>{more}")


def test_codes_awkward(spark, monkeypatch):
    rng = random.Random(4)
    f32 = lambda x: float(np.float32(x))
    make = lambda: [f32(rng.gauss(0, 0.3)) for _ in range(32)]
    rows = [(i * 3, rng.choice([0, 1, 2, None]), make()) for i in range(150)]
    rows += [(1, 1, None), (2, 1, [float("nan")] + make()[1:]), (4, 1, [float("inf")] + make()[1:]), (5, 2, [None] + make()[1:]), (None, 1, make()), (7, None, rows[3][2]), rows[0], rows[0], (3, 0, make()), (10, 5, make()[:5]), (11, 5, []), (13, 6, [-0.001] * 32)]
    assert coded(vectors(spark, rows)) == codes(rows)
    monkeypatch.setattr(vacodes, "BROADCAST_LABELS", 1)
    assert coded(vectors(spark, rows[:20])) == codes(rows[:20])  # fewer vectors than entries, and sums joined by a shuffle
    assert coded(vectors(spark, rows).where("false")) == []
    assert coded(vectors(spark, [(1, 1, None), (None, 2, make())])) == []
    assert coded(vectors(spark, [(1, 1, []), (2, None, [])])) == codes([(1, 1, []), (2, None, [])])
    clash = vectors(spark, [(*r, 1, "x") for r in rows[:30]], ", error long, code string")
    assert coded(clash) == codes(rows[:30])


def test_large_components_are_held(spark):
    rows = [(i, 0, [3e38 * (-1) ** i] * 16 + [float(i)] * 16) for i in range(8)]
    got = coded(vectors(spark, rows))
    assert len(got) == 8 and all(0 <= r[2] < 1 << 63 for r in got)


@pytest.mark.parametrize("width,scale", [(1, 5), (4, 40), (4, 1 << 20), (7, 300)])
def test_bounds_and_nearest(width, scale):
    rng = np.random.default_rng(width)
    book = vacodes.Book(rng.integers(-scale, scale, (64, width)))
    parts = rng.integers(-2 * scale, 2 * scale, (500, width))
    exact = ((parts[:, None] - book.entries) ** 2).sum(axis=2)
    least, most = book.bounds(parts)
    assert (least <= exact.T).all() and (exact.T <= most).all()
    code, distance = book.nearest(parts)
    assert (code == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    if width > 1:
        assert (least <= most.min(axis=0)).mean() < 0.5  # the filter leaves out most entries


# Source divergence.


def audit(rows, min_docs, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= min_docs]
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= min_docs) for s in {d[1] for d in mine}}
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            found = [(s2, sum(abs(p[s][t] - p[s2][t]) for t in kept)) for s2 in count if s2 != s]
            best = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", found), ("term", best)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, n) for n, (item, value) in enumerate(items[: top if part == "term" else None], 1)]
    return sorted(out)


def sources(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as value", "2 as rank", "'x' as term")


def test_divergence_awkward(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "abcÉz" for b in "öxyλ" for c in ("", "q", "qq", "漢")]
    rows = []
    for lang in ("en", "de", None, ""):
        for s in range(rng.randint(3, 9)):
            mine = rng.sample(words, 30)
            rows += [(" ".join(rng.choices(mine, k=rng.randint(0, 60))).upper() if rng.random() < 0.2 else " ".join(rng.choices(mine, k=25)), lang, f"s{s}" if s else None) for _ in range(rng.randint(1, 25))]
    rows += [(None, "en", "empty"), ("", "en", "ä"), ("once only", "xx", "one"), ("a b " * 50_000, "en", "long"), (None, "yy", None), (None, "yy", "two"), rows[0], rows[0]]
    df = sources(spark, rows)
    for min_docs, top in ((4, 7), (1, 50)):
        got = sorted(tuple(r) for r in divergence.audit(df, min_docs, top).collect())
        assert got == audit(rows, min_docs, top)
    monkeypatch.setattr(divergence, "CHUNK", 8)  # many chunks
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "ACCUMULATED", 4)
    assert sorted(tuple(r) for r in divergence.audit(df, 4, 7).collect()) == audit(rows, 4, 7)
    assert divergence.audit(df.where("false")).count() == 0


def test_many_ties_are_cut_by_bytes(spark):
    rng = random.Random(8)
    rows = [("g", "s", f"{'pre' * (n % 3)}{rng.choice('aé漢')}{rng.randrange(10**6)}", 10 + 5 * (n % 2), 10) for n in range(3000)]
    rows = list({r[2]: r for r in rows}.values()) + [("g", "t", "alone", 12, 3)]
    cells = spark.createDataFrame(rows, "lang string, source string, term string, p long, q long")
    want = sorted(((r[3] - r[4], r[2]) for r in rows if r[3] > r[4] and r[1] == "s"), key=lambda x: (-x[0], x[1].encode()))[:50]
    got = sorted((tuple(r) for r in divergence.top_terms(cells, 50, tied=5).where("source = 's'").select("rank", "value", "item").collect()))
    assert [x[1:] for x in got] == want and divergence.top_terms(cells, 50, tied=5).where("source = 't'").count() == 1


def test_corrections_equal_dense_sums():
    rng = np.random.default_rng(3)
    base, m = rng.integers(1, 100, 6), 40
    shares = np.tile(base, (m, 1))
    has = rng.random((m, 6)) < 0.3
    shares[has] = rng.integers(1, 1000, has.sum())
    term, place = np.nonzero(has)
    order = rng.permutation(len(term))
    number = np.unique(term, return_inverse=True)[1]
    got = divergence.corrections(base, number[order], place[order], shares[has][order]) + m * np.abs(base[:, None] - base)
    assert (got == np.abs(shares[:, :, None] - shares[:, None, :]).sum(axis=0)).all()


def test_components_with_hot_nodes(spark, monkeypatch):
    from folioframe.llm import components

    monkeypatch.setattr(components, "LEAST", 5)
    rng = random.Random(7)
    links = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(300, 400)] + [(i, i + 1) for i in range(600, 640)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(150)] + [(199, 500), (5, 5)]
    root = {n: n for x in links for n in x if x[0] != x[1]}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        if a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    rng.shuffle(links)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {n: top(n) for n in root} and len(got) == len(root)
