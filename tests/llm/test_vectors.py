"""Vector codes against a plain Lloyd in Python's integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from graphloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, vectors="embedding"):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    ints = lambda v: [math.floor(4096 * max(-(2.0**40), min(2.0**40, x))) for x in v]
    kept = [(r[0], ints(r[1]), r[2]) for r in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    parts = [[r[1][j * width : (j + 1) * width] for r in kept] for j in range(8)]
    codes, errors, books = [], [], []
    for own in parts:
        book = [list(p) for p in own[:16]]
        dist = lambda p, e: sum((a - b) ** 2 for a, b in zip(p, e, strict=True))
        for _ in range(6):
            near = [min(range(len(book)), key=lambda e: (dist(p, book[e]), e)) for p in own]
            for e in range(len(book)):
                if mine := [p for p, a in zip(own, near, strict=True) if a == e]:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        near = [min(range(len(book)), key=lambda e: (dist(p, book[e]), e)) for p in own]
        codes.append(near)
        errors.append([dist(p, book[a]) for p, a in zip(own, near, strict=True)])
        books.append(book)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [min(sum(x), V.MOST) for x in zip(*errors, strict=True)]
    by = defaultdict(int)
    for r, x in zip(kept, error, strict=True):
        by[r[2]] += x
    return sorted((str(r[0]), bytes(c[i] for c in codes).hex(), error[i], min(by[r[2]], V.MOST), sha) for i, r in enumerate(kept) for _ in [0])


def ours(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in V.op12(df).collect())


def f32(*x):
    return [float(np.float32(v)) for v in x]


def test_codes_with_ties_and_repeats(spark):
    r = random.Random(5)
    rows = [(i, f32(*[r.choice([-0.5, -0.25, 0.0, 0.25, 0.1, -0.001]) for _ in range(16)]), r.choice([None, 1, 2])) for i in range(120)]
    rows += [(i + 500, list(rows[3][1]), 1) for i in range(40)] + rows[:7]
    rows += [(900, None, 1), (901, f32(*range(15)) + [None], 1), (902, f32(*range(15)) + [float("nan")], 1), (903, f32(*range(15)) + [float("-inf")], None), (904, [], 1), (None, f32(*[0.3] * 16), None), (-5, f32(*[r.gauss(0, 1) for _ in range(16)]), None)]
    r.shuffle(rows)
    assert ours(spark, rows) == plain(rows)


def test_codes_of_clusters(spark):
    r = random.Random(6)
    centres = [[r.gauss(0, 0.3) for _ in range(32)] for _ in range(9)]
    rows = [(r.randrange(10**9), f32(*[c + r.gauss(0, 0.05) for c in r.choice(centres)]), i % 4) for i in range(300)]
    assert ours(spark, rows) == plain(rows)


def test_few_and_huge(spark):
    assert ours(spark, []) == [] == ours(spark, [(1, None, 1)])
    rows = [(1, [1e30] * 8, 0), (2, [-1e300] * 8, 0), (3, [2.0**33 + k for k in range(8)], 1), (4, [5e-324] * 8, 1)]
    assert ours(spark, rows, "vec_id long, embedding array<double>, label int, code string, ints int".split(", code")[0]) == plain(rows)
    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) * 2.0 ** r.randrange(30) for _ in range(8)], 0) for i in range(60)]
    assert ours(spark, rows, "vec_id long, embedding array<double>, label int") == plain(rows)


def test_bounds_spare_scans():
    """On settled clusters few parts are scanned, and what isn't keeps its nearest entry."""
    r = np.random.default_rng(8)
    x = (r.choice(r.integers(-2000, 2000, (16, 8, 4)), 400) + r.integers(-40, 40, (400, 8, 4))).astype(np.int64)
    books = V.Books(x[:16].transpose(1, 0, 2).copy())
    code = upper = lower = None
    scans = []
    for _ in range(7):
        code, upper, lower, n = books.assign(x, code, upper, lower)
        scans.append(n)
        for j in range(8):
            d = ((x[:, j, None] - books.entries[j]) ** 2).sum(-1)
            assert (code[:, j] == d.argmin(1)).all()
            near = np.sort(d, axis=1)
            assert (upper[:, j].astype(float) ** 2 >= near[:, 0]).all() and (lower[:, j].astype(float) ** 2 <= near[:, 1]).all()
        sums = V.Sums(books.entries.shape)
        assert list(sums.add(x, code)) == []
        books = books.renewed(next(sums.out()))
    assert scans[0] == 3200 and scans[-1] < 320


def test_other_lengths_and_columns(spark):
    rows = [(i, [0.1 * i] * 8, 1, "x", 5) for i in range(5)] + [(9, [0.1] * 4, 1, "y", 6)]
    out = V.op12(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, Error int"))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 5
