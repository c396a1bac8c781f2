import random

import duckdb
import numpy as np
import pytest

from offerlake.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, slot int, score long, n int, mark long, planes string"


def brute(rows, every=50, positives=5, negatives=3):
    """(anchor, positive, rank, negative, scores), plainly."""
    ints, seen = [], set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (i, tuple(int(np.floor(256 * x)) for x in v), label)
        if row not in seen:
            seen.add(row)
            ints.append(row)
    out = []
    for a in ints:
        if a[0] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[1], c[1], strict=True)), c) for c in ints if c != a and len(c[1]) == len(a[1])]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for p, pos in [s for s in scored if s[1][2] == a[2]][:positives]:
            fit = [s for s in scored if s[1][2] != a[2] and 50 * p <= 100 * s[0] <= 95 * p][:negatives]
            out += [(a[0], pos[0], k, n[1][0], p, n[0]) for k, n in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed=1, n=400, dim=12, labels=4):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(0, 1) if rng.random() < 0.8 else rng.uniform(-1, 0) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(60)]  # ties with an anchor
    rows += [rows[100], rows[100], rows[7], (50, rows[3][1], 2), (None, rows[0][1], 1), (2000, None, 1), (2050, rows[0][1], None),
             (2100, [0.1, None] + [0.0] * (dim - 2), 1), (2150, [float("nan")] * dim, 1), (2200, [float("inf")] * dim, 1),
             (2250, [0.0] * dim, 1), (2300, [], 1), (2301, [], 1), (2302, [], 2), (2350, [0.5, 0.25, -0.125], 1), (2351, [0.5, 0.5, 0.5], 1),
             (2352, [0.25, 0.125, 0.5], 3), (2400, [1e5] * dim, 1), (2401, [9e4] * dim, 1), (2402, [6e4] * dim, 2), (2450, [1e300] * dim, 1),
             (-50, rows[9][1], 3), (-49, rows[9][1], 3), (-48, rows[9][1], 1)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [8192, 3])
def test_equal_to_brute_force(spark, block):
    rows = vectors(n=200 if block == 3 else 400)
    got = sorted(tuple(r) for r in hardneg.hard_negatives(table(spark, rows), anchor_block=block).collect())
    assert got == brute([r for r in rows if r[1] is None or 1e300 not in r[1]])  # too large for a long: takes no part


def test_one_label_holds_most_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(0, 1) for _ in range(9)], 0 if i % 3 else i % 5) for i in range(300)]
    assert sorted(tuple(r) for r in hardneg.hard_negatives(table(spark, rows)).collect()) == brute(rows)


def test_empty_table(spark):
    assert hardneg.hard_negatives(table(spark, [])).collect() == []


@pytest.mark.parametrize("dim,top", [(0, 5), (1, 1), (7, 130), (8, 1 << 20), (64, 128), (65, 3)])
def test_planes_and_scores(dim, top):
    rng = np.random.default_rng(dim)
    v, anchors = rng.integers(-top, top + 1, (50, dim)), rng.integers(-top, top + 1, (20, dim))
    bits = int(max(v.max(initial=0), (~v).max(initial=0))).bit_length() + 1
    planes = hardneg.to_planes(v, bits)
    assert (hardneg.from_planes(planes, dim) == v).all()
    bound = int(np.abs(anchors).sum(axis=1).max(initial=0))
    assert (hardneg.score(planes, hardneg.subset_sums(anchors), bound) == v @ anchors.T).all()


@pytest.mark.parametrize("positive", [0, 1, 2, 99, 100, 101, -1, -100, 7919, (1 << 61) + 12345, -(1 << 61) - 1])
def test_score_range(positive):
    least, most = (int(x[0]) for x in hardneg.score_range(np.array([positive]), 50, 95))
    assert 50 * positive <= 100 * least and 100 * (least - 1) < 50 * positive
    assert 100 * most <= 95 * positive < 100 * (most + 1)


def test_oracle_sql_on_odd_rows(spark):
    rows = [r for r in vectors(n=150) if r[1] is None or not r[1] or max(map(abs, (x or 0 for x in r[1]))) < 1e6]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in rows])
    moved = [(i, v, (label + 1) % 10 if i is not None and label is not None and i % 7 == 0 else label) for i, v, label in rows]
    want = sorted((a, p, k, n, ps, ns) for a, p, k, n, ps, ns in con.execute(
        f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hardneg.oracle()})").fetchall())
    assert sorted(tuple(r) for r in hardneg.hard_negatives(table(spark, moved)).collect()) == want
