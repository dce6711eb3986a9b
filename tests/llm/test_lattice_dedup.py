"""Embedding near-dedup against brute force: groups of copies, pairs near the threshold, odd vectors."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from sourceloom.llm import lattice_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, row int, component long, links string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def brute(rows, cosine=0.93):
    xs = []
    for _, vector, label in rows:
        ok = label is not None and vector and None not in vector and np.isfinite(vector).all() and np.any(vector)
        x = np.zeros(max(len(r[1] or []) for r in rows))
        if ok:
            x[:len(vector)] = np.array(vector, np.float32)
            x /= np.linalg.norm(x)
        xs.append(x)
    linked = np.array(xs) @ np.array(xs).T >= cosine
    labels = np.array([-1 if r[2] is None else r[2] for r in rows])
    linked &= labels[:, None] == labels
    np.fill_diagonal(linked, False)
    label = np.arange(len(rows))
    while True:
        low = np.minimum(label, np.where(linked, label, len(rows)).min(axis=1))
        if (low == label).all():
            break
        label = low
    ids = {}
    for g, r in zip(label, rows):
        if r[0] is not None:
            ids[g] = min(ids.get(g, r[0]), r[0])
    return Counter((r[0], int(linked[i].sum()), ids.get(label[i]), r[0] == ids.get(label[i])) for i, r in enumerate(rows))


def near(rng, x, cosine):
    """A unit vector at exactly this cosine from ``x``."""
    other = rng.normal(size=len(x))
    other -= (other @ x) * x
    return cosine * x + np.sqrt(1 - cosine ** 2) * other / np.linalg.norm(other)


def unit(rng, dims=64):
    x = rng.normal(size=dims)
    return x / np.linalg.norm(x)


def made(rng, hot):
    out = [unit(rng) for _ in range(300)]
    for _ in range(60):
        x = unit(rng)
        out += [x, x, near(rng, x, rng.choice([0.96, 0.98, 0.995]))]
    centre = unit(rng)
    out += [near(rng, centre, rng.choice([0.985, 0.99, 0.999])) for _ in range(hot)]
    out += [near(rng, centre, c) for c in np.linspace(0.85, 0.985, 40)]
    return [(1000 - i, (x * rng.uniform(0.01, 100)).astype(np.float32).tolist(), i % 3) for i, x in enumerate(out)]


@pytest.mark.parametrize("hot", [0, 900])
def test_against_brute_force(spark, hot):
    rows = made(np.random.default_rng(hot), hot)
    rows += [(None, rows[0][1], rows[0][2]), (None, rows[5][1], rows[5][2]), (5000, rows[5][1], rows[5][2]), (5000, rows[5][1], rows[5][2])]
    got = Counter(map(tuple, lattice_dedup.near_vectors(frame(spark, rows)).collect()))
    want = brute(rows)
    assert sum((got & want).values()) >= 0.995 * len(rows)  # the tables may miss a pair near the threshold
    if hot:
        assert max(r[1] for r in got) > 250  # a third of the copies has each label


def test_balls_are_exact(spark, monkeypatch):
    """Where every row lies in one of two balls that lie close together, or near them, no link depends on the tables."""
    rng = np.random.default_rng(4)
    one = unit(rng)
    two = near(rng, one, 0.95)
    monkeypatch.setattr(lattice_dedup, "_centres", lambda *_: (np.array([1, 1, 2]), np.array([one, two, one])))
    rows = [(i, near(rng, (one, two)[i % 2], c).tolist(), 1) for i, c in enumerate(np.linspace(0.985, 1, 900))]
    loose = [(1000 + i, near(rng, one, c).tolist(), 1) for i, c in enumerate(np.linspace(0.85, 0.98, 12))]
    want = {r[0]: r for r in brute(rows + loose)}
    found = lattice_dedup.near_vectors(frame(spark, rows + loose)).collect()
    assert len(found) == len(want)
    differ = [(tuple(r), want[r.vec_id]) for r in found if tuple(r) != want[r.vec_id]]
    assert all(r[0] >= 1000 and r[1] <= w[1] for r, w in differ) and len(differ) <= 2  # two loose ones that no table holds together


def test_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    lattice = lattice_dedup.Lattice(64)
    x = np.array([unit(rng) for _ in range(2000)])
    for cosine, least in ((0.93, 0.95), (0.96, 0.995)):
        y = np.array([near(rng, v, cosine) for v in x])
        a, b = (lattice.cells(v, np.zeros(len(v), np.int64)) for v in (x, y))
        met = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any(axis=(1, 2))
        assert met.mean() >= least
    strangers = (a == np.roll(b, 1, axis=0)[:, :, :1]).any(axis=(1, 2))
    assert strangers.mean() < 0.002


def test_nearest_points():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(200, 8)) * 3
    own = lattice_dedup.nearest_points(z)
    assert (np.ptp((own * 2).astype(int) % 2, axis=1) == 0).all()
    assert (own.sum(axis=1) % 2 == 0).all()
    away = ((z - own) ** 2).sum(axis=1)
    assert (away <= ((z[:, None] - own[:, None] - lattice_dedup.NEIGHBOURS) ** 2).sum(axis=2).min(axis=1) + 1e-9).all() and away.max() <= 1 + 1e-9


def test_spanning():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = 40
        a, b = rng.integers(0, n, 30), rng.integers(0, n, 30)
        want = np.arange(n)
        for _ in range(n):
            low = np.minimum(want[a], want[b])
            np.minimum.at(want, a, low)
            np.minimum.at(want, b, low)
        assert lattice_dedup.spanning(n, a, b).tolist() == want.tolist()


def test_odd_vectors(spark):
    nan, one = float("nan"), [0.5, 0.5]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [1.0, None], 1), (6, one, None), (7, one, 1), (8, one, 2), (9, one, 1), (9, one, 1), (None, one, 1),
            (None, [1.0, -1.0], 1), (10, [1e-30, 1e-30], 1), (11, [1e30, 1e30], 1), (12, [3.0], 1), (13, [2.0], 1), (None, None, None)]
    got = Counter(map(tuple, lattice_dedup.near_vectors(frame(spark, rows)).collect()))
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 8, None, None)]
    assert got == Counter([*alone, (7, 5, 7, True), (9, 5, 7, False), (9, 5, 7, False), (None, 5, 7, False), (10, 5, 7, False), (11, 5, 7, False), (12, 1, 12, True), (13, 1, 12, False)])


def test_empty_table(spark):
    assert lattice_dedup.near_vectors(frame(spark, [])).collect() == []
    assert lattice_dedup.near_vectors(frame(spark, [(1, None, None), (2, [], 3)])).count() == 2
