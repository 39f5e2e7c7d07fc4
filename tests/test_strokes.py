"""Skeletons, strokes and curves of shapes drawn by hand, and plain models of the steps."""

import math

import numpy as np
import pytest

from typelens.operators import skeleton as K
from typelens.operators import strokes as T
from typelens.sources.shipping import ship


def blank(h=41, w=41):
    return np.zeros((h, w), bool)


def line(m, a, b, r=2):
    """A round pen from a to b (x, y)."""
    yy, xx = np.mgrid[: m.shape[0], : m.shape[1]]
    for t in np.linspace(0, 1, 200):
        m |= (xx - a[0] - t * (b[0] - a[0])) ** 2 + (yy - a[1] - t * (b[1] - a[1])) ** 2 <= r * r
    return m


def circle(r=12, pen=2.2):
    yy, xx = np.mgrid[:41, :41]
    return np.abs(np.hypot(xx - 20, yy - 20) - r) <= pen


def skeleton(m):
    return K.smooth_steps(K.thinned(m), K.distances(m))


def shapes():
    rng = np.random.default_rng(1)
    return [line(blank(), (5, 20), (35, 20)), line(line(blank(), (5, 5), (35, 35)), (35, 5), (5, 35)), circle(), rng.random((23, 31)) < 0.6, rng.random((3, 3)) < 0.5, np.ones((9, 12), bool), blank()]


def test_distances():
    for m in shapes():
        y, x = np.nonzero(~m)
        got = K.distances(m)
        for a, b in zip(*np.nonzero(m)):
            dy, dx = np.abs(y - a), np.abs(x - b)
            want = min(np.maximum(dy, dx) + (math.sqrt(2) - 1) * np.minimum(dy, dx), default=math.inf)
            assert got[a, b] == pytest.approx(want)
        assert (got[~m] == 0).all()


def test_thinning_pixel_by_pixel():
    def model(m):
        img = m.astype(int).copy()
        around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
        changed = True
        while changed:
            changed = False
            for half in (0, 1):
                go = []
                for y in range(1, m.shape[0] - 1):
                    for x in range(1, m.shape[1] - 1):
                        p = [img[y + a, x + b] for a, b in around]
                        n, e, s, w = p[0], p[2], p[4], p[6]
                        changes = sum(p[k] < p[(k + 1) % 8] for k in range(8))
                        stop = (n and e and s) or (e and s and w) if half == 0 else (n and e and w) or (n and s and w)
                        if img[y, x] and 2 <= sum(p) <= 6 and changes == 1 and not stop:
                            go.append((y, x))
                for q in go:
                    img[q] = 0
                changed = changed or bool(go)
        return img.astype(bool)

    for m in shapes():
        assert (K.thinned(m) == model(m)).all()


def test_steps_are_smoothed_without_breaking():
    from typelens.operators.components import label

    for m in shapes():
        thin = K.thinned(m)
        got = skeleton(m)
        assert not (got & ~thin).any() and label(got, True).max() == label(thin, True).max()
        assert (K.smooth_steps(got, K.distances(m)) == got).all()


def test_strokes_of_letters():
    bar = T.drawn(skeleton(line(blank(), (5, 20), (35, 20))), 5)
    assert len(bar) == 1 and not bar[0][1] and T.length(bar[0][0]) > 24
    cross = T.drawn(skeleton(line(line(blank(), (5, 5), (35, 35)), (35, 5), (5, 35))), 5)
    assert len(cross) == 2 and all(T.length(p) > 34 for p, _ in cross)  # two straight lines, not four arms or two hooks
    for p, _ in cross:
        assert T.off(p).max() < 3
    tee = T.drawn(skeleton(line(line(blank(), (5, 6), (35, 6)), (20, 6), (20, 36))), 5)
    assert sorted(round(T.length(p) / 10) for p, _ in tee) == [3, 3] and not any(c for _, c in tee)
    ring = skeleton(circle())
    assert T.drawn(ring, 5) == [] and len(T.rings(ring)) == 1
    assert T.length(T.rings(ring)[0]) == pytest.approx(2 * math.pi * 12, rel=0.1)
    assert T.drawn(blank(), 5) == [] and T.rings(blank()) == []


def test_spurs():
    m = blank()
    m[20, 5:36] = True
    m[17:20, 20] = True
    assert len(T.drawn(m, 6)) == 1 and len(T.drawn(m, 1)) == 2


def test_simplified():
    p = [complex(x, 0.2 * (x % 2)) for x in range(30)] + [complex(29, y) for y in range(1, 20)]
    got = T.simplified(p, 0.75)
    assert len(got) == 3 and got[0] == p[0] and got[-1] == p[-1]
    assert T.simplified(p[:2], 1) == p[:2] and T.simplified([1j, 1j, 1j], 1) == [1j, 1j]
    for tolerance in (0.1, 0.5, 2):
        rng = np.random.default_rng(3)
        q = list(np.cumsum(rng.normal(size=60) + 1j * rng.normal(size=60)))
        s = T.simplified(q, tolerance)
        at = [q.index(z) for z in s]
        assert all(T.off(q[a : b + 1]).max() <= tolerance for a, b in zip(at, at[1:]))


def test_corners():
    square = [0, 5, 10, 10 + 5j, 10 + 10j, 5 + 10j, 10j, 5j, 0]
    assert [len(r) for r in T.at_corners(list(map(complex, square)), True)] == [3, 3, 3, 3]
    assert [len(r) for r in T.at_corners([0j, 5 + 0j, 10 + 0j, 10 + 5j], False)] == [3, 2]
    smooth = [complex(math.cos(t), math.sin(t)) for t in np.linspace(0, 2 * math.pi, 40)]
    assert T.at_corners(smooth, True) == [smooth]


@pytest.mark.parametrize("tolerance", [0.3, 1.0])
def test_cubics(tolerance):
    """Curves begin and end where they should, hang together, and stay near all points."""
    arc = [complex(30 * math.cos(t), 30 * math.sin(t)) for t in np.linspace(0, 5, 120)]
    wave = [complex(x, 12 * math.sin(x / 9)) for x in range(120)]
    for points in (arc, wave):
        c = T.cubics(points, tolerance)
        assert c[0][0] == points[0] and c[-1][3] == points[-1] and all(a[3] == b[0] for a, b in zip(c, c[1:]))
        dense = np.concatenate([k @ T.weights(np.linspace(0, 1, 300)) for k in c])
        assert max(np.abs(dense - p).min() for p in points) < tolerance + 0.05
        assert len(c) < 16
    assert len(T.cubics([0j, 3 + 0j], 1)) == 1 and T.cubics([1j], 1) == []
    exact = np.array([0, 3 + 9j, 12 + 9j, 15]) @ T.weights(np.linspace(0, 1, 30))
    assert len(T.cubics(list(exact), tolerance)) <= (1 if tolerance >= 1 else 4)  # under 1 a run is parted before its parameters are moved


def test_rows(spark):
    ship(spark)
    masks = [line(blank(), (5, 20), (35, 20)), circle(), blank()]
    df = spark.createDataFrame([(i, m.reshape(-1).tolist(), 41) for i, m in enumerate(masks)] + [(9, None, 41), (8, [], 41)], "sheet_id long, ink array<boolean>, width long")
    got = {r.sheet_id: r for r in T.strokes(K.skeletons(df)).collect()}
    assert set(got) == {0, 1} and got[1].closed and got[1].path.endswith("Z") and got[1].path.count("C") >= 2
    assert not got[0].closed and got[0].path.count("L") == 1 and "C" not in got[0].path
