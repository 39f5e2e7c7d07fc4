"""Strokes of skeletons: the lines between junctions paired into what a pen would draw, and cubic curves through them.

A skeleton is one row; its graph is walked there, and a stroke is a row.  Points are complex numbers, x + iy.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .components import label
from .skeleton import branches, ring, skeletonised, slices

TURN, BEND = 0.62 * math.pi, 0.45  # the sharpest turn at a join; the weight of unlike curvatures
NEAR = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
CORNER = math.pi / 3


def turn(a: complex, b: complex) -> float:
    """The angle between two directions, 0 to pi; 0 where one has no length."""
    return abs(math.atan2((b * a.conjugate()).imag, (b * a.conjugate()).real))


def length(points: list[complex]) -> float:
    return sum(abs(b - a) for a, b in zip(points, points[1:]))


def walks(skeleton: np.ndarray) -> tuple[list[tuple[int, int, list[complex]]], set[int]]:
    """(node, node, points) of the lines between nodes, and the nodes that are ends.  A cluster of junctions (three branches and more) is a node, each
    end (one neighbour) another; a line that meets no node has -1.  At a pixel with several ways on, the straightest is taken; a step is walked once."""
    degree = sum(v.astype(np.int64) for v in ring(skeleton)) * skeleton
    junction = branches(skeleton) >= 3
    node = label(junction, diagonal=True) - 1
    ends, n = set(), int(node.max(initial=-1)) + 1
    for y, x in zip(*np.nonzero((degree == 1) & ~junction)):
        node[y, x] = n
        ends.add(n)
        n += 1
    h, w = skeleton.shape
    around = lambda p: [(p[0] + a, p[1] + b) for a, b in NEAR if 0 <= p[0] + a < h and 0 <= p[1] + b < w and skeleton[p[0] + a, p[1] + b]]
    at = lambda p: complex(p[1], p[0])
    step = lambda p, q: (min(p, q), max(p, q))
    gone, lines = set(), []
    for start in zip(*(v.tolist() for v in np.nonzero(node >= 0))):
        for now in around(start):
            if node[now] == node[start] or step(start, now) in gone:
                continue
            gone.add(step(start, now))
            before, points = start, [at(start), at(now)]
            while node[now] < 0:
                ways = [q for q in around(now) if q != before and step(now, q) not in gone]
                if not ways:
                    break
                on = min(ways, key=lambda q: turn(at(now) - at(before), at(q) - at(now)))  # noqa: B023
                gone.add(step(now, on))
                before, now = now, on
                points.append(at(now))
            lines.append((int(node[start]), int(node[now]), points))
    return lines, ends


def without_spurs(lines: list, ends: set[int], least: float) -> list:
    """Lines but short ones from a junction of three lines and more to an end; what goes makes its junction smaller, until nothing goes."""
    alive, degree = list(lines), defaultdict(int)
    for a, b, _ in alive:
        degree[a] += 1
        degree[b] += 1
    while True:
        kept = []
        for a, b, points in alive:
            joins = [v >= 0 and v not in ends and degree[v] >= 3 for v in (a, b)]
            loose = [v < 0 or v in ends for v in (a, b)]
            if length(points) < least and ((joins[0] and loose[1]) or (joins[1] and loose[0])):
                degree[a] -= 1
                degree[b] -= 1
            else:
                kept.append((a, b, points))
        if len(kept) == len(alive):
            return alive
        alive = kept


def bend(points: list[complex]) -> float:
    """The mean turn at the inner points of the first few of a line."""
    p = points[: min(4, len(points) - 1) + 3]
    turns = [turn(b - a, c - b) for a, b, c in zip(p, p[1:], p[2:])]
    return sum(turns) / len(turns) if turns else 0.0


def paired(lines: list) -> dict[tuple[int, int], tuple[int, int]]:
    """For ends of lines (line, side) the end that a pen goes on with at the same node: pairs by straightness and like curvature, the best first."""
    at_node = defaultdict(list)
    facts = {}
    for i, (a, b, points) in enumerate(lines):
        for side, (v, p) in enumerate(((a, points), (b, points[::-1]))):
            facts[i, side] = p[min(4, len(p) - 1)] - p[0], bend(p)
            if v >= 0:
                at_node[v].append((i, side))
    mate = {}
    for here in at_node.values():
        costs = []
        for k, one in enumerate(here):
            for two in here[k + 1 :]:
                sharp = math.pi - turn(facts[one][0], facts[two][0])
                if sharp <= TURN:
                    costs.append((sharp + BEND * abs(facts[one][1] - facts[two][1]), len(costs), one, two))
        for _, _, one, two in sorted(costs):
            if one not in mate and two not in mate:
                mate[one], mate[two] = two, one
    return mate


def drawn(skeleton: np.ndarray, least: float) -> list[tuple[list[complex], bool]]:
    """Strokes (points, closed): lines followed from end to end, unpaired ends first, then rings of lines."""
    lines = without_spurs(*walks(skeleton), least)
    mate, used, out = paired(lines), set(), []
    every = [(i, side) for i in range(len(lines)) for side in (0, 1)]
    for start in [e for e in every if e not in mate] + [e for e in every if e[1] == 0]:
        if start[0] in used:
            continue
        points: list[complex] = []
        end, closed = start, False
        while True:
            if end[0] in used:
                closed = True
                break
            used.add(end[0])
            more = lines[end[0]][2] if end[1] == 0 else lines[end[0]][2][::-1]
            points += more[1:] if points and points[-1] == more[0] else more
            end = mate.get((end[0], 1 - end[1]))
            if end is None:
                break
        if len(points) > 1:
            out.append((points, closed))
    return out


def rings(skeleton: np.ndarray) -> list[list[complex]]:
    """Components without ends and junctions: their pixels in the order of a walk around, the first one again at the end."""
    whole, out = label(skeleton, diagonal=True), []
    odd = (sum(v.astype(np.int64) for v in ring(skeleton)) == 1) | (branches(skeleton) >= 3)
    for k in range(1, int(whole.max(initial=0)) + 1):
        mine = whole == k
        if (mine & odd).any() or mine.sum() < 4:
            continue
        left = {(int(y), int(x)) for y, x in zip(*np.nonzero(mine))}
        path = [min(left)]
        left.discard(path[0])
        ahead = 0j
        while True:
            y, x = path[-1]
            ways = [(y + a, x + b) for a, b in NEAR if (y + a, x + b) in left]
            if not ways:
                break
            on = min(ways, key=lambda q: turn(ahead, complex(q[1] - x, q[0] - y)) if ahead else 0)  # noqa: B023
            ahead = complex(on[1] - x, on[0] - y)
            path.append(on)
            left.discard(on)
        out.append([complex(x, y) for y, x in [*path, path[0]]])
    return out


def off(points: list[complex]) -> np.ndarray:
    """Distances of points from the segment between the first and the last."""
    p, a, b = np.array(points), points[0], points[-1]
    if a == b:
        return np.abs(p - a)
    t = np.clip(((p - a) * np.conj(b - a)).real / abs(b - a) ** 2, 0, 1)
    return np.abs(p - a - t * (b - a))


def simplified(points: list[complex], tolerance: float) -> list[complex]:
    """The points that a line through them needs to stay within a distance of all."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = off(points[a : b + 1])[1:-1]
        k = int(d.argmax())
        if d[k] > tolerance:
            keep.add(m := a + 1 + k)
            todo += [(a, m), (m, b)]
    return [points[i] for i in sorted(keep)]


def at_corners(points: list[complex], closed: bool) -> list[list[complex]]:
    """Runs between corners (turns over 60 degrees), each beginning where the one before ends; a closed line with corners begins at its first one."""
    if closed:
        base = points[:-1]
        sharp = [i for i in range(len(base)) if turn(base[i] - base[i - 1], base[(i + 1) % len(base)] - base[i]) > CORNER]
        if not sharp:
            return [points]
        points = base[sharp[0] :] + base[: sharp[0]] + [base[sharp[0]]]
    cuts = [0, *[i for i in range(1, len(points) - 1) if turn(points[i] - points[i - 1], points[i + 1] - points[i]) > CORNER], len(points) - 1]
    return [points[a : b + 1] for a, b in zip(cuts, cuts[1:])]


def weights(u: np.ndarray) -> np.ndarray:
    """The four weights of a cubic's points at each parameter."""
    v = 1 - u
    return np.stack([v**3, 3 * u * v**2, 3 * u**2 * v, u**3])


def least_squares(p: np.ndarray, u: np.ndarray, left: complex, right: complex) -> np.ndarray:
    """The cubic from the first point to the last with given directions at its ends that is nearest to all points; handles that have no positive length,
    or one over the points' own length, are a third of the chord."""
    w = weights(u)
    rest = p - (w[0] + w[1]) * p[0] - (w[2] + w[3]) * p[-1]
    cols = np.stack([w[1] * left, w[2] * right])
    dot = lambda a, b: float((a * np.conj(b)).real.sum())
    m = np.array([[dot(a, b) for b in cols] for a in cols])
    det = m[0, 0] * m[1, 1] - m[0, 1] ** 2
    handles = np.linalg.solve(m, [dot(c, rest) for c in cols]) if abs(det) > 1e-12 else np.zeros(2)
    chord, arc = abs(p[-1] - p[0]), float(np.abs(np.diff(p)).sum())
    tiny = 1e-6 * (chord or arc)
    if not np.isfinite(handles).all() or (handles < tiny).any() or (handles > arc).any():
        handles = np.full(2, (chord if chord > tiny else arc) / 3)
    return np.array([p[0], p[0] + left * handles[0], p[-1] + right * handles[1], p[-1]])


def nearer(c: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Parameters after one step towards the nearest points of the curve."""
    d1, d2 = 3 * np.diff(c), 6 * np.diff(c, 2)
    gap, v = c @ weights(u) - p, 1 - u
    one, two = d1[0] * v**2 + 2 * d1[1] * u * v + d1[2] * u**2, d2[0] * v + d2[1] * u
    below = np.abs(one) ** 2 + (gap * np.conj(two)).real
    return np.where(below == 0, u, u - (gap * np.conj(one)).real / np.where(below == 0, 1, below))


def cubics(points: list[complex], tolerance: float) -> list[np.ndarray]:
    """Cubics through a run of points, none further than the tolerance from them: one where that is enough, else parted at the point furthest off."""
    p = np.array([b for a, b in zip([None, *points], points) if a is None or abs(b - a) > 1e-9])
    if len(p) < 2:
        return []
    unit = lambda z: z / (abs(z) or 1)
    out, todo = [], [(p, unit(p[1] - p[0]), unit(p[-2] - p[-1]))]
    while todo:
        q, left, right = todo.pop()
        if len(q) == 2:
            third = abs(q[1] - q[0]) / 3
            out.append(np.array([q[0], q[0] + left * third, q[1] + right * third, q[1]]))
            continue
        u = np.concatenate([[0.0], np.cumsum(np.abs(np.diff(q)))])
        u = u / (u[-1] or 1)
        for attempt in range(21):
            c = least_squares(q, u, left, right)
            gap = np.abs(c @ weights(u) - q) ** 2
            if gap.max() < tolerance**2 or (attempt == 0 and gap.max() >= tolerance**4):
                break
            u = nearer(c, q, u)
        if gap.max() < tolerance**2:
            out.append(c)
            continue
        k = min(max(int(gap.argmax()) if gap.max() > 0 else len(q) // 2, 1), len(q) - 2)
        middle = unit(q[k - 1] - q[k + 1])
        todo += [(q[k:], -middle, right), (q[: k + 1], left, middle)]  # the first part is taken next
    return out


def path_text(points: list[complex], closed: bool, radius: float) -> str:
    """A stroke as path commands: straight runs between corners are lines, others cubics within about half the stroke's radius (0.8 to 1.6)."""
    runs = at_corners(points, closed)
    show = lambda z: f"{z.real:.2f} {z.imag:.2f}"
    out = [f"M {show(runs[0][0])}"]
    for run in runs:
        if len(run) == 2 or (off(run)[1:-1] <= max(0.6, radius * 0.45)).all():
            out.append(f"L {show(run[-1])}")
        else:
            out += [f"C {show(c[1])} {show(c[2])} {show(c[3])}" for c in cubics(run, max(0.8, min(1.6, radius * 0.5)))]
    return " ".join([*out, *["Z"] * closed])


STROKES = "sheet_id long, stroke long, closed boolean, length double, xs array<double>, ys array<double>, path string"


def stroked(batches, spur: float = 2.0, tolerance: float = 0.75):
    """Batches of ``skeleton.SKELETONS`` -> batches of ``STROKES``."""
    names = [c.split()[0] for c in STROKES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string()]
    for part in slices(batches):
        out = []
        for sheet, width, on, steps in zip(*(part.column(c).to_pylist() for c in ("sheet_id", "width", "skeleton", "steps"))):
            mask = np.asarray(on, bool).reshape(-1, int(width))
            far = np.asarray(steps, float).reshape(mask.shape)[mask]
            radius = float(far[np.isfinite(far)].mean()) if np.isfinite(far).any() else 1.0
            found = drawn(mask, max(3.0, spur * radius)) + [(r, True) for r in rings(mask)]
            for k, (points, closed) in enumerate(found):
                slim = simplified(points, tolerance)
                out.append((sheet, k, closed, length(points), [p.real for p in slim], [p.imag for p in slim], path_text(points, closed, radius)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)


def strokes(skeletons: DataFrame, spur: float = 2.0, tolerance: float = 0.75) -> DataFrame:
    """Rows of ``skeleton.skeletons`` -> their strokes: points after simplification, and path text.  The mean distance of a skeleton's pixels from the
    background is its radius; spurs are shorter than ``spur`` radii (3 pixels at least)."""
    return skeletons.select("sheet_id", "width", "skeleton", "steps").mapInArrow(lambda it: stroked(it, spur, tolerance), STROKES)


def strokes_of(rasters: DataFrame) -> DataFrame:
    """The strokes of the skeletons of rasters, in one step: the skeletons, many times the rasters, stay in the worker, a few sheets at a time."""
    return rasters.select("sheet_id", "ink", "width").mapInArrow(lambda it: stroked(skeletonised(it)), STROKES)
