"""Path text: absolute M, L, C, Q and Z commands as an array of (cmd, args), moved and measured by column expressions, and back to text.

Arguments are x and y in turn.  Text comes out with one space between all parts and numbers of three decimals at most.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?"
#: A command's letter (e belongs to numbers) and all up to the next.
COMMAND = r"[A-DF-Za-df-z][^A-DF-Za-df-z]*"


def parsed(text: Column) -> Column:
    """array<struct<cmd, args>>; null for null, empty for a text without commands."""
    args = lambda c: F.transform(F.regexp_extract_all(c, F.lit(NUMBER), 0), lambda v: v.cast("double"))
    return F.transform(F.regexp_extract_all(text, F.lit(COMMAND), 0), lambda c: F.struct(F.substring(c, 1, 1).alias("cmd"), args(c).alias("args")))


def number(v: Column) -> Column:
    """A number as text: at most three decimals, none for whole ones."""
    r = F.floor(v * 1000 + 0.5) / 1000
    return F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(r.cast("string"))


def text(path: Column) -> Column:
    """The path as text."""
    return F.array_join(F.transform(path, lambda c: F.concat_ws(" ", c["cmd"], F.transform(c["args"], number))), " ")


def moved(path: Column, x=None, y=None) -> Column:
    """The path with new coordinates: ``x`` of an x, ``y`` of a pair (x, y); the other coordinate stays."""

    def one(args):
        def at(v, i):
            even = i % 2 == 0
            new = v
            if x:
                new = F.when(even, x(v)).otherwise(new)
            if y:
                new = F.when(even, new).otherwise(y(F.get(args, i - 1), v))
            return new

        return F.transform(args, at)

    return F.transform(path, lambda c: F.struct(c["cmd"].alias("cmd"), one(c["args"]).alias("args")))


def translated(path: Column, dx) -> Column:
    return moved(path, x=lambda v: v + dx)


def scaled(path: Column, sx, tx) -> Column:
    return moved(path, x=lambda v: v * sx + tx)


def tail_shortened(path: Column, edge, scale, side: str) -> Column:
    """x beyond an edge (left or right of it) drawn towards it."""
    beyond = (lambda v: v < edge) if side == "left" else (lambda v: v > edge)
    return moved(path, x=lambda v: F.when(beyond(v), edge + (v - edge) * scale).otherwise(v))


def tail_lowered(path: Column, edge, tip, dy, side: str) -> Column:
    """y beyond an edge moved by a part of dy that grows from 0 at the edge to all of it at the tip."""
    beyond = (lambda v: v < edge) if side == "left" else (lambda v: v > edge)
    ramp = lambda v: F.when(beyond(v), F.least(F.greatest((v - edge) / F.nullif(F.lit(tip) - F.lit(edge), F.lit(0)), F.lit(0.0)), F.lit(1.0)))
    return moved(path, y=lambda a, v: v + F.coalesce(ramp(a), F.lit(0.0)) * dy)


def every(path: Column, parity: int) -> Column:
    """All x (0) or all y (1)."""
    return F.flatten(F.transform(path, lambda c: F.filter(c["args"], lambda _, i: i % 2 == parity)))


def box(path: Column) -> Column:
    """The smallest and largest coordinates, of control points too; nulls without any."""
    x, y = every(path, 0), every(path, 1)
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def turn(path: Column) -> Column:
    """The sign of the area that the first outline's points go around (control points are points); 0 for fewer than three."""
    starts = F.transform(path, lambda c: c["cmd"] == "M")
    second = F.array_position(F.slice(starts, F.array_position(starts, True).cast("int") + 1, F.size(starts)), True)
    first = F.slice(path, F.greatest(F.array_position(starts, True), F.lit(1)).cast("int"), F.when(second > 0, second).otherwise(F.size(path)).cast("int"))
    ring = F.arrays_zip(every(first, 0).alias("x"), every(first, 1).alias("y"))
    cross = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(ring) < 3, 0).otherwise(F.signum(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v))).cast("int")
