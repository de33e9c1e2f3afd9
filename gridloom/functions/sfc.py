"""Space-filling-curve codes as native column expressions."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column
from pyspark.sql import functions as F

# First rotation and rotation updates of the curves, by geometric octant or quadrant.
START_3D = (0, 3, 7, 4, 1, 2, 6, 5)
TURN_3D = ((0, 7, 6, 1, 2, 5, 4, 3), (0, 3, 4, 7, 6, 5, 2, 1), (0, 3, 4, 7, 6, 5, 2, 1), (2, 3, 0, 1, 6, 7, 4, 5), (2, 3, 0, 1, 6, 7, 4, 5), (6, 5, 2, 1, 0, 3, 4, 7), (6, 5, 2, 1, 0, 3, 4, 7), (4, 3, 2, 5, 6, 1, 0, 7))
START_2D = (1, 2, 0, 3)
TURN_2D = ((0, 3, 2, 1), (0, 1, 2, 3), (0, 1, 2, 3), (2, 1, 0, 3))
OCTREE = (5, 4, 7, 6, 1, 0, 3, 2)
LEVELS_3D, LEVELS_2D = 21, 31


def machine(start: tuple[int, ...], turn: tuple[tuple[int, ...], ...]) -> tuple[list[int], list[int]]:
    """(digits, next states), each indexed by state * arity + octant: the curve as a finite automaton."""
    arity, number, digits, following, queue = len(start), {start: 0}, [], [], deque([start])
    while queue:
        rotation = queue.popleft()
        for octant in range(arity):
            digit = rotation[octant]
            after = tuple(turn[digit][r] for r in rotation)
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            digits.append(digit)
            following.append(number[after])
    return digits, following


def quantised(value: Column, low: Column, high: Column, bits: int, top: int | None = None) -> Column:
    """value as an integer of `bits` bits over [low, high]; a flat axis gives 0, the upper end `top`."""
    cells = float(1 << bits)
    scaled = F.floor((value - low) * (F.lit(cells) / (high - low))).cast("long")
    return F.when(high > low, F.least(scaled, F.lit(top if top is not None else (1 << bits) - 1))).otherwise(F.lit(0)).cast("long")


def chunk_table(digits: list[int], following: list[int], dims: int, levels: int) -> tuple[list[int], list[int]]:
    """The automaton over `levels` levels at once: (digits, next states) by state and the octants one after the other."""
    arity = 1 << dims
    codes, states = [], []
    for first in range(len(digits) // arity):
        for path in range(arity**levels):
            code, state = 0, first
            for level in reversed(range(levels)):
                at = state * arity + (path >> dims * level & arity - 1)
                code, state = code << dims | digits[at], following[at]
            codes.append(code)
            states.append(state)
    return codes, states


def _table(values: list[int]) -> Column:
    """An array literal; one string crosses to the JVM, where the optimiser folds it."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _folded(axes: list[Column], levels: int, digits: list[int], following: list[int]) -> Column:
    """The code of integer coordinates: a few levels a step, each step two lookups, without a loop at run time.

    A state is read by the next step's lookups alone, so the expression grows with the
    square of the steps, of which there are eight at most. Spark computes its repeated parts
    once, unless the code stands in a branch of a condition: put conditions on the coordinates.
    """
    dims = len(axes)
    width = 3 if dims == 3 else 4
    spread = [sum((v >> i & 1) << dims * i for i in range(width)) for v in range(1 << width)]
    at = lambda values, index: F.element_at(_table(values), index.cast("int") + 1)
    code, state, left = F.lit(0).cast("long"), F.lit(0), levels
    while left:
        step = left % width or width
        left -= step
        codes, states = chunk_table(digits, following, dims, step)
        path = F.lit(0)
        for j, axis in enumerate(axes):
            path = path + F.shiftleft(at(spread, F.shiftright(axis, left).bitwiseAND(F.lit((1 << step) - 1))), j)
        index = state * (1 << dims * step) + path
        code = code + F.shiftleft(at(codes, index).cast("long"), dims * left)
        state = at(states, index)
    return code


def hilbert_3d(x: Column, y: Column, z: Column, box: list[Column]) -> Column:
    """63-bit Hilbert code of a point in the box (x0, y0, z0, x1, y1, z1)."""
    axes = [quantised(c, box[j], box[j + 3], LEVELS_3D) for j, c in enumerate((x, y, z))]
    return _folded(axes, LEVELS_3D, *machine(START_3D, TURN_3D))


def hilbert_2d(x: Column, y: Column, box: list[Column]) -> Column:
    """62-bit Hilbert code of a point in the box (x0, y0, x1, y1); the upper end alone sets the first level."""
    axes = [quantised(c, box[j], box[j + 2], LEVELS_2D - 1, 1 << (LEVELS_2D - 1)) for j, c in enumerate((x, y))]
    return _folded(axes, LEVELS_2D, *machine(START_2D, TURN_2D))


def hilbert_pair(a: Column, b: Column) -> Column:
    """2-D Hilbert code of two integers from 0 to 2**31 - 1: the topological code of an element's least and largest node.

    Others have no code of 62 bits; they raise an error when a row with one is read.
    """
    least, largest = F.least(a, b), F.greatest(a, b)
    fits = (least >= 0) & (largest < 1 << LEVELS_2D)
    unfit = F.raise_error(F.lit("a node id does not fit the topological code")).cast("long")
    return _folded([F.when(fits, c.cast("long")).otherwise(unfit) for c in (a, b)], LEVELS_2D, *machine(START_2D, TURN_2D))


def z_curve(x: Column, y: Column, z: Column, box: list[Column]) -> Column:
    """63-bit octree code of a point in the box."""
    axes = [quantised(c, box[j], box[j + 3], LEVELS_3D) for j, c in enumerate((x, y, z))]
    return _folded(axes, LEVELS_3D, list(OCTREE), [0] * 8)


def ref_hash(ref: Column) -> Column:
    """Sum of the four signed bytes of an int, modulo 256."""
    signed = lambda shift: F.shiftright(F.shiftleft(ref.cast("int"), 24 - shift), 24)
    return (signed(0) + signed(8) + signed(16) + signed(24)).bitwiseAND(F.lit(255)).cast("long")
