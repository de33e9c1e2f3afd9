"""Element kinds of unstructured meshes and their local numbering."""

from __future__ import annotations

from typing import NamedTuple


class Kind(NamedTuple):
    name: str
    nodes: int
    faces: tuple[tuple[int, ...], ...]
    low_degree: int
    high_degree: int


# Local node numbers of faces and edges, and the degree limits of each kind.
EDGE = Kind("edge", 2, (), 2, 8)
TRIANGLE = Kind("triangle", 3, ((0, 1, 2),), 8, 32)
QUAD = Kind("quad", 4, ((0, 1, 2, 3),), 4, 16)
TET = Kind("tet", 4, ((1, 2, 3), (2, 0, 3), (3, 0, 1), (0, 2, 1)), 32, 128)
PYRAMID = Kind("pyramid", 5, ((0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4), (3, 2, 1, 0)), 16, 64)
PRISM = Kind("prism", 6, ((0, 2, 1), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (3, 5, 2, 0)), 16, 64)
HEX = Kind("hex", 8, ((0, 4, 7, 3), (1, 2, 6, 5), (0, 1, 5, 4), (3, 7, 6, 2), (0, 3, 2, 1), (4, 5, 6, 7)), 8, 32)
QUADRATIC = {"edge2": 3, "triangle2": 6, "quad2": 9, "tet2": 10, "pyramid2": 14, "prism2": 18, "hex2": 27}
KINDS = {k.name: k for k in (EDGE, TRIANGLE, QUAD, TET, PYRAMID, PRISM, HEX)}
#: Volume kinds in the order of their global ids.
VOLUMES = (TET, PYRAMID, PRISM, HEX)
FACE_KINDS = (TRIANGLE, QUAD)
TET_EDGES = ((0, 1), (1, 2), (2, 0), (3, 0), (3, 1), (3, 2))
#: Upper bounds of the degree buckets of matrix slices, the last one open.
SLICES = (16, 32, 64, 128)
