"""Scalar functions on columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def round_away(x) -> Column:
    """Nearest integer, halves away from zero."""
    return F.round(_c(x), 0).cast("long")


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(_c(x), _c(low)), _c(high))


def sub2ind(size: Sequence[int], y, x, z) -> Column:
    """1-based linear index, first axis fastest."""
    return _c(y) + (_c(x) - 1) * size[0] + (_c(z) - 1) * (size[0] * size[1])


def ind2sub(size: Sequence[int], index) -> list[Column]:
    i = _c(index) - 1
    return [F.pmod(i, F.lit(size[0])) + 1, F.pmod(F.floor(i / size[0]), F.lit(size[1])) + 1, F.floor(i / (size[0] * size[1])) + 1]


def circ_dist(a, b) -> Column:
    """Difference of angles in (-pi, pi]."""
    d = _c(a) - _c(b)
    return F.atan2(F.sin(d), F.cos(d))


def equiv_diameter(n, voxel_volume: float = 1.0) -> Column:
    """Diameter of the ball with the volume of n voxels."""
    return F.cbrt(_c(n) * voxel_volume * 6 / math.pi)


def equiv_radius(n, voxel_volume: float = 1.0) -> Column:
    return F.cbrt(_c(n) * voxel_volume * 3 / (4 * math.pi))


def euler_angles(r: Sequence[Sequence]) -> list[Column]:
    """x, y, z rotation in degrees of a 3 x 3 rotation of columns; at the gimbal lock z is 0."""
    sine = F.sqrt(_c(r[0][0]) ** 2 + _c(r[1][0]) ** 2)
    lock = sine < 1e-6
    x = F.when(lock, F.atan2(-_c(r[1][2]), _c(r[1][1]))).otherwise(F.atan2(_c(r[2][1]), _c(r[2][2])))
    y = F.atan2(-_c(r[2][0]), sine)
    z = F.when(lock, F.lit(0.0)).otherwise(F.atan2(_c(r[1][0]), _c(r[0][0])))
    return [F.degrees(v) for v in (x, y, z)]


def axis_angle(r: Sequence[Sequence]) -> Column:
    """struct(x, y, z, angle) of a rotation; the axis is (1, 0, 0) for angle 0 and
    comes from the diagonal at a half turn."""
    c = clamp((_c(r[0][0]) + _c(r[1][1]) + _c(r[2][2]) - 1) / 2, -1.0, 1.0)
    angle = F.acos(c)
    s = 2 * F.sin(angle)
    plain = [(_c(r[2][1]) - _c(r[1][2])) / s, (_c(r[0][2]) - _c(r[2][0])) / s, (_c(r[1][0]) - _c(r[0][1])) / s]
    root = [F.sqrt(F.greatest((_c(r[i][i]) + 1) / 2, F.lit(0.0))) for i in range(3)]
    # Signs at a half turn: the largest part is positive, the others follow its row.
    sign = lambda v: F.when(v < 0, -1.0).otherwise(1.0)
    first = (root[0] >= root[1]) & (root[0] >= root[2])
    second = ~first & (root[1] >= root[2])
    half = [
        F.when(first, root[0]).when(second, root[0] * sign(_c(r[0][1]))).otherwise(root[0] * sign(_c(r[0][2]))),
        F.when(first, root[1] * sign(_c(r[0][1]))).when(second, root[1]).otherwise(root[1] * sign(_c(r[1][2]))),
        F.when(first, root[2] * sign(_c(r[0][2]))).when(second, root[2] * sign(_c(r[1][2]))).otherwise(root[2]),
    ]
    axis = [F.when(angle < 1e-9, F.lit(1.0 if i == 0 else 0.0)).when(angle > math.pi - 1e-6, half[i]).otherwise(plain[i]) for i in range(3)]
    return F.struct(axis[0].alias("x"), axis[1].alias("y"), axis[2].alias("z"), angle.alias("angle"))


def rigid_3d_to_2d(r: Sequence[Sequence], t: Sequence) -> Column:
    """Row-major 2-D rigid matrix from a 3-D one that turns about the third axis, with the angle's sign turned."""
    a = -F.atan2(_c(r[1][0]), _c(r[0][0]))
    return F.array(F.cos(a), -F.sin(a), _c(t[0]), F.sin(a), F.cos(a), _c(t[1]), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def matmul(a, b, n: int = 4) -> Column:
    """Product of two row-major n x n matrices held as arrays."""
    a, b = _c(a), _c(b)
    cell = lambda i, j: sum((F.get(a, F.lit(i * n + k)) * F.get(b, F.lit(k * n + j)) for k in range(n)), F.lit(0.0))
    return F.array(*(cell(i, j) for i in range(n) for j in range(n)))


def plane_basis(nx, ny, nz) -> list[Column]:
    """Two unit vectors across a unit normal: the helper axis is x, or y where the normal is close to x."""
    n = [_c(nx), _c(ny), _c(nz)]
    close = F.abs(n[0]) > 0.9
    h = [F.when(close, 0.0).otherwise(1.0), F.when(close, 1.0).otherwise(0.0), F.lit(0.0)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    u = cross(n, h)
    length = F.sqrt(u[0] ** 2 + u[1] ** 2 + u[2] ** 2)
    u = [x / length for x in u]
    return [*u, *cross(n, u)]


def plain_name(name) -> Column:
    """Lower case, commas out, underscores as spaces."""
    return F.translate(F.lower(_c(name)), "_,", " ")


def channel_number(file) -> Column:
    """The number in chan_<n>_ of a file name, null without one."""
    found = F.regexp_extract(_c(file), r"chan_?(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def channel_name(file) -> Column:
    """The name in chan<n>_<name>.tif(f), null without one."""
    found = F.regexp_extract(_c(file), r"^chan\d+_(.+)\.tiff?$", 1)
    return F.when(found != "", found)


def rotation_from_mean_normal(x, y, z) -> Column:
    """Row-major 3 x 3 rotation (an array) from the mean (x, y, z) of slice normals as
    they are saved, pointing back along the first axis: the mean is turned round and
    scaled to length 1, the first axis turned onto it, axes then put in the order
    third, first, second and the matrix transposed. Normals along the axis give the
    identity or its negative."""
    length = F.sqrt(_c(x) ** 2 + _c(y) ** 2 + _c(z) ** 2)
    a, b, c = (-_c(v) / length for v in (x, y, z))
    across = F.sqrt(b**2 + c**2)
    # The turn about (0, -c, b) / across by the angle whose cosine is a and sine is across.
    k = F.when(across > 1e-6, (1 - a) / across**2)
    turn = [[a, -b, -c], [b, a + k * c**2, -k * b * c], [c, -k * b * c, a + k * b**2]]
    order = (2, 0, 1)
    plain = lambda i, j: F.when(across > 1e-6, turn[order[j]][order[i]]).otherwise(a if i == j else F.lit(0.0))
    return F.array(*(plain(i, j) for i in range(3) for j in range(3)))


def channel_file(channel, kind: str) -> Column:
    return F.format_string(f"chan%02d_{kind}", _c(channel).cast("int"))


def days_between(later, earlier) -> Column:
    return F.datediff(_c(later), _c(earlier))


def linspace(a: float, b: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: a + i * ((b - a) / max(1, n - 1)))


def cumulative(values) -> Column:
    """Running sums of an array."""
    none = F.struct(F.lit(0.0).alias("t"), F.array().cast("array<double>").alias("all"))
    return F.aggregate(_c(values), none, lambda a, x: F.struct((a["t"] + x).alias("t"), F.concat(a["all"], F.array(a["t"] + x)).alias("all")), lambda a: a["all"])


def differences(values) -> Column:
    """Steps between neighbours of an array; one value fewer."""
    v = _c(values)
    return F.transform(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda x, i: x - F.get(v, i))


def code_of(name, codes: dict[str, int]) -> Column:
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.element_at(F.create_map(*pairs), _c(name))


def scale_between(v, low, high, to_low: float, to_high: float) -> Column:
    """Linear map of [low, high] to [to_low, to_high]; a flat range maps to to_low."""
    low, high = _c(low), _c(high)
    return F.when(high > low, (_c(v) - low) / (high - low) * (to_high - to_low) + to_low).otherwise(F.lit(float(to_low)))
