"""Vectors, quaternions (x, y, z, w) and row-major matrices as ARRAY<DOUBLE> column expressions. All JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(*parts) -> Column:
    return F.array(*[(F.lit(float(p)) if isinstance(p, int | float) else p).cast("double") for p in parts])


def dot(a: Column, b: Column, n: int = 3) -> Column:
    out = a[0] * b[0]
    for i in range(1, n):
        out = out + a[i] * b[i]
    return out


def norm(a: Column, n: int = 3) -> Column:
    return F.sqrt(dot(a, a, n))


def sub(a: Column, b: Column, n: int = 3) -> Column:
    return F.array(*[a[i] - b[i] for i in range(n)])


def add(a: Column, b: Column, n: int = 3) -> Column:
    return F.array(*[a[i] + b[i] for i in range(n)])


def scaled(a: Column, k: Column, n: int = 3) -> Column:
    return F.array(*[a[i] * k for i in range(n)])


def distance(a: Column, b: Column, n: int = 3) -> Column:
    return norm(sub(a, b, n), n)


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def quaternion(a: Column) -> Column:
    """Normalised; a norm of 1e-12 or less is an error."""
    n = norm(a, 4)
    return F.when(n > 1e-12, F.array(*[a[i] / n for i in range(4)])).otherwise(F.raise_error(F.lit("quaternion norm is zero")).cast("array<double>"))


def conjugate(q: Column) -> Column:
    return F.array(-q[0], -q[1], -q[2], q[3])


def multiply(a: Column, b: Column) -> Column:
    """Product of two unit quaternions."""
    return F.array(
        a[3] * b[0] + a[0] * b[3] + a[1] * b[2] - a[2] * b[1],
        a[3] * b[1] - a[0] * b[2] + a[1] * b[3] + a[2] * b[0],
        a[3] * b[2] + a[0] * b[1] - a[1] * b[0] + a[2] * b[3],
        a[3] * b[3] - a[0] * b[0] - a[1] * b[1] - a[2] * b[2],
    )


def angle(a: Column, b: Column) -> Column:
    """Angle between two rotations, the same for q and -q."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b, 4))))


def rotate(q: Column, v: Column) -> Column:
    """v turned by q: v + w t + u x t with t = 2 u x v."""
    t = cross(q, v)
    t = F.array(*[2 * t[i] for i in range(3)])
    c = cross(q, t)
    return F.array(*[v[i] + q[3] * t[i] + c[i] for i in range(3)])


def relative_position(reference_p: Column, reference_q: Column, p: Column) -> Column:
    """p in the reference's frame."""
    return rotate(conjugate(reference_q), sub(p, reference_p))


def relative_rotation(reference_q: Column, q: Column) -> Column:
    return multiply(conjugate(reference_q), q)


def matmul4(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)])


def inverse_rigid(m: Column) -> Column:
    r = [[m[4 * j + i] for j in range(3)] for i in range(3)]
    t = [-(r[i][0] * m[3] + r[i][1] * m[7] + r[i][2] * m[11]) for i in range(3)]
    return vec(*r[0], t[0], *r[1], t[1], *r[2], t[2], 0, 0, 0, 1)


def transform_point(m: Column, p: Column) -> Column:
    return F.array(*[m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3)])


def rpy_matrix(xyz: Column, rpy: Column) -> Column:
    """Origin of fixed-axis roll, pitch, yaw: Rz(yaw) Ry(pitch) Rx(roll)."""
    (sr, sp, sy), (cr, cp, cy) = ([f(rpy[i]) for i in range(3)] for f in (F.sin, F.cos))
    return vec(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, xyz[0], sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, xyz[1], -sp, cp * sr, cp * cr, xyz[2], 0, 0, 0, 1)


def axis_angle_matrix(axis: Column, theta: Column) -> Column:
    """Rotation about a unit axis."""
    x, y, z = axis[0], axis[1], axis[2]
    c, s = F.cos(theta), F.sin(theta)
    k = 1 - c
    return vec(c + x * x * k, x * y * k - z * s, x * z * k + y * s, 0, y * x * k + z * s, c + y * y * k, y * z * k - x * s, 0, z * x * k - y * s, z * y * k + x * s, c + z * z * k, 0, 0, 0, 0, 1)


def translation_matrix(v: Column) -> Column:
    return vec(1, 0, 0, v[0], 0, 1, 0, v[1], 0, 0, 1, v[2], 0, 0, 0, 1)


def matrix_quaternion(m: Column) -> Column:
    """Quaternion of a rotation matrix, by its largest diagonal part; w >= 0."""
    a = lambda i, j: m[4 * i + j]
    t = a(0, 0) + a(1, 1) + a(2, 2)

    def of(s: Column, parts) -> Column:
        return F.array(*[p(s) for p in parts])

    s0 = F.sqrt(t + 1) * 2
    s1 = F.sqrt(F.greatest(F.lit(0.0), 1 + a(0, 0) - a(1, 1) - a(2, 2))) * 2
    s2 = F.sqrt(F.greatest(F.lit(0.0), 1 + a(1, 1) - a(0, 0) - a(2, 2))) * 2
    s3 = F.sqrt(F.greatest(F.lit(0.0), 1 + a(2, 2) - a(0, 0) - a(1, 1))) * 2
    q = (
        F.when(t > 0, F.array((a(2, 1) - a(1, 2)) / s0, (a(0, 2) - a(2, 0)) / s0, (a(1, 0) - a(0, 1)) / s0, s0 / 4))
        .when((a(0, 0) > a(1, 1)) & (a(0, 0) > a(2, 2)), F.array(s1 / 4, (a(0, 1) + a(1, 0)) / s1, (a(0, 2) + a(2, 0)) / s1, (a(2, 1) - a(1, 2)) / s1))
        .when(a(1, 1) > a(2, 2), F.array((a(0, 1) + a(1, 0)) / s2, s2 / 4, (a(1, 2) + a(2, 1)) / s2, (a(0, 2) - a(2, 0)) / s2))
        .otherwise(F.array((a(0, 2) + a(2, 0)) / s3, (a(1, 2) + a(2, 1)) / s3, s3 / 4, (a(1, 0) - a(0, 1)) / s3))
    )
    return F.transform(q, lambda x: F.when(q[3] < 0, -x).otherwise(x))


def segment_distance(p: Column, a: Column, b: Column, n: int = 2) -> Column:
    """Distance of a point from a segment, by the clamped projection."""
    d = sub(b, a, n)
    length = dot(d, d, n)
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(sub(p, a, n), d, n) / length))).otherwise(F.lit(0.0))
    return distance(p, F.array(*[a[i] + t * d[i] for i in range(n)]), n)


def polyline_distance(p: Column, line: list[list[float]]) -> Column:
    """Least distance in the plane from a point to a polyline of literals."""
    parts = [segment_distance(p, vec(*a), vec(*b)) for a, b in zip(line, line[1:], strict=False)] or [distance(p, vec(*line[0]), 2)]
    return F.least(*parts) if len(parts) > 1 else parts[0]


def box_gap_squared(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Squared distance between two boxes; 0 where they touch."""
    out = F.lit(0.0)
    for i in range(3):
        gap = F.greatest(F.lit(0.0), lo_a[i] - hi_b[i], lo_b[i] - hi_a[i])
        out = out + gap * gap
    return out


def wrapped_delta(a: Column, b: Column) -> Column:
    """a - b on the circle, in [-pi, pi)."""
    return F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi


def degrees_between(a: Column, b: Column) -> Column:
    """Angle in degrees between two unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def rotation_delta(a: Column, b: Column) -> tuple[Column, Column]:
    """Axis and angle (0 to pi) of the rotation from a to b, unit quaternions; the axis is null where nothing turns."""
    q = multiply(conjugate(a), b)
    sign = F.when(q[3] < 0, -1.0).otherwise(1.0)
    size = norm(q)
    return F.when(size > 1e-12, F.array(*[sign * q[i] / size for i in range(3)])), 2 * F.atan2(size, F.abs(q[3]))


#: Views of a drawing: the axes that go right, up and towards the viewer.
VIEWS = {
    "front": ((0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)),
    "side": ((-1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0)),
    "top": ((0.0, 1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.0, 1.0)),
    "isometric": ((-(0.5**0.5), 0.5**0.5, 0.0), (-(6**-0.5), -(6**-0.5), 2 * 6**-0.5), (3**-0.5, 3**-0.5, 3**-0.5)),
}


def projections(p: Column) -> Column:
    """An array of (view, u, v, depth) of a point."""
    return F.array(*[F.struct(F.lit(n).alias("view"), *[dot(p, vec(*axis)).alias(c) for c, axis in zip(("u", "v", "depth"), axes, strict=True)]) for n, axes in VIEWS.items()])


def configuration_distance(a: Column, b: Column, scales: list[float], periodic: list[bool]) -> Column:
    """Root of the summed squares of scaled differences; periodic coordinates differ around the circle."""
    parts = []
    for i, (s, turn) in enumerate(zip(scales, periodic, strict=True)):
        d = wrapped_delta(a[i], b[i]) if turn else a[i] - b[i]
        parts.append((d / s) * (d / s))
    return F.sqrt(sum(parts[1:], parts[0]))


def symmetric_eigenvalues(m: Column) -> Column:
    """Eigenvalues, least first, of a symmetric 3 x 3 matrix given as (xx, xy, xz, yy, yz, zz), in closed form."""
    xx, xy, xz, yy, yz, zz = (m[i] for i in range(6))
    mean = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    spread = F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2 * off) / 6)
    a, b, c = (xx - mean) / spread, (yy - mean) / spread, (zz - mean) / spread
    u, v, w = xy / spread, xz / spread, yz / spread
    half = (a * (b * c - w * w) - u * (u * c - w * v) + v * (u * w - b * v)) / 2
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    top, low = mean + 2 * spread * F.cos(turn), mean + 2 * spread * F.cos(turn + 2 * math.pi / 3)
    return F.when(spread > 0, F.array(low, 3 * mean - top - low, top)).otherwise(F.array(mean, mean, mean))


def inertia_state(mass: Column, m: Column, tolerance: float = 1e-9) -> Column:
    """valid, missing, bad_mass, not_finite, not_positive (an eigenvalue below 0) or triangle (the greatest over the sum of the others)."""
    e = symmetric_eigenvalues(m)
    slack = tolerance * F.greatest(F.lit(1.0), F.abs(e[2]))
    bad = F.exists(m, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(mass.isNull() | m.isNull(), "missing").when(~(mass > 0), "bad_mass").when(bad, "not_finite").when(e[0] < -slack, "not_positive").when(e[2] > e[0] + e[1] + slack, "triangle").otherwise("valid")


def constraint_residuals(kind: Column, a: Column, b: Column, axis_a: Column, axis_b: Column, target: Column) -> Column:
    """Residuals of a constraint between two frames: point_distance (1), fixed (6), revolute (5) or prismatic (5); null for another kind.

    Of the second frame in the first: its origin, the rotation's vector, and how far its axis leans from the first's along two
    directions square to that.
    """
    return let(inverse_rigid(a), lambda i: let(matmul4(i, b), lambda m: _residuals(kind, m, axis_a, axis_b, target)))


def let(value: Column, f) -> Column:
    """f of a value that is computed once and named, so that an expression stays as long as it is written."""
    return F.transform(F.array(value), f)[0]


def _residuals(kind: Column, m: Column, axis_a: Column, axis_b: Column, target: Column) -> Column:
    t = F.array(m[3], m[7], m[11])

    def log(q: Column) -> Column:
        size = norm(q)
        return F.array(*[F.when(size > 1e-12, q[i] / size * 2 * F.atan2(size, q[3])).otherwise(0.0) for i in range(3)])

    turned = let(matrix_quaternion(m), log)
    other = F.array(*[m[4 * i] * axis_b[0] + m[4 * i + 1] * axis_b[1] + m[4 * i + 2] * axis_b[2] for i in range(3)])
    pick = F.when(F.abs(axis_a[0]) < 0.9, vec(1, 0, 0)).otherwise(vec(0, 1, 0))

    def along(v: Column) -> Column:
        """v along two directions square to the first axis."""
        first = lambda raw: scaled(raw, 1 / norm(raw))
        return let(pick, lambda p: let(cross(axis_a, p), lambda raw: let(first(raw), lambda u: F.array(dot(v, u), dot(v, cross(axis_a, u))))))

    lean = let(other, lambda o: along(cross(axis_a, o)))
    return F.when(kind == "point_distance", F.array(norm(t) - target)).when(kind == "fixed", F.concat(t, turned)).when(kind == "revolute", F.concat(t, lean)).when(kind == "prismatic", F.concat(along(t), turned))
