"""Rigid-body algebra as column expressions: poses are seven columns or seven expressions tx ty tz qx qy qz qw."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Pose(NamedTuple):
    tx: Column
    ty: Column
    tz: Column
    qx: Column
    qy: Column
    qz: Column
    qw: Column


def literal(*values: float) -> Pose:
    return Pose(*[F.lit(float(v)) for v in values])


def columns(prefix: str = "") -> Pose:
    return Pose(*[F.col(prefix + n) for n in Pose._fields])


def normalised(p: Pose) -> Pose:
    n = F.sqrt(p.qx * p.qx + p.qy * p.qy + p.qz * p.qz + p.qw * p.qw)
    return p._replace(qx=p.qx / n, qy=p.qy / n, qz=p.qz / n, qw=p.qw / n)


def canonical(p: Pose) -> Pose:
    """The representative of the double cover with qw >= 0."""
    s = F.when(p.qw < 0, -1.0).otherwise(1.0)
    return p._replace(qx=p.qx * s, qy=p.qy * s, qz=p.qz * s, qw=p.qw * s)


def rotate(p: Pose, x, y, z) -> tuple[Column, Column, Column]:
    """R v with the rotation of ``p``."""
    cx = p.qy * z - p.qz * y + p.qw * x
    cy = p.qz * x - p.qx * z + p.qw * y
    cz = p.qx * y - p.qy * x + p.qw * z
    return x + 2 * (p.qy * cz - p.qz * cy), y + 2 * (p.qz * cx - p.qx * cz), z + 2 * (p.qx * cy - p.qy * cx)


def transform(p: Pose, x, y, z) -> tuple[Column, Column, Column]:
    a, b, c = rotate(p, x, y, z)
    return a + p.tx, b + p.ty, c + p.tz


def product(a, b):
    """Quaternion product of (x, y, z, w) tuples."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def compose(a: Pose, b: Pose) -> Pose:
    return Pose(*transform(a, b.tx, b.ty, b.tz), *product(a[3:], b[3:]))


def inverse(p: Pose) -> Pose:
    back = p._replace(qx=-p.qx, qy=-p.qy, qz=-p.qz)
    x, y, z = rotate(back, p.tx, p.ty, p.tz)
    return Pose(-x, -y, -z, back.qx, back.qy, back.qz, p.qw)


def slerp(a: Pose, b: Pose, u) -> Pose:
    """Linear in position, spherical in rotation, along the shorter arc."""
    dot = a.qx * b.qx + a.qy * b.qy + a.qz * b.qz + a.qw * b.qw
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    flat = F.sin(angle) < 1e-9
    wa = F.when(flat, 1 - u).otherwise(F.sin((1 - u) * angle) / F.when(flat, 1.0).otherwise(F.sin(angle)))
    wb = F.when(flat, u).otherwise(F.sin(u * angle) / F.when(flat, 1.0).otherwise(F.sin(angle))) * sign
    turned = [wa * x + wb * y for x, y in zip(a[3:], b[3:], strict=True)]
    return Pose(*[x + (y - x) * u for x, y in zip(a[:3], b[:3], strict=True)], *turned)


def from_rpy(roll_deg: float, pitch_deg: float, yaw_deg: float) -> tuple[float, float, float, float]:
    """Quaternion (x, y, z, w) of Rz(yaw) Ry(pitch) Rx(roll), angles in degrees."""
    r, p, y = (math.radians(v) / 2 for v in (roll_deg, pitch_deg, yaw_deg))
    cr, sr, cp, sp, cy, sy = math.cos(r), math.sin(r), math.cos(p), math.sin(p), math.cos(y), math.sin(y)
    return sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy


def matrix_to_pose(m) -> Pose:
    """Pose of a row-major array of 16 doubles."""
    e = [[m[4 * r + c] for c in range(4)] for r in range(3)]
    qw = F.sqrt(F.greatest(F.lit(0.0), 1 + e[0][0] + e[1][1] + e[2][2])) / 2
    qx = F.sqrt(F.greatest(F.lit(0.0), 1 + e[0][0] - e[1][1] - e[2][2])) / 2 * F.signum(F.when(e[2][1] - e[1][2] < 0, -1.0).otherwise(1.0))
    qy = F.sqrt(F.greatest(F.lit(0.0), 1 - e[0][0] + e[1][1] - e[2][2])) / 2 * F.signum(F.when(e[0][2] - e[2][0] < 0, -1.0).otherwise(1.0))
    qz = F.sqrt(F.greatest(F.lit(0.0), 1 - e[0][0] - e[1][1] + e[2][2])) / 2 * F.signum(F.when(e[1][0] - e[0][1] < 0, -1.0).otherwise(1.0))
    return Pose(e[0][3], e[1][3], e[2][3], qx, qy, qz, qw)


def pose_to_matrix(p: Pose) -> Column:
    """Row-major array of 16 doubles."""
    cx, cy, cz = (rotate(p, *[F.lit(float(i == k)) for i in range(3)]) for k in range(3))
    rows = [[cx[r], cy[r], cz[r], p[r]] for r in range(3)]
    return F.array(*[v for row in rows for v in row], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
