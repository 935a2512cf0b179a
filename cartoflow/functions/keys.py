"""Integer cell keys and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits and bias of one axis in a packed cell key.
AXIS_BITS, AXIS_BIAS = 21, 1 << 20


def cell(column, size: float) -> Column:
    """The index of the grid cell of a coordinate."""
    return F.floor(F.col(column) / F.lit(float(size))) if isinstance(column, str) else F.floor(column / F.lit(float(size)))


def packed_cell(x, y, z, size: float) -> Column:
    """Three cell indices in one BIGINT: 21 biased bits an axis, x highest."""
    part = [cell(c, size) + F.lit(AXIS_BIAS) for c in (x, y, z)]
    return F.shiftleft(part[0], 2 * AXIS_BITS).bitwiseOR(F.shiftleft(part[1], AXIS_BITS)).bitwiseOR(part[2])


def hash_share(id_column, rate: float) -> Column:
    """Whether a row belongs to a deterministic sample of about ``rate`` of all ids."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.pmod(c * F.lit(2654435761), F.lit(1 << 32)) < F.lit(int(rate * (1 << 32)))


def packed_point_id(submap, point) -> Column:
    return F.shiftleft(F.col(submap).cast("long"), 32).bitwiseOR(F.col(point).cast("long"))


def unpack_point_id(column) -> tuple[Column, Column]:
    c = F.col(column)
    return F.shiftright(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF))
