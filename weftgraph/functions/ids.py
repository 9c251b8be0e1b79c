"""Vertex ids that are unique over all labels.

Raw ids are unique within a leaf label only. In edge tables an id carries its leaf label's ordinal
above 40 bits, so that joins and inequalities over super-labels compare vertices and not numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW_BITS = 40
LARGEST_RAW = (1 << RAW_BITS) - 1


def global_id(ordinal: int, raw: Column) -> Column:
    """A raw id (0 to 2**40 - 1) of a leaf label as a global id; others raise when evaluated."""
    raw = raw.cast("long")
    fits = (raw >= 0) & (raw <= LARGEST_RAW)
    packed = raw.bitwiseOR(F.lit(ordinal << RAW_BITS))
    return F.when(fits, packed).when(raw.isNotNull(), F.raise_error(F.concat(F.lit("vertex id out of range: "), raw.cast("string"))).cast("long"))


def raw_id(gid: Column) -> Column:
    return gid.bitwiseAND(F.lit(LARGEST_RAW))


def label_of(gid: Column, leaves: list[str]) -> Column:
    """The leaf label of a global id; leaves are in order of their ordinals."""
    return F.element_at(F.array(*[F.lit(x) for x in leaves]), (F.shiftright(gid, RAW_BITS) + 1).cast("int"))
