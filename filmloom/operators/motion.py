"""Codes of motion vectors; the search is in ``pictures``."""

from __future__ import annotations

from pyspark.sql import functions as F


def vector_bits(dx, dy, block: int = 4):
    """Bits of a temporal vector: opcode, family and index, by the ring it lies in."""
    ring = F.greatest(F.abs(dx), F.abs(dy))
    return (F.when(ring <= 1, 5).when(ring == 2, 6).when(ring == 3, 7).otherwise(10) + (2 if block == 4 else 1)).cast("bigint")


def vector_code(order, dx, dy):
    """(value, bits) of a temporal vector: two bits of family, then its place in the family, the lowest bit first.

    ``order`` is that of ``pictures.temporal_vectors``. Ring three shares its family with eight spatial vectors, which come first.
    """
    ring = F.greatest(F.abs(dx), F.abs(dy))
    family = F.when(ring <= 1, 0).when(ring == 2, 2).when(ring == 3, 1).otherwise(3)
    place = order - F.when(ring <= 1, 0).when(ring == 2, 8).when(ring == 3, 24 - 8).otherwise(48)
    return (family + 4 * place).cast("bigint"), (vector_bits(dx, dy) - 2).cast("bigint")


def vector_code_7(order, dx, dy):
    """(value, bits) in the older format, whose order has ring four before ring three in one family of eight bits."""
    ring = F.greatest(F.abs(dx), F.abs(dy))
    family = F.when(ring <= 1, 2).when(ring == 2, 1).otherwise(3)
    place = order - F.when(ring <= 1, 0).when(ring == 2, 8).otherwise(24)
    return (family + 4 * place).cast("bigint"), F.when(ring <= 1, 5).when(ring == 2, 6).otherwise(8).cast("bigint")
