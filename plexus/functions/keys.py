"""Integer hash keys as column expressions; every random choice of the engine is one of these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sampling key.
SRC_FACTOR = 1103515245
DST_FACTOR = 214013
STEP_FACTOR = 69069
SEED_FACTOR = 2654435761
OFFSET = 12345
MODULUS = 2147483648


def _low(x: Column) -> Column:
    """Reduced before it is multiplied, so that no identifier overflows; the key is the same."""
    return F.pmod(x, F.lit(MODULUS))


def edge_key(src: Column, dst: Column, seed: int) -> Column:
    return F.pmod(_low(src) * SRC_FACTOR + _low(dst) * DST_FACTOR + F.lit(seed * SEED_FACTOR + OFFSET), F.lit(MODULUS))


def walk_key(start: Column, walk: Column, step: int, seed: int) -> Column:
    return F.pmod(_low(start) * SRC_FACTOR + _low(walk) * DST_FACTOR + F.lit(step * STEP_FACTOR + seed * SEED_FACTOR + OFFSET), F.lit(MODULUS))


def node_key(node: Column, seed: int = 0) -> Column:
    return F.pmod(_low(node) * SRC_FACTOR + F.lit(seed * SEED_FACTOR + OFFSET), F.lit(MODULUS))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def argmax0(v: Column | str) -> Column:
    """Position from 0 of the largest element, the first one on ties."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("bigint")
