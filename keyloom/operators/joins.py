"""Joins against a side that is expected, but not trusted, to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side up to this many bytes is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame's rows as text, measured by one aggregation."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    total = df.agg(F.sum(row.cast("bigint")).alias("bytes")).first()["bytes"]
    return int(total or 0)


def _can_hash(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.VariantType, T.MapType)):
        return False
    if isinstance(data_type, T.ArrayType):
        return _can_hash(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_can_hash(f.dataType) for f in data_type.fields)
    return True


def size_checked_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join that broadcasts ``small`` only after measuring it; see :func:`sized_join`."""
    return sized_join(big, small, on, how, measured_bytes(small) <= max_bytes)


def sized_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    fits: bool,
    salts: int = SALTS,
) -> DataFrame:
    """Broadcast join where ``small`` is known to fit, else a salted shuffle join.

    When it fits the big side is not shuffled at all. Else both sides are shuffled on the keys
    plus a salt: each small row is repeated once per salt and each big row takes one, so a key
    that holds a third of the big side is spread over ``salts`` tasks. The salt is a hash of the
    row, so a recomputed task assigns the same one. ``how`` may be inner, left, left_semi or
    left_anti, for which the two ways return the same rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    if fits:
        return big.join(F.broadcast(small), on, how)
    hashable = [f.name for f in big.schema.fields if _can_hash(f.dataType)]
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted_small = small.withColumn("_salt", every_salt)
    return salted_big.join(salted_small, [*on, "_salt"], how).drop("_salt")
