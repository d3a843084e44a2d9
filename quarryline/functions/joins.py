"""Joins of large tables with tables that are usually small, without relying on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.checkpoints import cut_lineage

#: A table of at most so many bytes (measured on its rows, as UTF-8 and eight bytes for everything else) is broadcast.
BROADCAST_BYTES = 24_000_000
#: Parts into which a hot key of the large side is spread beyond that size; the small side is repeated so many times.
SALTS = 16


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a table's values, by one pass over it."""
    sizes = [F.coalesce(F.octet_length(f.name) if isinstance(f.dataType, T.StringType) else F.octet_length(F.to_json(F.struct(f.name))) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.lit(8), F.lit(0)) for f in df.schema.fields]
    return df.agg(F.sum(sum(sizes, F.lit(0)) + 16)).first()[0] or 0


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str] = (), how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``big`` joined with ``small`` on ``keys``: broadcast if the measured size of ``small`` allows it, else by a shuffle in which hot keys are salted.

    ``small`` is written to the checkpoint folder and measured there, so the choice rests on its real size. ``spread_by`` are columns of ``big`` that few rows share; without them
    keys are taken to be no hotter than a task can hold. The result is the same either way; ``how`` is inner, left, left_semi or left_anti. Null keys match nothing.
    """
    table = cut_lineage(small)
    if measured_bytes(table) <= limit:
        return big.join(F.broadcast(table), list(keys), how)
    if not spread_by:
        return big.join(table, list(keys), how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*keys, "_salt"], how).drop("_salt")
