"""Join helpers: broadcast only behind a measured size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A broadcast side is shipped to every executor and held in memory there.
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) of a small side, measured by one aggregate
    (string / binary payload + 16 bytes per other field)."""
    parts = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)))
        else:
            parts.append(F.lit(16))
    width = sum(parts[1:], parts[0]) if parts else F.lit(0)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def checked_broadcast(df: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Return ``broadcast(df)`` when its measured size is within the bound,
    else ``df`` unchanged (a shuffle join; AQE may still convert it).

    ``df`` should be materialised first (``cut_lineage``) so the measurement
    does not recompute its whole lineage."""
    _, nbytes = measured_size(df)
    return F.broadcast(df) if nbytes <= max_bytes else df


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], spread_by: str, salts: int = 16) -> DataFrame:
    """Left join of many ``rows`` with a ``table`` that has one row for each key, at any size of either: a table whose measured
    size is within the bound is broadcast, so the rows stay where they are; else the rows of a key
    go to ``salts`` tasks by a hash of ``spread_by``, the table's row to each of them.  A null key finds nothing.

    ``table`` should be materialised first, so that the measurement does not recompute its lineage."""
    if measured_size(table)[1] <= DEFAULT_MAX_BROADCAST_BYTES:
        return rows.join(F.broadcast(table), keys, "left")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
