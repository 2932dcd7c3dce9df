"""Per-key values joined back to rows, safe for keys that hold a large share of the table.

A window over the key would put all rows of a hot key in one task. Here the per-key value is a
map-side-combined aggregate, and the way it returns to the rows is chosen from a small profile of
the keys (one column-pruned pass, at most HOT_LIMIT hashes on the driver):

* few keys, fixed-width values (size bound checked) -> broadcast; the rows are not shuffled
* many keys, some of them hot -> shuffle join on (key, salt); only hot keys are replicated
* many keys, none hot -> plain shuffle join

Hot hashes enter the plan as literals, so both join sides always agree on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 0.005
HOT_LIMIT = 256  # at least 1 / HOT_SHARE, so that no hot key is missed
HOT_MIN_ROWS = 1_000_000
# A key is hot in any case from so many rows: they should not be one task's work.
HOT_ROWS = 20_000_000
SALTS = 128


@dataclass(frozen=True)
class KeyProfile:
    rows: int
    distinct: int
    key_bytes: int
    hot: tuple[int, ...]

    def fits_broadcast(self, value_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
        """Upper bound on the per-key table: 1.2 x the sketched key count x the widest row."""
        return 1.2 * self.distinct * (self.key_bytes + value_bytes) <= limit


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def profile_keys(
    df: DataFrame,
    keys: Sequence[str],
    hot_share: float = HOT_SHARE,
    hot_min_rows: int = HOT_MIN_ROWS,
) -> KeyProfile:
    """Row count, sketched key count, widest key and the heaviest key hashes, in one pass."""
    width = F.lit(16 * len(keys))
    for k in keys:
        if not isinstance(df.schema[k].dataType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            width = width + F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0))
    got = (
        df.select(key_hash(keys).alias("h"), width.alias("w"))
        .agg(
            F.count("*").alias("rows"),
            F.approx_count_distinct("h", 0.02).alias("distinct"),
            F.max("w").alias("w"),
            F.expr(f"approx_top_k(h, {HOT_LIMIT}, 4096)").alias("top"),
        )
        .first()
    )
    floor = max(hot_min_rows, min(hot_share * got["rows"], HOT_ROWS))
    hot = tuple(t["item"] for t in got["top"] or [] if t["count"] >= floor)
    return KeyProfile(got["rows"], got["distinct"], got["w"] or 0, hot)


def _width(dtype: T.DataType) -> int | None:
    """Bytes of one value, or None where values have no fixed width."""
    if isinstance(dtype, T.StructType):
        parts = [_width(f.dataType) for f in dtype]
        return None if None in parts else 8 + sum(parts)
    fixed = isinstance(dtype, (T.NumericType, T.BooleanType, T.DatetimeType))
    return 16 if fixed else None


def attach(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    profile: KeyProfile | None = None,
    how: str = "left",
    salts: int = SALTS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join `per_key` (one row per key) to `df`; NULL keys match NULL keys.

    Value columns of `per_key` must not exist in `df`.
    """
    keys = list(keys)
    profile = profile or profile_keys(df, keys)
    values = [c for c in per_key.columns if c not in keys]
    right = per_key.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *values)
    same: Column = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    widths = [_width(per_key.schema[v].dataType) for v in values]
    bounded = None not in widths
    if bounded and profile.fits_broadcast(32 + sum(widths), broadcast_bytes):
        out = df.join(F.broadcast(right), same, how)
    elif not profile.hot:
        out = df.join(right, same, how)
    else:
        hot = list(profile.hot)
        hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        salt = F.pmod(F.xxhash64(*hashable, F.lit(7)), F.lit(salts)).cast("int")
        left = df.withColumn("_salt", F.when(key_hash(keys).isin(hot), salt).otherwise(0))
        every = F.sequence(F.lit(0), F.lit(salts - 1))
        key_cols = [f"_key_{i}" for i in range(len(keys))]
        copies = F.when(key_hash(key_cols).isin(hot), every).otherwise(F.array(F.lit(0)))
        right = right.withColumn("_salt_r", F.explode(copies))
        out = left.join(right, same & (F.col("_salt") == F.col("_salt_r")), how)
    return out.select(*df.columns, *values)
