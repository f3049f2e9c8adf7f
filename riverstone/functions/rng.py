"""Random numbers that any SQL engine can make again: the first 32 bits of an MD5 of a seed and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """In [0, 1). Ties are to be expected beyond some 10,000 keys: order by (uniform, key)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
