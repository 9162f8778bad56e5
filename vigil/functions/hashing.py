"""Hash-driven randomness: the same row always gets the same draw.

Used instead of ``rand``/``sample``/``randomSplit`` so that a lost executor or
another partitioning cannot change a result, and so SQL can repeat the draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def digest(*parts) -> Column:
    """md5 (lower-case hex) of the concatenated parts; plain values are literals."""
    return F.md5(F.concat(*[as_text(p) for p in parts]))


def uniform(*parts) -> Column:
    """Draw in [0, 1): the first 32 bits of the digest."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hex_below(probability: float, digits: int = 4) -> str:
    """Fixed-width hex bound: a hex draw sorts below it with ``probability``."""
    return format(min(round(probability * 16**digits), 16**digits - 1), f"0{digits}x")
