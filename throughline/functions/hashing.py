"""Seeded draws from md5, the same on every engine and for every partitioning.

`rand()` depends on the order of rows in a partition, so a lost executor or a new
shuffle would change the draw. A hash of the row's own key does not.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPAN = float(2**32)


def digest(seed: int, *key: Column | str) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def uniform(seed: int, *key: Column | str, lane: int | Column = 0) -> Column:
    """A number in [0, 1). One digest carries four of them, one per `lane`."""
    return piece(digest(seed, *key), lane)


def piece(hexed: Column, lane: int | Column) -> Column:
    """The number in [0, 1) at that lane of a digest."""
    start = lane * 8 + 1 if isinstance(lane, int) else lane * 8 + F.lit(1)
    part = F.substr(hexed, F.lit(start) if isinstance(start, int) else start, F.lit(8))
    return F.conv(part, 16, 10).cast("double") / F.lit(_SPAN)


def fold(seed: int, k: int, *key: Column | str) -> Column:
    return F.floor(uniform(seed, *key) * F.lit(k)).cast("int")


def normal(seed: int, *key: Column | str) -> Column:
    """A standard normal from two lanes of one digest (Box and Muller)."""
    u = F.greatest(uniform(seed, *key, lane=0), F.lit(1.0 / _SPAN))
    v = uniform(seed, *key, lane=1)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


# Cumulative Poisson(1) probabilities for 0..7 events.
POISSON_CUTS = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
]


def poisson_one(u: Column) -> Column:
    """Resampling weight with mean one: how many cut points lie at or below `u`."""
    weight = F.lit(0)
    for cut in POISSON_CUTS:
        weight = weight + (u >= F.lit(cut)).cast("int")
    return weight
