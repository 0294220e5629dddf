"""What the registered queries share: the study at hand, inputs, rounding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from throughline.config import FAMILIES, Split, Study
from throughline.operators import decision
from throughline.sources.adapter import pitch_log

# The order tables cover 1995-2001, and a small scale has few pitches per pitcher.
STUDY = Study(
    game_types=("R", "S"), first_season=1995, min_count=5, min_history=20,
    split=Split((1995, 1996, 1997, 1998, 1999), (2000,), (2001,)),
    replications=(
        Split((1995, 1996, 1997, 1998), (1999,), (2000,)),
        Split((1995, 1996, 1997, 1998, 1999), (2000,), (2001,)),
    ),
)
TRAIN = "season <= 1999"
HELD_OUT = "season >= 2000"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, path: str) -> DataFrame:
    return decision.decision_table(pitch_log(spark, path))


def r6(col: Column | str) -> Column:
    """Six places; the nudge keeps decimal ties on one side whatever the summing order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def spread(arr: str, prefix: str = "p", names=FAMILIES) -> list[Column]:
    """A probability vector as one rounded column per action."""
    return [r6(F.col(arr)[i]).alias(f"{prefix}_{n.lower()}") for i, n in enumerate(names)]
