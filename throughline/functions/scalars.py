"""Row-level derivations of the decision table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from throughline.config import FAMILY_CODES, OTHER_FAMILY, OUTCOME_TOKENS, TAKES


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def family(code: Column, codes: dict[str, list[str]] = FAMILY_CODES) -> Column:
    lookup = {c: fam for fam, members in codes.items() for c in members}
    return F.coalesce(F.try_element_at(_literal_map(lookup), code), F.lit(OTHER_FAMILY))


def outcome_token(description: Column, tokens: dict[str, str] = OUTCOME_TOKENS) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(tokens), description), F.lit("other"))


def is_take(outcome: Column) -> Column:
    return outcome.isin(TAKES)


def base_state(on_1b: Column, on_2b: Column, on_3b: Column) -> Column:
    return (on_1b.isNotNull().cast("int") + 2 * on_2b.isNotNull().cast("int")
            + 4 * on_3b.isNotNull().cast("int"))


def count_state(balls: Column, strikes: Column) -> Column:
    return F.concat_ws("-", balls.cast("string"), strikes.cast("string"))


def bucket(value: Column, bins: int) -> Column:
    return F.least(F.floor(value * F.lit(bins)), F.lit(bins - 1)).cast("int")
