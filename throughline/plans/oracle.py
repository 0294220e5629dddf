"""Shared SQL text for the checks: the pitch log and decision table as DuckDB would build them."""

from __future__ import annotations

from throughline.config import FAMILIES, FAMILY_CODES, OUTCOME_TOKENS
from throughline.sources.adapter import BRAND_CODES, FLAG_DESCRIPTIONS


def r6(expr: str) -> str:
    """Round like `plans.common.r6`: the nudge keeps decimal ties on one side."""
    return f"(round(({expr}) + 1e-9, 6) + 0.0)"


def uniform(seed: int, *key: str, lane: str | int = 0) -> str:
    parts = "||'|'||".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key])
    start = 1 + 8 * lane if isinstance(lane, int) else f"1+8*({lane})"
    return f"(('0x'||substr(md5({parts}),{start},8))::BIGINT / 4294967296.0::DOUBLE)"


def digest(seed: int, *key: str) -> str:
    parts = "||'|'||".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key])
    return f"md5({parts})"


def _case(expr: str, pairs: dict[str, str], default: str) -> str:
    body = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE {expr} {body} ELSE {default} END"


_CODES = "[" + ",".join("NULL" if c is None else f"'{c}'" for c in BRAND_CODES) + "]"
_FAMILY = _case("pitch_type", {c: f for f, cs in FAMILY_CODES.items() for c in cs}, "'XX'")
_OUTCOME = _case("description", OUTCOME_TOKENS, "'other'")

FAMILY_LIST = ",".join(f"'{f}'" for f in FAMILIES)

LOG = f"""
placed AS (
  SELECT o.*, dd//28 AS blk,
    (o_orderkey//15000)*1048576 + (dd//28)*16 + o_orderkey%8*2 + CASE WHEN dd%28>=14 THEN 1 ELSE 0 END AS game_pk
  FROM (SELECT *, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS dd FROM orders) o),
lined AS (
  SELECT *, {_case("l_returnflag||l_linestatus", FLAG_DESCRIPTIONS, "'unknown'")} AS description,
    ({_CODES})[TRY_CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT)] AS pitch_type,
    CAST(row_number() OVER w AS INT) AS pitch_number,
    count(*) OVER (PARTITION BY o_orderkey) AS pa_len,
    CAST(dense_rank() OVER (PARTITION BY game_pk ORDER BY o_orderkey) AS INT) AS at_bat_number,
    o_orderkey%40 AS pitcher, 1000+o_custkey%50 AS batter, CAST(o_custkey%7 AS INT) AS bat_score
  FROM lineitem JOIN placed ON l_orderkey=o_orderkey LEFT JOIN part ON l_partkey=p_partkey
  WINDOW w AS (PARTITION BY o_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate)),
log AS (
  SELECT game_pk, DATE '1995-01-01' + CAST(blk*28 AS INT) AS game_date,
    CASE WHEN o_orderstatus IN ('F','O') THEN 'R' ELSE 'S' END AS game_type,
    at_bat_number, pitch_number, pitcher, batter,
    CASE WHEN batter%2=0 THEN 'L' ELSE 'R' END AS stand,
    CASE WHEN pitcher%3=0 THEN 'L' ELSE 'R' END AS p_throws,
    CAST(least(coalesce(sum(CASE WHEN description='ball' THEN 1 ELSE 0 END) OVER p, 0), 3) AS INT) AS balls,
    CAST(least(coalesce(sum(CASE WHEN description IN ('called_strike','swinging_strike','foul') THEN 1 ELSE 0 END) OVER p, 0), 2) AS INT) AS strikes,
    CAST(o_orderkey%3 AS INT) AS outs_when_up,
    CASE WHEN o_custkey%2=1 THEN batter END AS on_1b,
    CASE WHEN o_custkey%3=0 THEN batter END AS on_2b,
    CASE WHEN o_custkey%5=0 THEN batter END AS on_3b,
    CAST(1+(at_bat_number-1)//8 AS INT) AS inning,
    CASE WHEN o_orderkey%2=0 THEN 'Top' ELSE 'Bot' END AS inning_topbot,
    bat_score, CAST(o_orderkey%7 AS INT) AS fld_score,
    CAST(bat_score + CASE WHEN pitch_number=pa_len AND description='hit_into_play' THEN 1 ELSE 0 END AS INT) AS post_bat_score,
    'T'||(game_pk%30) AS home_team,
    pitch_type, pitch_type AS pitch_name, description,
    CASE WHEN description='ball' THEN 'B' WHEN description='hit_into_play' THEN 'X' ELSE 'S' END AS type,
    CASE WHEN pitch_number<>pa_len THEN NULL
      WHEN description='hit_into_play' THEN CASE l_partkey%4 WHEN 0 THEN 'home_run' WHEN 1 THEN 'single' ELSE 'field_out' END
      WHEN description='ball' THEN 'walk'
      WHEN description IN ('called_strike','swinging_strike') THEN 'strikeout' END AS events,
    70 + l_quantity/2 AS release_speed, l_tax*10 - 0.4::DOUBLE AS pfx_x, (l_suppkey%21)/10 - 1 AS pfx_z,
    (l_partkey%41 - 20)/10 AS plate_x, 0.8::DOUBLE + (l_suppkey%30)/10 AS plate_z,
    3.4::DOUBLE AS sz_top, 1.6::DOUBLE AS sz_bot,
    1800 + l_partkey%900 AS release_spin_rate, 5.5::DOUBLE + (l_suppkey%15)/10 AS release_extension,
    (l_suppkey%40)/10 - 2 AS release_pos_x, 54 - (l_suppkey%15)/10 AS release_pos_y, 5 + (l_partkey%20)/10 AS release_pos_z,
    CASE WHEN description='hit_into_play' THEN 60 + l_quantity END AS launch_speed,
    CASE WHEN description='hit_into_play' THEN CAST(l_partkey%61 - 20 AS INT) END AS launch_angle,
    CASE WHEN description='hit_into_play' THEN l_tax*5 END AS estimated_woba_using_speedangle,
    CASE WHEN l_quantity=50 THEN NULL ELSE round(0.05::DOUBLE - l_discount, 2) END AS delta_run_exp
  FROM lined
  WINDOW p AS (PARTITION BY o_orderkey ORDER BY pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dec AS (
  SELECT *, CAST(year(game_date) AS INT) AS season, date_diff('day', DATE '1995-01-01', game_date) AS dayno,
    game_pk*1000+at_bat_number AS pa_id, (game_pk*1000+at_bat_number)*100+pitch_number AS row_id,
    {_FAMILY} AS family, {_OUTCOME} AS outcome, 0.0::DOUBLE - delta_run_exp AS reward,
    balls||'-'||strikes AS count_state,
    CAST((on_1b IS NOT NULL)::INT + 2*(on_2b IS NOT NULL)::INT + 4*(on_3b IS NOT NULL)::INT AS INT) AS base_state,
    CASE WHEN stand='L' THEN -plate_x ELSE plate_x END AS plate_x_br,
    (plate_z - sz_bot)/(sz_top - sz_bot) AS plate_z_norm
  FROM log)"""


def sql(body: str, *ctes: str, log: str = LOG) -> str:
    """`WITH <log, decision table>, <ctes> <body>`."""
    parts = [log.strip()] if log else []
    return "WITH RECURSIVE " + ",\n".join(parts + [c.strip() for c in ctes]) + "\n" + body.strip()


def shares(prefix: str = "n", expr: str = "family", names=FAMILIES) -> str:
    """One conditional count per action: `n_ff, n_si, ...`."""
    return ", ".join(
        f"CAST(sum(CASE WHEN {expr}='{f}' THEN 1 ELSE 0 END) AS BIGINT) AS {prefix}_{f.lower()}"
        for f in names)
