"""The driver's order tables read as a pitch log: an order is an episode, a line a decision.

Games stay small however large the data: every 15,000 order keys have games of their own, so an
at-bat number stays below 1000 and a game fits a window. A game's id is made of its order's own
block, key and date alone: orders that come later change no id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from throughline.session import task_count

# Pitch code for brand numbers 1..25 (None and ZZ both map to XX).
BRAND_CODES = ["FF", "SI", "FT", "FC", "SL", "ST", "SV", "CU", "KC", "CS", "CH", "FS", "FO",
               "KN", "EP", "SC", "FA", "PO", None, "FF", "FF", "SL", "CH", "SI", "ZZ"]
# Description for return flag + line status.
FLAG_DESCRIPTIONS = {"AF": "ball", "RO": "ball", "AO": "called_strike",
                     "NF": "swinging_strike", "NO": "foul", "RF": "hit_into_play"}
ORDERS_PER_SLOT = 15_000
#: Ids that the games of one run of order keys may take; the schedule of a century needs 20,864 of them.
SLOT = 1 << 20


def pitch_log(spark: SparkSession, path: str) -> DataFrame:
    orders = spark.read.parquet(f"{path}/orders.parquet")
    lines = spark.read.parquet(f"{path}/lineitem.parquet")
    parts = spark.read.parquet(f"{path}/part.parquet").select("p_partkey", "p_brand")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    block = F.floor(day / 28).cast("long")
    placed = (
        orders.withColumns({"_block": block, "_half": (day % 28 >= 14).cast("int")})
        .select(
            "o_orderkey", "o_custkey", "o_orderstatus", "_block",
            (F.floor(F.col("o_orderkey") / ORDERS_PER_SLOT).cast("long") * SLOT
             + F.col("_block") * 16 + F.col("o_orderkey") % 8 * 2 + F.col("_half")).alias("game_pk"),
        )
    )
    joined = (
        lines.join(placed, lines.l_orderkey == placed.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey, "left")
    )
    # One exchange by game serves every window below and the in-game windows downstream. Its
    # partitions follow from the rows, as the session's number would let the sorts spill.
    joined = joined.repartition(task_count(spark, lines.count()), "game_pk")
    in_order = (W.partitionBy("game_pk", "o_orderkey")
                .orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                         "l_quantity", "l_shipdate"))
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    whole = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    described = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for kv in FLAG_DESCRIPTIONS.items() for x in kv]),
        F.concat("l_returnflag", "l_linestatus")), F.lit("unknown"))
    codes = F.array(*[F.lit(c).cast("string") for c in BRAND_CODES])
    code = F.try_element_at(codes, F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int"))
    strike = F.col("description").isin("called_strike", "swinging_strike", "foul")

    def earlier(cond, cap):
        return F.least(F.coalesce(F.sum(cond.cast("int")).over(before), F.lit(0)),
                       F.lit(cap)).cast("int")

    rows = (
        joined.withColumns({
            "description": described, "pitch_type": code,
            "pitch_number": F.row_number().over(in_order),
            "_length": F.count("*").over(whole),
            "at_bat_number": F.dense_rank().over(W.partitionBy("game_pk").orderBy("o_orderkey")),
            "pitcher": F.col("o_orderkey") % 40,
            "batter": F.lit(1000).cast("long") + F.col("o_custkey") % 50,
            "bat_score": (F.col("o_custkey") % 7).cast("int"),
        })
        .withColumns({
            "balls": earlier(F.col("description") == "ball", 3),
            "strikes": earlier(strike, 2),
            "_last": F.col("pitch_number") == F.col("_length"),
        })
    )
    hit = F.col("description") == "hit_into_play"
    ended = (
        F.when(hit, F.when(F.col("l_partkey") % 4 == 0, "home_run")
               .when(F.col("l_partkey") % 4 == 1, "single").otherwise("field_out"))
        .when(F.col("description") == "ball", "walk")
        .when(F.col("description").isin("called_strike", "swinging_strike"), "strikeout")
    )

    def base(divisor, rest):
        return F.when(F.col("o_custkey") % divisor == rest, F.col("batter"))

    return rows.select(
        "game_pk",
        F.date_add(F.lit("1995-01-01").cast("date"),
                   (F.col("_block") * 28).cast("int")).alias("game_date"),
        F.when(F.col("o_orderstatus").isin("F", "O"), "R").otherwise("S").alias("game_type"),
        "at_bat_number", "pitch_number", "pitcher", "batter",
        F.when(F.col("batter") % 2 == 0, "L").otherwise("R").alias("stand"),
        F.when(F.col("pitcher") % 3 == 0, "L").otherwise("R").alias("p_throws"),
        "balls", "strikes",
        (F.col("o_orderkey") % 3).cast("int").alias("outs_when_up"),
        base(2, 1).alias("on_1b"), base(3, 0).alias("on_2b"), base(5, 0).alias("on_3b"),
        (F.floor((F.col("at_bat_number") - 1) / 8) + 1).cast("int").alias("inning"),
        F.when(F.col("o_orderkey") % 2 == 0, "Top").otherwise("Bot").alias("inning_topbot"),
        "bat_score",
        (F.col("o_orderkey") % 7).cast("int").alias("fld_score"),
        (F.col("bat_score") + (F.col("_last") & hit).cast("int")).alias("post_bat_score"),
        F.concat(F.lit("T"), (F.col("game_pk") % 30).cast("string")).alias("home_team"),
        "pitch_type", F.col("pitch_type").alias("pitch_name"), "description",
        F.when(F.col("description") == "ball", "B").when(hit, "X").otherwise("S").alias("type"),
        F.when(F.col("_last"), ended).alias("events"),
        (F.lit(70) + F.col("l_quantity") / 2).alias("release_speed"),
        (F.col("l_tax") * 10 - F.lit(0.4)).alias("pfx_x"),
        (F.col("l_suppkey") % 21 / 10 - 1).alias("pfx_z"),
        ((F.col("l_partkey") % 41 - 20) / 10).alias("plate_x"),
        (F.lit(0.8) + F.col("l_suppkey") % 30 / 10).alias("plate_z"),
        F.lit(3.4).alias("sz_top"), F.lit(1.6).alias("sz_bot"),
        (F.lit(1800).cast("long") + F.col("l_partkey") % 900).alias("release_spin_rate"),
        (F.lit(5.5) + F.col("l_suppkey") % 15 / 10).alias("release_extension"),
        (F.col("l_suppkey") % 40 / 10 - 2).alias("release_pos_x"),
        (F.lit(54) - F.col("l_suppkey") % 15 / 10).alias("release_pos_y"),
        (F.lit(5) + F.col("l_partkey") % 20 / 10).alias("release_pos_z"),
        F.when(hit, F.lit(60) + F.col("l_quantity")).alias("launch_speed"),
        F.when(hit, (F.col("l_partkey") % 61 - 20).cast("int")).alias("launch_angle"),
        F.when(hit, F.col("l_tax") * 5).alias("estimated_woba_using_speedangle"),
        F.when(F.col("l_quantity") == 50, None)
        .otherwise(F.round(F.lit(0.05) - F.col("l_discount"), 2)).alias("delta_run_exp"),
    )


def user_event_log(spark: SparkSession, path: str) -> DataFrame:
    """`events` as a second decision log: a user's day is the episode, `minute` its time step."""
    e = spark.read.parquet(f"{path}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", "value")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.withColumns({
        "day": day,
        "user_day": F.col("user_id") * 1000 + day,
        "minute": F.hour("ts") * 60 + F.minute("ts"),
        "value": F.col("value").cast("double"),
    })
