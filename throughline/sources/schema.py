"""The pinned schema of the pitch log: 119 source columns, fully empty ones dropped at load."""

from __future__ import annotations

from pyspark.sql import types as T

# Source column names by type.
TEXT = """pitch_type game_date player_name events description des game_type stand p_throws
home_team away_team type bb_type inning_topbot pitch_name if_fielding_alignment
of_fielding_alignment""".split()
REAL = """release_speed release_pos_x release_pos_z pfx_x pfx_z plate_x plate_z hc_x hc_y
vx0 vy0 vz0 ax ay az sz_top sz_bot launch_speed effective_speed release_extension
release_pos_y estimated_ba_using_speedangle estimated_woba_using_speedangle woba_value
delta_home_win_exp delta_run_exp bat_speed swing_length miss_distance
estimated_slg_using_speedangle delta_pitcher_run_exp hyper_speed home_win_exp bat_win_exp
api_break_z_with_gravity api_break_x_arm api_break_x_batter_in arm_angle attack_angle
attack_direction swing_path_tilt intercept_ball_minus_batter_pos_x_inches
intercept_ball_minus_batter_pos_y_inches""".split()
WIDE_INT = """batter pitcher on_1b on_2b on_3b game_pk release_spin_rate fielder_2 fielder_3
fielder_4 fielder_5 fielder_6 fielder_7 fielder_8 fielder_9""".split()
SMALL_INT = """zone hit_location balls strikes game_year outs_when_up inning hit_distance_sc
launch_angle woba_denom babip_value iso_value launch_speed_angle at_bat_number pitch_number
home_score away_score bat_score fld_score post_away_score post_home_score post_bat_score
post_fld_score spin_axis home_score_diff bat_score_diff age_pit_legacy age_bat_legacy age_pit
age_bat n_thruorder_pitcher n_priorpa_thisgame_player_at_bat pitcher_days_since_prev_game
batter_days_since_prev_game pitcher_days_until_next_game batter_days_until_next_game""".split()
# Always null in the source.
EMPTY = """spin_dir spin_rate_deprecated break_angle_deprecated break_length_deprecated
tfs_deprecated tfs_zulu_deprecated umpire sv_id""".split()

PITCH_LOG = T.StructType(
    [T.StructField(c, T.DateType() if c == "game_date" else T.StringType()) for c in TEXT]
    + [T.StructField(c, T.DoubleType()) for c in REAL]
    + [T.StructField(c, T.LongType()) for c in WIDE_INT]
    + [T.StructField(c, T.IntegerType()) for c in SMALL_INT]
)
SOURCE_COLUMNS = len(TEXT) + len(REAL) + len(WIDE_INT) + len(SMALL_INT) + len(EMPTY)

# Columns every analysis relies on.
REQUIRED = """game_pk game_date game_type at_bat_number pitch_number inning inning_topbot balls
strikes outs_when_up on_1b on_2b on_3b stand p_throws pitcher batter bat_score fld_score
pitch_type pitch_name description type events delta_run_exp""".split()
