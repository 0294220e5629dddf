"""Study configuration: column names, action alphabet, thresholds, splits."""

from __future__ import annotations

from dataclasses import dataclass, field

# Action families in array order and the codes in each.
# A null or unlisted code belongs to XX.
FAMILY_CODES = {
    "FF": ["FF"],
    "SI": ["SI", "FT"],
    "FC": ["FC"],
    "SL": ["SL", "ST", "SV"],
    "CU": ["CU", "KC", "CS"],
    "CH": ["CH"],
    "FS": ["FS", "FO"],
    "XX": ["KN", "EP", "SC", "FA", "PO"],
}
FAMILIES = list(FAMILY_CODES)
OTHER_FAMILY = "XX"

# Conservative mixing weights.
ALPHAS = [0.0, 0.1, 0.25, 0.5, 1.0]

# Report slices.
SLICES = ["all", "seq_eligible", "long_pa", "two_strike", "three_ball", "first_pitch"]

# Fixed value: default seed of every hashed draw.
SEED = 20260713

# How a pitch description becomes an outcome token.
OUTCOME_TOKENS = {
    "ball": "ball",
    "blocked_ball": "ball",
    "pitchout": "ball",
    "hit_by_pitch": "ball",
    "called_strike": "called_strike",
    "swinging_strike": "whiff",
    "swinging_strike_blocked": "whiff",
    "foul_tip": "whiff",
    "missed_bunt": "whiff",
    "foul": "foul",
    "foul_bunt": "foul",
    "bunt_foul_tip": "foul",
    "foul_pitchout": "foul",
    "swinging_pitchout": "whiff",
    "hit_into_play": "in_play",
}
TAKES = ["ball", "called_strike"]
SWINGS = ["whiff", "foul", "in_play"]

# Columns that describe the current decision's execution or its
# outcome. None of them may appear in a state view.
EXECUTION_COLUMNS = [
    "release_speed", "pfx_x", "pfx_z", "plate_x", "plate_z", "plate_x_br", "plate_z_norm",
    "release_spin_rate", "release_extension", "release_pos_x", "release_pos_y", "release_pos_z",
    "spin_axis", "effective_speed", "zone", "vx0", "vy0", "vz0", "ax", "ay", "az",
]
OUTCOME_COLUMNS = [
    "description", "type", "events", "launch_speed", "launch_angle",
    "estimated_woba_using_speedangle", "outcome", "bb_type", "hit_location",
    "post_bat_score", "delta_run_exp", "reward", "pitch_type", "pitch_name", "family",
]


@dataclass(frozen=True)
class Cols:
    """Names of the columns an operator reads, so it runs on any decision log."""

    game: str = "game_pk"
    date: str = "game_date"
    season: str = "season"
    at_bat: str = "at_bat_number"
    order: str = "pitch_number"
    episode: str = "pa_id"
    row: str = "row_id"
    actor: str = "pitcher"
    opponent: str = "batter"
    action: str = "family"
    reward: str = "reward"
    outcome: str = "outcome"

    @property
    def key(self) -> list[str]:
        return [self.game, self.at_bat, self.order]


PITCH = Cols()

# A second log: one user's day is the episode, the event type the action.
USER_EVENTS = Cols(
    game="user_id", date="day", at_bat="day", order="seq", episode="user_day",
    row="event_id", actor="user_id", opponent="user_id", action="event_type", reward="value",
)
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@dataclass(frozen=True)
class Split:
    train: tuple[int, ...]
    val: tuple[int, ...]
    test: tuple[int, ...]


@dataclass(frozen=True)
class Study:
    game_types: tuple[str, ...] = ("R",)
    first_season: int = 2020
    window_days: int = 365
    min_count: int = 50
    min_share: float = 0.03
    min_history: int = 100
    shrink: float = 50.0
    markov_depth: int = 3
    alphas: tuple[float, ...] = tuple(ALPHAS)
    weight_cap: float = 20.0
    support_floor: float = 0.01
    rare_floor: float = 0.05
    bins: int = 10
    replicates: int = 200
    tolerance: float = 0.005
    seed: int = SEED
    split: Split = Split((2021, 2022, 2023), (2024,), (2025,))
    replications: tuple[Split, ...] = field(default=(
        Split((2021, 2022), (2023,), (2024,)),
        Split((2021, 2022, 2023), (2024,), (2025,)),
    ))
