"""Spark analytics for event logs whose rows are decisions inside short ordered episodes."""
