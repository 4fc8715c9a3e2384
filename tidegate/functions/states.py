"""Run and task states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.text import strip

SUCCESS, RUNNING, WAITING, FAILED, NONE = "SUCCESS", "RUNNING", "WAITING", "FAILED", "NONE"

# The tone of each known state; every other state is NONE.
TONES = {
    SUCCESS: ["success", "succeeded"],
    RUNNING: ["running", "deferred", "restarting"],
    WAITING: ["queued", "scheduled", "up_for_retry", "up_for_reschedule", "awaiting_input"],
    FAILED: ["failed", "upstream_failed"],
}

# The states of a task that runs or waits now, and the backend states that answered.
ACTIVE_STATES = ["running", "queued", "scheduled", "deferred", "up_for_retry", "up_for_reschedule"]
REACHABLE_STATES = ["UP", "DEGRADED"]


def run_tone(state: Column) -> Column:
    """SUCCESS, RUNNING, WAITING, FAILED or NONE; white space and case do not matter."""
    name = F.lower(strip(state))
    tone = None
    for value, states in TONES.items():
        tone = F.when(name.isin(states), value) if tone is None else tone.when(name.isin(states), value)
    return tone.otherwise(NONE)


def is_active(tone: Column) -> Column:
    return tone.isin(RUNNING, WAITING)


def is_reachable(state: Column) -> Column:
    return F.coalesce(state.isin(REACHABLE_STATES), F.lit(False))


def pool_exhausted(slots: Column, free: Column, queued: Column, scheduled: Column) -> Column:
    """Work waits although no slot is free; a negative number of slots means no limit."""
    return (slots >= 0) & (free <= 0) & ((queued + scheduled) > 0)
