"""How keyed state ends."""

from __future__ import annotations

from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ends(ttl_ms: int | None) -> str:
    """None: state never ends, for streams that stop by themselves; a time to live keeps a stream running batches."""
    return GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout


def keep(state: GroupState, ttl_ms: int | None) -> None:
    if ttl_ms:
        state.setTimeoutDuration(ttl_ms)
