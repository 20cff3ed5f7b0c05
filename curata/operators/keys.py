"""What tells two notes apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def note_key(df: DataFrame, key: str | Sequence[str] | None = None) -> list[str]:
    """``key`` as a list; without one a note is its task and its id, or its id where the frame has no task.

    Tasks number their notes on their own, so an id alone can mean several notes."""
    if key is None:
        return [c for c in ("task", "note_id") if c in df.columns]
    return [key] if isinstance(key, str) else list(key)
