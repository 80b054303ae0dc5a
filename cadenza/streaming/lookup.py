"""Events of a stream joined with a table that does not change meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table up to which it is sent to all tasks; a larger one is met by a shuffle.
MOST_SENT = 200_000


def with_tracks(events: DataFrame, mapping: DataFrame, key: str = "nav_id") -> DataFrame:
    """`events` with track_id from `mapping` (key, track_id, one row for each key), null where it has none.

    The mapping is counted when the stream is set up: a small one is broadcast, a large one joined by a shuffle of
    each batch. Either way no state is kept.
    """
    known = mapping.select(key, "track_id")
    if known.limit(MOST_SENT + 1).count() <= MOST_SENT:
        known = F.broadcast(known)
    return events.join(known, key, "left")
